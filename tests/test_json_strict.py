import pytest
from pyspark.sql import functions as F

from tokenledger.functions.json_strict import strict_json
from tokenledger.functions.providers import OPENAI_USAGE, MODEL_REQUEST
from tests.conftest import one

CASES = [
    ('{"model":"a","usage":{"prompt_tokens":3}}', True),
    ('{"model":"a","usage":{"prompt_tokens":1.5}}', False),     # float for an integer
    ('{"model":"a","usage":{"prompt_tokens":5.0}}', False),
    ('{"model":"a","usage":{"prompt_tokens":"7"}}', False),     # string for an integer
    ('{"usage":[]}', False),                                     # array for an object
    ('{"model":"a"} xyz', False),                                # text after the value
    ('{"usage": {', False),                                      # truncated
    ('', False),
    ("{'model':'x'}", False),                                    # single quotes
    ('[1,2]', False),                                            # top-level array
    ('"str"', False),
    ('{"model":123}', False),                                    # number for a string
    ('{"a":1,"a":2}', True),                                     # duplicate keys: last wins
    ('{"model":null,"usage":null}', True),                       # null fields -> zero values
    ('null', True),                                              # bare null decodes to zeros
]


@pytest.mark.parametrize("body,ok", CASES)
def test_strict_validity(spark, body, ok):
    r = one(spark, strict_json(F.col("b"), OPENAI_USAGE), body)
    assert r["ok"] is ok


def test_values_and_duplicate_keys(spark):
    r = one(spark, strict_json(F.col("b"), MODEL_REQUEST), '{"model":"a","model":"b"}')
    assert r["ok"] and r["v"]["model"] == "b"


def test_bad_type_seen_through_parquet_pruning(spark, tmp_path):
    # a wrong type in a field the query does not select still fails the decode
    p = str(tmp_path / "bodies")
    spark.createDataFrame([('{"model":"m","usage":{"completion_tokens":"x"}}',)], "b string") \
        .write.parquet(p)
    d = spark.read.parquet(p).select(strict_json(F.col("b"), OPENAI_USAGE).alias("u"))
    r = d.select("u.ok", "u.v.model").first()
    assert r["ok"] is False
