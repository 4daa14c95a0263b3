"""J1/J2/J8 beyond the broadcast bound, and one parse a body."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tokenledger.config import LedgerConfig
from tokenledger.functions import json_strict as J
from tokenledger.operators import keys, usage
from tokenledger.plans import enrich
from tokenledger.plans import fixtures as FX


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def nodes(df):
    """(name, columns) of every node of the physical plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\n\(\d+\) (\w+)[^\n]*\n(.*?)(?=\n\n)", text, re.S)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("mode", ["object", "none"])
def test_no_exchange_carries_a_body(spark, no_broadcast, mode):
    plain = LedgerConfig(body_mode=mode)
    never = replace(plain, dim_broadcast_bytes=0)
    ex, dims = FX.exchanges(spark, SF), FX.load_dims(spark, SF)
    # exchanges as a job reads them: the fixture deals out its own small file
    path = f"{spark.conf.get('spark.checkpoint.dir')}/exchanges-{mode}"
    ex.write.mode("overwrite").parquet(path)
    ex = spark.read.parquet(path)
    shuffled = enrich.enrich_requests(ex, dims, never)
    found = nodes(shuffled)
    moved = [body for name, body in found if "Exchange" in name]
    assert len(moved) >= 4 and not any("BroadcastExchange" in name for name, _ in found)
    assert not any(c in body for body in moved for c in ("request_body", "response_body"))
    assert rows(shuffled) == rows(enrich.enrich_requests(ex, dims, plain))


def test_keys_in_use_come_back_small(spark, no_broadcast):
    """A dimension beyond the bound is cut to the keys in use; these are
    broadcast, and the requests are not shuffled."""
    dims = FX.load_dims(spark, SF)
    ex = FX.exchanges(spark, SF).where("event_id < 40")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/few-exchanges"
    ex.write.mode("overwrite").parquet(path)
    ex = spark.read.parquet(path)
    used = keys.in_use(dims.api_keys, "key_hash", enrich.prepare(ex).select(F.sha2("api_key", 256).alias("h")),
                       LedgerConfig(dim_broadcast_bytes=0))
    assert 0 < used.count() < dims.api_keys.count()
    # the dimensions joined to a much larger table look too large; the keys in use do not
    many = spark.range(1 << 17).select(F.lit("x").alias("key_hash"))
    wide = dims.api_keys.unionByName(many, allowMissingColumns=True)
    large = replace(dims, api_keys=wide)
    bound = 2_000_000
    cfg = LedgerConfig(dim_broadcast_bytes=bound)
    assert not keys.fits(wide, cfg)
    df = enrich.resolve(ex, large, cfg)
    facts = [body for name, body in nodes(df) if "Exchange" in name and name != "BroadcastExchange"]
    assert not any("request_body" in body for body in facts)
    names = ["request_id", "api_key_status", "api_key_id", "proxy_status", "proxy_key_id"]
    assert rows(df.select(names)) == rows(enrich.resolve(ex, dims).select(names))


def parses(df) -> list[str]:
    """Column parsed by each JSON parse of the optimized plan, variants aside."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [m.group(1) for m in re.finditer(r"from_json\(StructField\(d,.*?concat\(\{\"d\":\[, (\w+)#", plan)]


def test_one_parse_a_body(spark):
    d = spark.createDataFrame([("openai", 200, "{}", "{}")], "provider string, status_code int, request_body string, response_body string")
    one = usage.request_models(d)
    assert parses(one) == ["request_body"]
    for parser in usage.USAGE_OF:
        assert parses(usage.parse_usage(d, parser)) == ["response_body"]
    assert parses(usage.translate_requests(d)) == ["request_body"]
    assert parses(usage.translate_responses(d)) == ["response_body"]
    # one for each parser, of which a row takes one, and one for what cannot be translated
    assert sorted(parses(usage.usage_metrics(d))) == ["request_body"] + ["response_body"] * 5


BODIES = ['{"model":"a"}', '{"model":"a"}]', '{"model":"a"}}', '{"model":"a"},{"model":"b"}', '{"model":"a"} x', "null", " null\n", "nul",
          '{"model":"a"},"z":5', '[{"model":"a"}]', '{"model":"12"}', '{"model":12}', '{"model":"a\\u005d}"}', '{"model":"]}"}', "", None]
GOOD = [True, False, False, False, False, True, True, False, False, False, True, False, True, True, False, False]


def test_text_behind_a_body_is_seen(spark):
    from tokenledger.functions.providers import MODEL_REQUEST
    d = spark.createDataFrame(list(enumerate(BODIES)), "k int, request_body string")
    table = J.with_strict(d, "request_body", MODEL_REQUEST, "x").orderBy("k").collect()
    alone = d.select("k", J.strict_json(F.col("request_body"), MODEL_REQUEST).alias("x")).orderBy("k").collect()
    assert [r.x.ok for r in table] == [r.x.ok for r in alone] == GOOD
    assert [r.x.v and r.x.v.model for r in table] == [r.x.v and r.x.v.model for r in alone]


def test_cut_keys_are_folded_and_small(spark, no_broadcast):
    """Key tables whose counted rows exceed the bound are cut to the keys in use
    in one scan, whatever their files' size; the log is the same."""
    ex, dims = FX.exchanges(spark, SF), FX.load_dims(spark, SF)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/exchanges-cut"
    ex.write.mode("overwrite").parquet(path)
    ex = spark.read.parquet(path)
    one = ex.where("event_id < 5")
    rows_of = dims.api_keys.count()
    cfg = LedgerConfig(dim_broadcast_bytes=rows_of * 100)  # a row takes more
    assert not keys.fits(dims.api_keys, cfg)
    cut, fit = enrich._key_dims(enrich._with_provider(one, cfg), dims, cfg)
    assert fit and cut.folded and 0 < cut.api_keys.count() <= 5 and "active_keys" in cut.api_keys.columns
    assert rows(enrich.enrich_requests(ex, dims, cfg)) == rows(enrich.enrich_requests(ex, dims))
    folded = enrich.fold(dims)
    assert enrich.fold(folded) is folded
    assert rows(enrich.enrich_requests(ex, folded)) == rows(enrich.enrich_requests(ex, dims))


def test_a_stream_folds_its_dimensions_once(spark, monkeypatch):
    """Mappings are decrypted once a snapshot of the dimensions, not once a micro-batch."""
    from tokenledger.session import scratch_path
    from tokenledger.sources import bodies
    from tokenledger.streaming import jobs
    src, out = scratch_path(spark, "src"), scratch_path(spark, "log")
    ex, dims = FX.exchanges(spark, SF).where("event_id < 300"), FX.load_dims(spark, SF)
    bodies.write_exchanges(ex, src, files=3)
    made, plain = [], keys.proxy_dimension
    monkeypatch.setattr(keys, "proxy_dimension", lambda *a: made.append(1) or plain(*a))
    jobs.stream_enrich(spark, src, dims, out, scratch_path(spark, "ckpt"), max_files=1).awaitTermination()
    assert len(made) == 1
    names = ["id", "user_id", "api_key_id", "proxy_key_id", "total_cost", "reject_reason"]
    assert rows(spark.read.parquet(out).select(names)) == rows(enrich.enrich_requests(ex, dims).select(names))
