import pytest
from pyspark.sql import functions as F

from tokenledger.functions import headers as H
from tokenledger.functions import providers as P
from tests.conftest import one


def detect(spark, path, headers):
    df = spark.createDataFrame([(path, headers)], "path string, h map<string,string>")
    r = df.select(P.detect_provider(F.col("path"), H.extract_headers(F.col("h"))).alias("p")).first()["p"]
    return r["provider"], r["base_url"]


@pytest.mark.parametrize("header,provider", [
    ("openai", "openai"), ("anthropic", "anthropic"), ("GEMINI", "gemini"), ("gemini-openai", "gemini-openai"),
    ("Anthropic-OpenAI", "anthropic-openai"), ("azure", "azure"), ("bedrock", "bedrock"), ("nope", "unknown"),
])
def test_explicit_header(spark, header, provider):
    assert detect(spark, "/v1/messages", {"X-GW-Provider": header})[0] == provider


@pytest.mark.parametrize("path,provider", [
    ("/v1/chat/completions", "openai"), ("/v1/responses", "openai"), ("/v1/embeddings", "openai"),
    ("/v1/completions", "openai"), ("/v1/messages", "anthropic"),
    ("/v1beta/models/gemini-pro:generateContent", "gemini"),
    ("/v1beta/models/gemini-pro:streamGenerateContent", "gemini"), ("/unknown", "openai"),
])
def test_path_rules(spark, path, provider):
    assert detect(spark, path, {})[0] == provider


def test_header_beats_path_and_base_url(spark):
    assert detect(spark, "/v1/chat/completions", {"x-gw-provider": "anthropic"}) == \
        ("anthropic", "https://api.anthropic.com")
    assert detect(spark, "/x", {"x-gw-provider": "gemini-openai"})[1].endswith("/v1beta/openai")


@pytest.mark.parametrize("body,model", [
    ('{"model":"any-name"}', "any-name"), ('{"n":1,"model":"é/x"}', "é/x"), ('{"n":1}', "unknown"),
    ('{"model":""}', "unknown"), ('{"model":null}', "unknown"), ('{"model":["a"]}', "unknown"), ('{"model"', "unknown"),
    ("", "unknown"),
])
def test_extract_model(spark, body, model):
    assert one(spark, P.extract_model(F.col("b")), body) == model


def usage(spark, fn, body):
    r = one(spark, fn(F.col("b")), body)
    return r["ok"], r["model"], r["input"], r["output"], r["cached"], r["creation"]


def body(usage_field: str, model_field: str, name, counts, **more) -> str:
    import json
    doc = dict(more)
    doc[model_field] = name
    if counts is not None:
        doc[usage_field] = counts
    return json.dumps(doc)


# Every field of the wire format present, absent, zero, null and of a wrong
# type. Expected values follow from the rules in FIXTURES.md part 1.
@pytest.mark.parametrize("counts,expect", [
    ({"prompt_tokens": 31, "completion_tokens": 6}, (31, 6, 0)),
    ({"prompt_tokens": 31}, (31, 0, 0)),
    ({"completion_tokens": 6}, (0, 6, 0)),
    ({"prompt_tokens": 0, "completion_tokens": 0}, (0, 0, 0)),
    ({"prompt_tokens": None, "completion_tokens": 6}, (0, 6, 0)),
    ({"prompt_tokens": 31, "prompt_tokens_details": {"cached_tokens": 17}}, (31, 0, 17)),
    ({"prompt_tokens": 31, "prompt_tokens_details": {}}, (31, 0, 0)),
    ({"prompt_tokens": 31, "prompt_tokens_details": None}, (31, 0, 0)),
    ({"input_tokens": 44, "output_tokens": 2}, (44, 2, 0)),
    ({"input_tokens": 44, "input_tokens_details": {"cached_tokens": 11}}, (44, 0, 11)),
    ({"output_tokens": 2}, (0, 2, 0)),
    ({"prompt_tokens": 31, "completion_tokens": 6, "input_tokens": 0, "output_tokens": 0}, (31, 6, 0)),
    ({"prompt_tokens": 31, "completion_tokens": 6, "input_tokens": 0, "output_tokens": 2}, (0, 2, 0)),
    ({}, (0, 0, 0)),
    (None, (0, 0, 0)),
])
def test_openai(spark, counts, expect):
    text = body("usage", "model", "m-one", counts, object="x")
    assert usage(spark, P.parse_usage_openai, text)[:5] == (True, "m-one", *expect)


@pytest.mark.parametrize("counts,expect", [
    ({"input_tokens": 21, "output_tokens": 4}, (21, 4, 0, 0)),
    ({"input_tokens": 21}, (21, 0, 0, 0)),
    ({"output_tokens": 4}, (0, 4, 0, 0)),
    ({"input_tokens": 21, "cache_read_input_tokens": 300}, (321, 0, 300, 0)),
    ({"input_tokens": 21, "cache_creation_input_tokens": 70}, (91, 0, 0, 70)),
    ({"input_tokens": 21, "output_tokens": 4, "cache_read_input_tokens": 300, "cache_creation_input_tokens": 70},
     (391, 4, 300, 70)),
    ({"cache_read_input_tokens": 300}, (300, 0, 300, 0)),
    ({"input_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": None}, (0, 0, 0, 0)),
    ({}, (0, 0, 0, 0)),
    (None, (0, 0, 0, 0)),
])
def test_anthropic(spark, counts, expect):
    assert usage(spark, P.parse_usage_anthropic, body("usage", "model", "m-two", counts)) == (True, "m-two", *expect)


@pytest.mark.parametrize("counts,expect", [
    ({"promptTokenCount": 9, "candidatesTokenCount": 33}, (9, 33, 0)),
    ({"promptTokenCount": 9}, (9, 0, 0)),
    ({"candidatesTokenCount": 33}, (0, 33, 0)),
    ({"promptTokenCount": 90, "candidatesTokenCount": 33, "cachedContentTokenCount": 60}, (90, 33, 60)),
    ({"cachedContentTokenCount": 60}, (0, 0, 60)),
    ({"promptTokenCount": None}, (0, 0, 0)),
    ({}, (0, 0, 0)),
    (None, (0, 0, 0)),
])
def test_gemini(spark, counts, expect):
    text = body("usageMetadata", "modelVersion", "m-three", counts, model="not this one")
    assert usage(spark, P.parse_usage_gemini, text)[:5] == (True, "m-three", *expect)


@pytest.mark.parametrize("fn,field,model", [
    (P.parse_usage_openai, "usage", "model"), (P.parse_usage_anthropic, "usage", "model"),
    (P.parse_usage_gemini, "usageMetadata", "modelVersion")])
def test_undecodable_bodies(spark, fn, field, model):
    for text in ("", "[", '{"%s": [' % field, '{"%s": 7}' % field, '{"%s": "x"}' % model + "}"):
        assert usage(spark, fn, text) == (False, "", 0, 0, 0, 0), text
    assert usage(spark, fn, '{"%s": 12}' % model)[0] is False       # a number is no model name
    assert usage(spark, fn, "{}") == (True, "", 0, 0, 0, 0)


def test_dispatch_and_fallbacks(spark):
    from tokenledger.operators.usage import usage_metrics
    rows = [
        ("openai", 200, '{"model":"m","usage":{"prompt_tokens":3,"completion_tokens":4}}', '{"model":"q"}'),
        ("azure", 200, '{"model":"","usage":{"prompt_tokens":3}}', '{"model":"q"}'),
        ("anthropic", 200, '{"model":"c","usage":{"input_tokens":1,"output_tokens":2}}', '{}'),
        ("gemini", 200, '{"usageMetadata":{"promptTokenCount":4}}', '{"model":"gq"}'),
        ("bedrock", 200, "not json", '{"model":"bq"}'),
        ("anthropic-openai", 200, '{"model":"c","content":[{"type":"text","text":"x"}],"usage":{"input_tokens":7,'
         '"output_tokens":8,"cache_read_input_tokens":5}}', '{"model":"aq"}'),
        ("anthropic-openai", 200, "{bad", '{"model":"aq"}'),
        ("anthropic-openai", 500, '{"error":{}}', '{"model":"aq"}'),
    ]
    df = spark.createDataFrame(rows, "provider string, status_code int, response_body string, request_body string")
    got = [tuple(r["usage"][k] for k in ("ok", "provider", "model", "input", "output", "cached"))
           for r in usage_metrics(df).collect()]
    assert got == [
        (True, "openai", "m", 3, 4, 0),
        (True, "openai", "q", 3, 0, 0),
        (True, "anthropic", "c", 1, 2, 0),
        (True, "gemini", "gq", 4, 0, 0),
        (False, "bedrock", "bq", 0, 0, 0),
        (True, "openai", "c", 7, 8, 0),            # translated: cache counts lost
        (False, "anthropic-openai", "aq", 0, 0, 0),
        (True, "openai", "aq", 0, 0, 0),           # >= 400: not translated, error body decodes
    ]
