import hashlib
import json

from pyspark.sql import functions as F

from tokenledger.functions import headers as H
from tokenledger.operators.usage import translate_requests, translate_responses


def _req(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "request_body string")
    return [r["translated"] for r in translate_requests(df).collect()]


def _chat(*messages, **fields) -> str:
    return json.dumps({"model": "chat-x", "messages": list(messages), **fields})


def test_translated_messages(spark):
    ask, reply = {"role": "user", "content": "why?"}, {"role": "assistant", "content": "so."}
    rule = {"role": "system", "content": "rule one"}
    cases = [
        ([ask], [("user", "why?")], ""),
        ([ask, reply, ask], [("user", "why?"), ("assistant", "so."), ("user", "why?")], ""),
        ([rule, ask], [("user", "why?")], "rule one"),
        ([ask, rule, reply, {"role": "system", "content": "rule two"}], [("user", "why?"), ("assistant", "so.")], "rule two"),
        ([rule, {"role": "system", "content": ""}, ask], [("user", "why?")], ""),
        ([{"content": "no role"}], [("", "no role")], ""),
        ([{"role": "user", "content": None}], [("user", "")], ""),
        ([{"role": None, "content": "x"}], [("", "x")], ""),
        ([None, ask], [("", ""), ("user", "why?")], ""),
    ]
    out = _req(spark, [_chat(*m) for m, _, _ in cases])
    for (messages, expect, system), r in zip(cases, out):
        doc = json.loads(r["body"])
        assert [(m["role"], m["content"]) for m in doc["messages"]] == expect, messages
        assert doc.get("system", "") == r["system"] == system and r["n_messages"] == len(expect)
        assert doc["max_tokens"] == r["max_tokens"] == 4096 and r["path"] == "/v1/messages"


def test_translated_fields(spark):
    ask = {"role": "user", "content": "q"}
    full, bare, none, broken = _req(spark, [
        _chat(ask, max_tokens=77, temperature=0.25, top_p=0.5, stream=True), _chat(ask), _chat(), '{"messages": ['])
    assert {k: v for k, v in json.loads(full["body"]).items() if k != "messages"} == {
        "model": "chat-x", "max_tokens": 77, "temperature": 0.25, "top_p": 0.5, "stream": True}
    assert set(json.loads(bare["body"])) == {"model", "messages", "max_tokens"}
    assert json.loads(none["body"]) == {"model": "chat-x", "messages": None, "max_tokens": 4096}
    assert (broken["ok"], broken["body"], broken["path"]) == (False, None, None)


def test_translate_responses(spark):
    def reply(*blocks, stop="end_turn", **usage):
        return json.dumps({"id": "r9", "model": "big-y", "content": list(blocks), "stop_reason": stop, "usage": usage})
    say = lambda t: {"type": "text", "text": t}
    call = {"type": "tool_use", "id": "c1", "name": "f", "input": {"k": 1}}
    cases = [
        (reply(say("one"), input_tokens=31, output_tokens=8), ("one", "stop", 31, 8, 39)),
        (reply(say("one "), call, say("two"), stop="max_tokens", input_tokens=2), ("one two", "length", 2, 0, 2)),
        (reply(call, stop="tool_use", output_tokens=3), ("", "tool_calls", 0, 3, 3)),
        (reply(stop="stop_sequence"), ("", "stop", 0, 0, 0)),
        (reply({"type": "text"}, say("z"), stop="else"), ("z", "stop", 0, 0, 0)),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases] + [("[[",)], "response_body string")
    got = [x["translated"] for x in translate_responses(df).collect()]
    for (_, expect), r in zip(cases, got):
        assert tuple(r[k] for k in ("content", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens")) == expect
        doc = json.loads(r["body"])
        assert doc["choices"][0]["message"] == {"role": "assistant", "content": expect[0]} and doc["id"] == "r9"
    assert got[-1]["ok"] is False and got[-1]["body"] is None


def test_names_that_meet_keep_the_first(spark):
    for prefix_first, expect in ((True, "a"), (False, "b")):
        names, values = ["X-GW-x-gwfoo", "X-GWfoo"], ["a", "b"]
        if not prefix_first:
            names, values = names[::-1], values[::-1]
        df = spark.createDataFrame([(names, values)], "k array<string>, v array<string>").select(
            H.extract_headers(F.map_from_arrays("k", "v")).alias("g"))
        assert df.select(H.custom_metadata(F.col("g")).alias("m")).first()["m"] == {"x-gwfoo": expect}


def test_headers_and_metadata(spark):
    h = {"X-GW-Key": "k", "X-GW-Feature": "chat", "x-gw-feature": "dup", "X-GW-Provider": "openai",
         "X-GW-Provider-Alias": "team", "X-GWfoo": "nodash", "Content-Type": "json"}
    # entry order matters for repeated names: build the map in this order
    df = spark.createDataFrame([(list(h), list(h.values()))], "k array<string>, v array<string>") \
        .select(F.map_from_arrays("k", "v").alias("h"))
    r = df.select(H.extract_headers(F.col("h")).alias("g")).select(
        "g", H.custom_metadata(F.col("g")).alias("m")).first()
    assert r["g"] == {"x-gw-key": "k", "x-gw-feature": "chat", "x-gw-provider": "openai",
                      "x-gw-provider-alias": "team", "x-gwfoo": "nodash"}
    assert r["m"] == {"feature": "chat", "x-gwfoo": "nodash"}


def test_byte_truncation(spark):
    df = spark.createDataFrame([("abc",), ("é" * 10,), ("aé",), (None,)], "b string")
    got = [r[0] for r in df.select(H.truncate_bytes(F.col("b"), 5)).collect()]
    assert got == ["abc", "éé", "aé", None]
    got = [r[0] for r in df.select(H.truncate_bytes(F.col("b"), 2)).collect()]
    assert got == ["ab", "é", "a", None]


def test_error_message_and_keys(spark):
    df = spark.createDataFrame([(500, "x" * 600, "Bearer gwpk_1"), (200, "ok", "sk-1"), (404, "nf", None)],
                               "s int, b string, a string")
    r = df.select(H.error_message(F.col("s"), F.col("b")).alias("e"),
                  H.key_format_ok(H.strip_bearer(F.col("a")), "gwpk_").alias("fmt"),
                  H.hash_key(F.col("a")).alias("h")).collect()
    assert len(r[0]["e"]) == 500 and r[1]["e"] is None and r[2]["e"] == "nf"
    assert [x["fmt"] for x in r] == [True, False, False]
    assert r[2]["h"] is None and len(r[0]["h"]) == 64


def test_body_key_and_response_time(spark):
    df = spark.createDataFrame([("a1b2c3d4-e5f6-7890-abcd-ef0123456789", "rid", 123456)],
                               "k string, r string, us long").withColumn("ts", F.lit("2025-02-04 10:00:00").cast("timestamp"))
    r = df.select(H.body_key(F.col("k"), F.col("r"), F.col("ts")).alias("key"),
                  H.response_time_ms(F.col("us")).alias("ms")).first()
    assert r["key"] == "a1b2c3d4-e5f6-78/2025-02-04/rid.json.gz" and r["ms"] == 123


def test_truncation_covers_every_body(spark):
    from tests.conftest import SF
    from tokenledger.plans.catalog import QUERIES
    from tokenledger.plans import fixtures as FX
    rows = {r.request_id: r for r in QUERIES["truncate_all_bodies"](spark, SF).collect()}
    full = FX.exchanges(spark, SF).select("request_id", "request_body", "response_body").collect()
    assert len(rows) == len(full)
    cut = lambda b: b if b is None else b.encode()[:120].decode(errors="ignore")
    for r in full:
        for kind, body in (("request", cut(r.request_body)), ("response", cut(r.response_body))):
            assert rows[r.request_id][f"{kind}_md5"] == (hashlib.md5(body.encode()).hexdigest() if body is not None else None)
            assert rows[r.request_id][f"{kind}_bytes"] == (len(body.encode()) if body is not None else None)
