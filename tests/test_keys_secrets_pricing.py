import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenledger.functions.secrets import encrypt_secret, parse_key, secret_ok
from tokenledger.operators import keys, pricing

KEY = hashlib.sha256(b"k1").hexdigest()
OTHER = hashlib.sha256(b"k2").hexdigest()


def test_secret_roundtrip(spark):
    df = spark.createDataFrame([("sk-abc",), ("",), ("long-" * 20,), ("üñí",)], "p string")
    e = df.select("p", encrypt_secret(F.col("p"), KEY).alias("e"))
    r = e.select(secret_ok(F.col("e"), KEY).alias("ok"), secret_ok(F.col("e"), OTHER).alias("wrong")).collect()
    assert all(x["ok"] for x in r) and not any(x["wrong"] for x in r)
    a, b = e.select("e").collect()[0][0], e.select("e").collect()[0][0]
    two = spark.createDataFrame([("same",), ("same",)], "p string").select(encrypt_secret(F.col("p"), KEY)).collect()
    assert two[0][0] != two[1][0]           # random nonce
    bad = spark.createDataFrame([("!!notbase64",), ("YWJj",), (a[:-4] + "AAAA",)], "e string")
    assert [x[0] for x in bad.select(secret_ok(F.col("e"), KEY)).collect()] == [False, False, False]


def test_key_parsing():
    import base64
    raw = bytes(range(32))
    assert parse_key(raw.hex()) == raw
    assert parse_key(base64.b64encode(raw).decode()) == raw
    for bad in ["", "abcd", base64.b64encode(b"short").decode()]:
        with pytest.raises(ValueError):
            parse_key(bad)


def _proxy_fixture(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pks = spark.createDataFrame([
        ("pk1", h("gwpk_ok"), "ak1", True, None), ("pk2", h("gwpk_rev"), "ak1", False, "2024-01-01 00:00:00"),
        ("pk3", h("gwpk_inact"), "ak1", False, None), ("pk4", h("gwpk_other"), "ak2", True, None),
        ("pk5", h("gwpk_nomap"), "ak1", True, None)],
        "id string, key_hash string, api_key_id string, is_active boolean, revoked_at string") \
        .withColumn("revoked_at", F.col("revoked_at").cast("timestamp"))
    maps = spark.createDataFrame([("pk1", "openai", "v1"), ("pk1", "anthropic", "v2"), ("pk4", "openai", "v3")],
                                 "proxy_key_id string, provider string, p string")
    maps = maps.select("proxy_key_id", "provider",
                       F.when(F.col("p") == "v2", encrypt_secret(F.col("p"), OTHER))
                       .otherwise(encrypt_secret(F.col("p"), KEY)).alias("encrypted_key"))
    return pks, maps


@pytest.mark.parametrize("auth,provider,status", [
    ("Bearer gwpk_ok", "openai", "ok"), ("Bearer sk-plain", "openai", "passthrough"), (None, "openai", "passthrough"),
    ("Bearer gwpk_missing", "openai", "not_found"), ("Bearer gwpk_rev", "openai", "revoked"),
    ("Bearer gwpk_inact", "openai", "inactive"), ("Bearer gwpk_other", "openai", "wrong_owner"),
    ("Bearer gwpk_nomap", "openai", "no_mapping"), ("Bearer gwpk_ok", "gemini", "no_mapping"),
    ("Bearer gwpk_ok", "anthropic", "decrypt_failed"),
])
def test_proxy_resolution(spark, auth, provider, status):
    pks, maps = _proxy_fixture(spark)
    df = spark.createDataFrame([(auth, provider, "ak1")], "authorization string, provider string, api_key_id string")
    r = keys.resolve_proxy_keys(df, pks, maps, KEY).first()
    assert r["proxy_status"] == status
    assert (r["proxy_key_id"] == "pk1") == (status == "ok")


def test_api_key_resolution(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    aks = spark.createDataFrame([
        ("a1", h("gwsk_1"), "one", True, None, "u1"), ("a2", h("gwsk_2"), "two", False, "2024-01-01 00:00:00", None),
        ("a3", h("gwsk_3"), "three", False, None, None)],
        "id string, key_hash string, name string, is_active boolean, revoked_at string, user_id string") \
        .withColumn("revoked_at", F.col("revoked_at").cast("timestamp"))
    df = spark.createDataFrame([("gwsk_1",), ("gwsk_2",), ("gwsk_3",), ("gwsk_9",), ("",), (None,)], "api_key string")
    r = keys.resolve_api_keys(df, aks).collect()
    assert [x["api_key_status"] for x in r] == ["ok", "revoked", "inactive", "not_found", "missing", "missing"]
    assert r[0]["user_id"] == "u1" and r[1]["user_id"] is None


def test_price_lookup_and_costs(spark):
    prices = spark.createDataFrame([("a", 2.5, 10.0, 1.25), ("b", 1.0, 2.0, 0.0), ("flash", 0.1, 0.2, 0.0)],
                                   "model string, input_price double, output_price double, cached_price double")
    aliases = spark.createDataFrame([("a-2024", "a"), ("flash", "a"), ("chain", "a-2024"), ("to-nothing", "zz")],
                                    "alias string, target string")
    rows = [("a", 1000000, 1000000, 0), ("a-2024", 1000000, 0, 500000), ("flash", 1000000, 0, 0),
            ("chain", 10, 10, 0), ("to-nothing", 10, 10, 0), ("unknown", 10, 10, 0), ("b", 10, 0, 20),
            ("a", 1, 0, 0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                               "k int, model string, input_tokens long, output_tokens long, cached_tokens long")
    r = pricing.request_costs(pricing.lookup_prices(df, prices, aliases)).orderBy("k").collect()
    from decimal import Decimal as D
    assert (r[0]["input_cost"], r[0]["output_cost"], r[0]["total_cost"]) == (D("2.5"), D("10"), D("12.5"))
    assert r[1]["input_cost"] == D("1.875")                         # 0.5M * 2.5 + 0.5M * 1.25
    assert r[2]["input_cost"] == D("0.1")                           # exact name beats alias
    assert [x["model_alias_found"] for x in r[3:6]] == [False, False, False]   # no chains; unpriced
    assert r[3]["total_cost"] == D("0")
    assert r[6]["input_cost"] == D("-0.00001")                      # cached > input: negative, as the gateway
    assert r[7]["input_cost"] == D("0.00000250")                    # rounding at the 8th decimal


def test_price_versions_as_of(spark):
    from tokenledger.sources import prices as price_src
    prices = spark.createDataFrame([("a", 2.0, 4.0, 0.0)],
                                   "model string, input_price double, output_price double, cached_price double")
    versions = price_src.price_versions(spark, prices)
    aliases = spark.createDataFrame([("a1", "a")], "alias string, target string")
    df = spark.createDataFrame([("a", "2024-01-10 00:00:00"), ("a1", "2024-01-15 00:00:00"), ("a", "2023-12-31 00:00:00")],
                               "model string, requested_at string").withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    r = pricing.reprice_as_of(df, versions, aliases).collect()
    assert [x["price"]["input_price"] if x["price"] else None for x in r] == [2.0, 4.0, None]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_hourly_price_versions_meet_a_row_by_day(spark, bound):
    """A year of hourly versions: each row meets those of its day only, and
    finds the one that a walk over all versions finds."""
    from dataclasses import replace
    from datetime import datetime, timedelta
    from tokenledger.config import DEFAULT
    start = datetime(2024, 1, 1)
    begins = [datetime(1900, 5, 1)] + [start + timedelta(hours=h) for h in range(8_760)]
    versions = [("hourly", b, float(k), 1.0, 0.0) for k, b in enumerate(begins)]
    versions += [("fixed", datetime(1, 1, 1), 7.0, 1.0, 0.0), ("late", datetime(2024, 6, 1, 12, 30), 9.0, 1.0, 0.0),
                 (None, start, 5.0, 1.0, 0.0), ("null", None, 5.0, 1.0, 0.0)]
    schema = "model string, effective_from timestamp, input_price double, output_price double, cached_price double"
    table = spark.createDataFrame(versions, schema)
    aliases = spark.createDataFrame([("h", "hourly"), ("x", "h")], "alias string, target string")
    rng = random.Random(2)
    at = [datetime(1800, 1, 1), datetime(1900, 5, 1), start, start - timedelta(microseconds=1), datetime(2030, 1, 1), None]
    at += [start + timedelta(seconds=rng.randrange(-10 ** 6, 33 * 10 ** 6)) for _ in range(300)]
    facts = [(k, m, t) for k, (m, t) in enumerate((m, t) for t in at for m in ("hourly", "h", "x", "fixed", "late", "null", None))]
    df = spark.createDataFrame(facts, "k int, model string, requested_at timestamp")

    def want(model, t):
        name = "hourly" if model == "h" else model
        held = [(v[1], v[2]) for v in versions if v[0] == name and name and v[1] and t and v[1] <= t]
        return max(held)[1] if held else None

    got = pricing.reprice_as_of(df, table, aliases, cfg=replace(DEFAULT, dim_broadcast_bytes=bound))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (bound > 0)
    found = {r.k: r.price and r.price.input_price for r in got.collect()}
    assert len(found) == len(facts) and all(found[k] == want(m, t) for k, m, t in facts)
    intervals = pricing.one_price(table, "effective_from").selectExpr(
        "model as name", "effective_from as valid_from",
        "lead(effective_from) over (partition by model order by effective_from) as valid_to", "price")
    cut, _, most = pricing.version_days(intervals)
    per_day = cut.groupBy("name", "day").count()
    assert per_day.agg(F.max("count")).first()[0] <= 26 and cut.count() <= most < 12_000


def test_no_price_versions_price_nothing(spark):
    none = spark.createDataFrame([], "model string, effective_from timestamp, input_price double, output_price double, cached_price double")
    df = spark.sql("select 'a' as model, timestamp '2024-01-01' as requested_at union all select null, null")
    aliases = spark.createDataFrame([], "alias string, target string")
    assert [r.price for r in pricing.reprice_as_of(df, none, aliases).collect()] == [None, None]


def test_no_key_in_plans_of_a_plain_session(spark):
    key = "0123456789abcdef" * 4
    spark.conf.unset("spark.sql.redaction.string.regex")
    for rule in (None, "topsecret"):
        if rule:
            spark.conf.set("spark.sql.redaction.string.regex", rule)
        df = spark.range(1).selectExpr("'topsecret' as s").select(encrypt_secret(F.col("s"), key), secret_ok(F.col("s"), key))
        text = df._jdf.queryExecution().toString().lower()
        assert key not in text and "redacted" in text
        assert ("topsecret" in text) is (rule is None)
    spark.conf.unset("spark.sql.redaction.string.regex")
