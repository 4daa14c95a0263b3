import datetime as dt

from pyspark.sql import functions as F

from tokenledger.functions import secrets as S
from tokenledger.operators import key_usage, keys, maintenance, pricing, quality
from tokenledger.plans import fixtures as FX
from tests.conftest import SF


def test_usage_is_counted_and_folded_in(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    used = spark.createDataFrame([("a", "ok", t(1)), ("a", "ok", t(5)), ("b", "revoked", t(2)), ("c", "ok", t(3))],
                                 "api_key_id string, api_key_status string, requested_at timestamp")
    u = key_usage.api_key_usage(used)
    table = spark.createDataFrame([("a", 10, t(9)), ("b", 1, None), ("d", None, None), ("c", 0, None)],
                                  "id string, request_count bigint, last_used_at timestamp")
    got = {r.id: (r.request_count, r.last_used_at) for r in key_usage.apply_usage(table, u, "api_key_id").collect()}
    assert got == {"a": (12, t(9)), "b": (1, None), "d": (0, None), "c": (1, t(3))}


def test_price_lists_of_any_length_and_with_repeats(spark):
    n = 60_000
    prices = spark.range(n).selectExpr("concat('m', id) as model", "double(id) as input_price", "1D as output_price",
                                       "0D as cached_price")
    prices = prices.union(prices.where("model = 'm7'").withColumn("input_price", F.lit(100.0)))
    prices = prices.union(spark.sql("select cast(null as string), 1D, 1D, 1D"))
    aliases = spark.createDataFrame([("x", "m5"), ("x", "m4"), ("m3", "m9"), ("y", "x"), (None, "m1")],
                                    "alias string, target string")
    facts = spark.createDataFrame([("m7",), ("m59999",), ("x",), ("m3",), ("y",), (None,), ("zz",)], "model string")
    got = {r.model: r.price and r.price.input_price for r in pricing.lookup_prices(facts, prices, aliases).collect()}
    assert got == {"m7": 100.0, "m59999": 59999.0, "x": 5.0, "m3": 3.0, "y": None, None: None, "zz": None}
    versions = prices.withColumn("effective_from", F.lit("2024-01-01").cast("timestamp"))
    at = facts.withColumn("requested_at", F.lit("2024-02-01").cast("timestamp"))
    got = [r.price and r.price.input_price for r in pricing.reprice_as_of(at, versions, aliases).orderBy("model").collect()]
    assert len(got) == 7 and sorted(x for x in got if x is not None) == [3.0, 5.0, 100.0, 59999.0]


def test_empty_provider_key_sets_no_id(spark):
    owner, pk = "ak1", "pk1"
    proxy = spark.createDataFrame([(pk, owner, True, None)], "id string, api_key_id string, is_active boolean, revoked_at timestamp") \
        .withColumn("key_hash", F.sha2(F.lit("gwpk_1"), 256))
    plain = spark.createDataFrame([("openai", "sk-1"), ("gemini", "")], "provider string, plain string")
    maps = plain.select(F.lit(pk).alias("proxy_key_id"), "provider",
                        S.encrypt_secret(F.col("plain"), FX.FIXTURE_SECRET).alias("encrypted_key"))
    maps = maps.union(maps.where("provider = 'openai'"))     # a repeated row does not fail the job
    facts = spark.createDataFrame([(1, "Bearer gwpk_1", p, owner) for p in ("openai", "gemini", "azure")],
                                  "request_id long, authorization string, provider string, api_key_id string")
    got = {r.provider: (r.proxy_status, r.proxy_key_id)
           for r in keys.resolve_proxy_keys(facts, proxy, maps, FX.FIXTURE_SECRET).collect()}
    assert got == {"openai": ("ok", pk), "gemini": ("ok", None), "azure": ("no_mapping", None)}


def test_encryption_key_is_in_no_column_name(spark):
    df = spark.createDataFrame([("x",)], "c string").select(S.encrypt_secret(F.col("c"), FX.FIXTURE_SECRET),
                                                            S.secret_ok(F.col("c"), FX.FIXTURE_SECRET))
    assert df.columns == ["encrypted", "decryptable"]


def _log_row(**change):
    row = dict(provider="openai", model="m", provider_api_key_alias=None, provider_api_key_hash=None, request_path="/p",
               request_method="POST", requested_at=dt.datetime(2024, 1, 1), responded_at=dt.datetime(2024, 1, 1),
               response_time_ms=1, input_tokens=1, output_tokens=1, cached_tokens=None, cache_creation_tokens=None,
               input_cost=1.0, output_cost=1.0, total_cost=1.0, status_code=200, error_message=None, raw_metadata={})
    return row | change


def test_every_reject_reason(spark):
    cases = [({}, None)]
    cases += [({c: None}, "not_null") for c in quality.REQUIRED]
    cases += [({"model": "m" * 101}, "model_too_long"), ({"provider": "p" * 101}, "provider_too_long"),
              ({"input_tokens": 1 << 31}, "input_tokens_out_of_range"), ({"response_time_ms": 1 << 31}, "response_time_ms_out_of_range"),
              ({"total_cost": None}, "numeric_overflow"), ({"error_message": "a\0b"}, "nul_in_text"),
              ({"raw_metadata": {"k": "\0"}}, "nul_in_text")]
    schema = ("provider string, model string, provider_api_key_alias string, provider_api_key_hash string, request_path string, "
              "request_method string, requested_at timestamp, responded_at timestamp, response_time_ms bigint, input_tokens bigint, "
              "output_tokens bigint, cached_tokens bigint, cache_creation_tokens bigint, input_cost double, output_cost double, "
              "total_cost double, status_code int, error_message string, raw_metadata map<string,string>, n int")
    names = [c.strip().split()[0] for c in schema.split(", ")]
    rows = [tuple((_log_row(**c) | {"n": k})[name] for name in names) for k, (c, _) in enumerate(cases)]
    got = {r.n: r.reject_reason for r in quality.with_reject_reason(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: reason for k, (_, reason) in enumerate(cases)}
    bad = spark.createDataFrame([tuple((_log_row() | {"n": 0})[name] for name in names)], schema) \
        .withColumn("error_message", F.unhex(F.lit("61FF")).cast("string"))
    assert quality.with_reject_reason(bad).first().reject_reason == "invalid_utf8"


def test_unreadable_lines_become_rejects(spark, tmp_path):
    from tokenledger.plans import enrich
    from tokenledger.sources import bodies
    (tmp_path / "lines.json").write_text('{"request_id": "r1", "status_code": 200\n{"request_id": "r2"}\n')
    schema = bodies.T.StructType(bodies.EXCHANGE_SCHEMA.fields + [bodies.T.StructField(quality.CORRUPT, bodies.T.StringType())])
    ex = spark.read.schema(schema).option("columnNameOfCorruptRecord", quality.CORRUPT).json(str(tmp_path)).cache()
    rows = enrich.enrich_requests(ex, FX.load_dims(spark, SF)).collect()
    assert [(r.reject_reason, r.error_message) for r in rows] == [("corrupt_record", '{"request_id": "r1", "status_code": 200')]


def test_maintenance_limits_and_ties(spark):
    table = spark.createDataFrame([("a", "k", True)], "api_key_id string, key_name string, is_active boolean")
    seen = spark.createDataFrame([("a", "n" * 255), ("a", "n" * 256), ("a", "k")], "api_key_id string, key_name string")
    out = maintenance.register_metadata_keys(table, seen)
    assert sorted(len(r.key_name) for r in out.collect()) == [1, 255]
    assert [(len(r.key_name), r.reason) for r in maintenance.refused_metadata_keys(seen).collect()] == [(256, "key_name_too_long")]
    stored = spark.createDataFrame([], "id string, key_hash string, name string, is_active boolean, request_count bigint")
    new = spark.createDataFrame([("i2", "h", "n", 1), ("i1", "h", "n", 1)], "id string, key_hash string, name string, seq int")
    _, status = maintenance.create_keys(stored, new)
    assert {r.id: r.status for r in status.collect()} == {"i1": "created", "i2": "duplicate_in_batch"}
    proxy = spark.createDataFrame([("p1", True, None), ("p2", False, None)], "id string, is_active boolean, revoked_at timestamp")
    ids = spark.createDataFrame([("p1",), ("p2",), ("p9",)], "id string")
    got = {r.id: r.status for r in maintenance.revoke_keys(proxy, ids, F.current_timestamp()).collect()}
    assert got == {"p1": "revoked", "p2": "not_found", "p9": "not_found"}


def test_sql_reports_equal_the_operators(spark):
    from tokenledger.plans import views
    from tokenledger.plans.catalog import QUERIES, log_table
    views.register_views(spark, log_table(spark, SF), FX.load_dims(spark, SF))
    assert "encrypted_key" not in spark.table("provider_mappings").columns
    for name, sql in views.REPORTS.items():
        mine, text = QUERIES[name](spark, SF), spark.sql(sql)
        key = lambda r: sorted((c, str(r[c])) for c in mine.columns)
        assert sorted(map(key, mine.collect())) == sorted(map(key, text.select(*mine.columns).collect())), name


def test_point_reads_skip_row_groups(spark):
    from tokenledger.plans.catalog import log_table
    log = log_table(spark, SF).where("requested_date = '2024-01-10' and api_key_id = 'x'")
    plan = log._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(requested_date" in plan and "EqualTo(api_key_id,x)" in plan
