"""
DuckDB oracle SQL. ``__spark_entry__`` exposes both.

Every query reads the driver's tables (or data Spark derives from them) at
full size: exchanges come from all of ``events``, dimensions from all of
``customer``, translator inputs from all of ``conversations``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.config import LedgerConfig
from tokenledger.functions import headers as H
from tokenledger.functions import providers as P
from tokenledger.functions import secrets as S
from tokenledger.operators import analytics as A
from tokenledger.operators import keys, pricing, quality, usage
from tokenledger.plans import enrich, views
from tokenledger.plans import fixtures as FX
from tokenledger.plans.oracle import LOG_SELECT, uuid_sql, with_base
from tokenledger.session import scratch_path
from tokenledger.sources import request_log as log_io
from tokenledger.sources.log_index import LogIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- shared inputs ---------------------------------------------------------

def _inputs(spark: SparkSession, sf: str, cfg: LedgerConfig | None = None):
    cfg = cfg or LedgerConfig()
    return FX.exchanges(spark, sf, cfg), FX.load_dims(spark, sf, cfg), cfg


def full_log(spark: SparkSession, sf: str) -> DataFrame:
    """J8 output incl. rejected rows (bigint counts, reject_reason), as a plan."""
    ex, dims, cfg = _inputs(spark, sf)
    return enrich.enrich_requests(ex, dims, cfg)


_LOGS: dict[tuple[str, str], str] = {}


def materialized_log(spark: SparkSession, sf: str) -> DataFrame:
    """The request log written once per application and input (S7), read back.

    The ETL (J8) runs once; every analytics query then plans against a
    Parquet table partitioned by date, as in production.
    """
    key = (spark.sparkContext.applicationId, sf)
    path = _LOGS.get(key)
    if path is None:
        path = scratch_path(spark, "request-log")
        log_io.write_request_log(full_log(spark, sf), path, mode="overwrite")
        _LOGS[key] = path
    return log_io.read_request_log(spark, path)


_INDEXES: dict[tuple[str, str], LogIndex] = {}


def log_index(spark: SparkSession, sf: str) -> LogIndex:
    """The index kept with the materialised log, built once with it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        materialized_log(spark, sf)
        _INDEXES[key] = LogIndex(spark, _LOGS[key], scratch_path(spark, "log-index"))
    _INDEXES[key].update()
    return _INDEXES[key]


def log_table(spark: SparkSession, sf: str) -> DataFrame:
    """The rows the log table keeps (Q1 ok side)."""
    return log_io.accepted(materialized_log(spark, sf))


PK_FOR_A8 = 1       # proxy key (customer number) used by A8
API_KEY_FOR_F3 = 1  # API key (customer number) used by F3
USER_FOR_L2 = "u5"
KEY_FOR_L3 = 8
BODY_EVENT = 12     # request of this event for A10


def _ak(i: int) -> str:
    import hashlib
    h = hashlib.md5(f"ak-{i}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def _pk(i: int) -> str:
    import hashlib
    h = hashlib.md5(f"pk-{i}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def _req_id(event_id: int) -> str:
    import hashlib
    return hashlib.md5(f"req-{event_id}".encode()).hexdigest()


# --- J8, Q1 and the documented analytics -----------------------------------

WIDE_LOG = LOG_SELECT.replace("CAST(response_time_ms AS INTEGER) AS response_time_ms", "response_time_ms") \
    .replace("CAST(input_tokens AS INTEGER) AS input_tokens", "input_tokens") \
    .replace("CAST(output_tokens AS INTEGER) AS output_tokens", "output_tokens") \
    .replace("CAST(cached_tokens AS INTEGER) AS cached_tokens", "cached_tokens") \
    .replace("CAST(cache_creation_tokens AS INTEGER) AS cache_creation_tokens", "cache_creation_tokens")


@register("enrich_requests", with_base(f"SELECT {WIDE_LOG}, reject_reason FROM req_all"))
def q_enrich_requests(spark, sf):
    """The whole pipeline, every loggable exchange with its reject reason."""
    return A.comparable_log(materialized_log(spark, sf))


@register("rejected_rows", with_base("SELECT id, reject_reason FROM req_all WHERE reject_reason IS NOT NULL"))
def q_rejected_rows(spark, sf):
    """Q1: rows the log table would refuse, with the first broken rule."""
    return log_io.rejected(materialized_log(spark, sf)).select("id", "reject_reason")


@register("spend_by_model", with_base(
    "SELECT model, COUNT(*) AS requests, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost "
    "FROM req GROUP BY model ORDER BY total_cost DESC, model"))
def q_spend_by_model(spark, sf):
    """A1 (flagship)."""
    return A.spend_by_model(log_table(spark, sf))


@register("daily_spend", with_base(
    "SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost "
    "FROM req GROUP BY 1 ORDER BY date DESC LIMIT 30"))
def q_daily_spend(spark, sf):
    """A2."""
    return A.daily_spend(log_table(spark, sf))


@register("spend_by_api_key", with_base(
    "SELECT c.c_name AS key_name, COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost "
    "FROM req JOIN cust c ON c.i = req.event_user GROUP BY req.api_key_id, c.c_name ORDER BY total_cost DESC"))
def q_spend_by_api_key(spark, sf):
    """A3."""
    return A.spend_by_api_key(log_table(spark, sf), FX.api_keys(spark, sf))


@register("spend_by_metadata", with_base(
    "SELECT CAST(event_user AS VARCHAR) AS user_id, COUNT(*) AS requests, "
    "CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost FROM req WHERE event_id % 10 <> 9 GROUP BY 1"))
def q_spend_by_metadata(spark, sf):
    """A4: by the user-id metadata value."""
    return A.spend_by_metadata(log_table(spark, sf), "user-id", "user_id")


@register("user_cost_in_feature", with_base(
    "SELECT CASE WHEN event_id % 10 <> 9 THEN CAST(event_user AS VARCHAR) END AS user_id, COUNT(*) AS requests, "
    "CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost FROM req WHERE event_type = 'purchase' GROUP BY 1"))
def q_user_cost_in_feature(spark, sf):
    """A5: per user within feature 'purchase' (null user kept)."""
    return A.user_cost_in_feature(log_table(spark, sf), "purchase")


@register("cost_by_step", with_base(
    "SELECT 's' || (k % 4) AS step, CAST(SUM(total_cost) / COUNT(*) AS DECIMAL(38,6)) AS avg_cost, "
    "CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost FROM req WHERE event_type = 'click' GROUP BY 1"))
def q_cost_by_step(spark, sf):
    """Steps within feature 'click'."""
    return A.cost_by_step(log_table(spark, sf), "click")


@register("spend_by_proxy_key", with_base(
    "SELECT 'proxy-' || (CASE WHEN event_id % 13 = 0 THEN event_user + 1 ELSE event_user END) AS proxy_key_name, "
    "COUNT(*) AS requests, CAST(SUM(total_cost) AS DECIMAL(38,8)) AS total_cost "
    "FROM req WHERE proxy_key_id IS NOT NULL GROUP BY proxy_key_id, 1"))
def q_spend_by_proxy_key(spark, sf):
    """A7."""
    return A.spend_by_proxy_key(log_table(spark, sf), FX.proxy_keys(spark, sf))


@register("recent_by_proxy_key", with_base(
    f"SELECT model, CAST(input_tokens AS INTEGER) AS input_tokens, CAST(output_tokens AS INTEGER) AS output_tokens, "
    f"total_cost, requested_at FROM req WHERE proxy_key_id = '{_pk(PK_FOR_A8)}' "
    f"ORDER BY requested_at DESC, id DESC LIMIT 10"))
def q_recent_by_proxy_key(spark, sf):
    """10 newest rows of one proxy key."""
    key = _pk(PK_FOR_A8)
    return A.recent_by_proxy_key(log_index(spark, sf).newest_of_proxy_key(key, 10), key, 10)


@register("latest_request", with_base(
    "SELECT model, CAST(input_tokens AS INTEGER) AS input_tokens, CAST(output_tokens AS INTEGER) AS output_tokens, "
    "total_cost FROM req ORDER BY created_at DESC, id DESC LIMIT 1"))
def q_latest_request(spark, sf):
    """The newest row, from the files that can hold it."""
    return A.latest_request(log_index(spark, sf).newest(1))


@register("body_pointer", with_base(f"SELECT id, body_s3_key FROM req WHERE id = '{_req_id(BODY_EVENT)}'"))
def q_body_pointer(spark, sf):
    """A10: by the index of request ids."""
    request_id = _req_id(BODY_EVENT)
    return A.body_pointer(log_index(spark, sf).request(request_id), request_id)


@register("unpriced_models", with_base(
    "SELECT model, COUNT(*) AS requests, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, MIN(requested_at) AS first_seen, "
    "MAX(requested_at) AS last_seen FROM req WHERE NOT model_alias_found GROUP BY model"))
def q_unpriced_models(spark, sf):
    """A11."""
    return A.unpriced_models(log_table(spark, sf))


@register("metadata_contains", with_base(
    "SELECT id, model, total_cost FROM req WHERE event_type = 'purchase' AND event_user % 2 = 0"))
def q_metadata_contains(spark, sf):
    """indexed_metadata @> {feature: purchase}."""
    wanted = {"feature": "purchase"}
    return A.metadata_contains(log_index(spark, sf).containing(wanted), wanted).select("id", "model", "total_cost")


@register("requests_in_range", with_base(
    f"SELECT id, requested_at, total_cost FROM req WHERE api_key_id = '{_ak(API_KEY_FOR_F3)}' "
    f"AND requested_at >= TIMESTAMP '2024-01-05' AND requested_at < TIMESTAMP '2024-01-20' ORDER BY requested_at DESC"))
def q_requests_in_range(spark, sf):
    """one API key, a time range, newest first."""
    return A.requests_in_range(log_table(spark, sf), "api_key_id", _ak(API_KEY_FOR_F3), "2024-01-05", "2024-01-20") \
        .select("id", "requested_at", "total_cost")


@register("requests_of_user", with_base(
    "SELECT id, requested_at, total_cost FROM req WHERE user_id = 'u1' "
    "AND requested_at >= TIMESTAMP '2024-01-05' AND requested_at < TIMESTAMP '2024-01-20'"))
def q_requests_of_user(spark, sf):
    """F3 by user."""
    return A.requests_in_range(log_table(spark, sf), "user_id", "u1", "2024-01-05", "2024-01-20") \
        .select("id", "requested_at", "total_cost")


@register("requests_of_provider_key", with_base(
    "SELECT id, requested_at, total_cost FROM req WHERE provider_api_key_hash = sha256('Bearer sk-1') "
    "AND requested_at >= TIMESTAMP '2024-01-05' AND requested_at < TIMESTAMP '2024-01-20'"))
def q_requests_of_provider_key(spark, sf):
    """F3 by provider key hash."""
    import hashlib
    wanted = hashlib.sha256(b"Bearer sk-1").hexdigest()
    return A.requests_in_range(log_table(spark, sf), "provider_api_key_hash", wanted, "2024-01-05", "2024-01-20") \
        .select("id", "requested_at", "total_cost")


# --- the documented reports as SQL text over the views ---------------------

def _register_sql(name: str, text: str, args: dict[str, str]) -> None:
    @register(f"sql_{name}", ORACLE[name])
    def statement(spark, sf):
        views.register_views(spark, log_table(spark, sf), FX.load_dims(spark, sf), FX.users(spark, sf))
        return spark.sql(text, args)


for _name, _text in {**views.REPORTS, **views.LOOKUPS}.items():
    _register_sql(_name, _text, {"recent_by_proxy_key": {"proxy_key_id": _pk(PK_FOR_A8)},
                                 "body_pointer": {"request_id": _req_id(BODY_EVENT)}}.get(_name, {}))


# --- joins -----------------------------------------------------------------

def _resolved(spark, sf):
    ex, dims, cfg = _inputs(spark, sf)
    return enrich.resolve(ex, dims, cfg)


def _api_keys_resolved(spark, sf):
    ex, dims, cfg = _inputs(spark, sf)
    return keys.resolve_api_keys(enrich.prepare(ex, cfg), dims.api_keys, "api_key", cfg=cfg)


@register("resolve_api_keys", with_base(
    f"SELECT request_id, api_key_status, CASE WHEN api_key_status <> 'not_found' THEN {uuid_sql(chr(39) + 'ak-' + chr(39) + ' || user_id')} END AS api_key_id FROM res"))
def q_resolve_api_keys(spark, sf):
    """Status of every exchange's gateway key."""
    return _api_keys_resolved(spark, sf).select("request_id", "api_key_status", "api_key_id")


@register("resolve_proxy_keys", with_base(
    f"SELECT request_id, proxy_status, CASE WHEN proxy_status = 'ok' THEN {uuid_sql(chr(39) + 'pk-' + chr(39) + ' || proxy_j')} END AS proxy_key_id FROM res"))
def q_resolve_proxy_keys(spark, sf):
    """Proxy-key status of every exchange (checked in the gateway's order)."""
    return _resolved(spark, sf).select("request_id", "proxy_status", "proxy_key_id")


@register("loggable_requests", with_base(
    "SELECT request_id, detected AS provider_detected FROM res "
    "WHERE api_key_status = 'ok' AND proxy_status IN ('ok', 'passthrough') AND status_code IS NOT NULL"))
def q_loggable_requests(spark, sf):
    """F1."""
    return quality.loggable(_resolved(spark, sf)).select("request_id", "provider_detected")


@register("lookup_prices", with_base(
    "SELECT request_id AS id, log_model AS model, input_price, output_price, cached_price, model_alias_found "
    "FROM priced"))
def q_lookup_prices(spark, sf):
    """Exact name, else one alias hop."""
    ex, dims, cfg = _inputs(spark, sf)
    df = quality.loggable(enrich.resolve(ex, dims, cfg))
    df = usage.usage_metrics(df, provider="provider_detected").withColumn("model", F.col("usage.model"))
    df = pricing.lookup_prices(df, dims.prices, dims.aliases, "model", cfg)
    return df.select(F.col("request_id").alias("id"), "model", F.col("price.input_price").alias("input_price"),
                     F.col("price.output_price").alias("output_price"),
                     F.col("price.cached_price").alias("cached_price"), "model_alias_found")


@register("request_costs", with_base("SELECT id, input_cost, output_cost, total_cost FROM req_all"))
def q_request_costs(spark, sf):
    """J4."""
    return full_log(spark, sf).select("id", "input_cost", "output_cost", "total_cost")


@register("split_metadata", with_base("SELECT id, indexed_metadata FROM req_all"))
def q_split_metadata(spark, sf):
    """Only active metadata keys are indexed."""
    return full_log(spark, sf).select("id", A.map_text(F.col("indexed_metadata")).alias("indexed_metadata"))


@register("reprice_as_of", with_base(
    "SELECT id, model, TRY_CAST(CAST(COALESCE(CAST(input_tokens - cached_tokens AS DOUBLE) * (input_price * f) / 1000000.0 "
    "+ CAST(cached_tokens AS DOUBLE) * (cached_price * f) / 1000000.0 "
    "+ CAST(output_tokens AS DOUBLE) * (output_price * f) / 1000000.0, 0.0) AS VARCHAR) AS DECIMAL(12,8)) AS total_cost "
    "FROM (SELECT request_id AS id, log_model AS model, input_tokens, cached_tokens, output_tokens, input_price, "
    "cached_price, output_price, CASE WHEN requested_at >= TIMESTAMP '2024-01-15' THEN 2.0 ELSE 1.0 END AS f "
    "FROM priced)"))
def q_reprice_as_of(spark, sf):
    """Cost with the price version in force at request time."""
    from tokenledger.sources import prices as price_src
    ex, dims, cfg = _inputs(spark, sf)
    df = quality.loggable(enrich.resolve(ex, dims, cfg))
    df = usage.usage_metrics(df, provider="provider_detected").withColumn("model", F.col("usage.model"))
    versions = price_src.price_versions(spark, dims.prices)
    df = pricing.reprice_as_of(df, versions, dims.aliases, "model", "requested_at", cfg)
    cost = pricing.cost_columns(F.col("usage.input"), F.col("usage.output"), F.col("usage.cached"), F.col("price"))
    return df.select(F.col("request_id").alias("id"), "model", cost[2])


@register("owned_proxy_keys", """
SELECT """ + uuid_sql("'pk-' || p.c_custkey") + """ AS proxy_key_id, 'proxy-' || p.c_custkey AS proxy_key_name,
  """ + uuid_sql("'ak-' || p.c_custkey") + """ AS api_key_id, 'u' || (p.c_custkey // 3) AS user_id,
  lower(replace(u.c_name, '#', '-')) AS username, p.c_name AS api_key_name, p.c_custkey % 8 NOT IN (4, 5) AS proxy_key_active
FROM customer p JOIN customer u ON u.c_custkey = p.c_custkey // 3
WHERE p.c_custkey % 10 <> 6""")
def q_owned_proxy_keys(spark, sf):
    """User -> API key -> proxy key ownership chain."""
    return keys.owned_proxy_keys(FX.users(spark, sf), FX.api_keys(spark, sf), FX.proxy_keys(spark, sf))


# --- row transforms over every exchange ------------------------------------

def _prepared(spark, sf):
    ex, _, cfg = _inputs(spark, sf)
    return ex, enrich.prepare(ex, cfg), cfg


GW_HEADERS_SQL = """array_to_string(list_sort(list_filter([
  'x-gw-key=gwsk_' || user_id,
  CASE WHEN event_id % 10 <> 9 THEN 'x-gw-user-id=' || user_id END,
  'x-gw-feature=' || event_type,
  'x-gw-step=s' || (k % 4),
  'x-gw-environment=' || CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END,
  CASE WHEN r = 1 THEN 'x-gw-provider-alias=team-' || (user_id % 3) END,
  CASE WHEN r = 4 THEN 'x-gw-provider=Anthropic-OpenAI' WHEN r = 5 AND event_id % 12 = 11 THEN 'x-gw-provider=Bedrock' END
], lambda x: x IS NOT NULL)), ';')"""
META_SQL = """array_to_string(list_sort(list_filter([
  CASE WHEN event_id % 10 <> 9 THEN 'user-id=' || user_id END,
  'feature=' || event_type, 'step=s' || (k % 4),
  'environment=' || CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END
], lambda x: x IS NOT NULL)), ';')"""


@register("gateway_headers", with_base(
    f"SELECT request_id, {GW_HEADERS_SQL} AS gw_headers, {META_SQL} AS metadata FROM ev2"))
def q_gateway_headers(spark, sf):
    """P1 + P2: gateway headers (lower-cased, others dropped) and custom metadata."""
    _, d, cfg = _prepared(spark, sf)
    return d.select("request_id", A.map_text(F.col("gw_headers")).alias("gw_headers"),
                    A.map_text(H.custom_metadata(F.col("gw_headers"), cfg)).alias("metadata"))


BASE_URL_SQL = ("CASE detected WHEN 'openai' THEN 'https://api.openai.com' WHEN 'anthropic' THEN 'https://api.anthropic.com' "
                "WHEN 'gemini' THEN 'https://generativelanguage.googleapis.com' "
                "WHEN 'anthropic-openai' THEN 'https://api.anthropic.com' ELSE '' END")


@register("detect_provider", with_base(f"SELECT request_id, detected AS provider, {BASE_URL_SQL} AS base_url FROM ev2"))
def q_detect_provider(spark, sf):
    """Explicit header first, else path rules, else openai."""
    _, d, _ = _prepared(spark, sf)
    return d.select("request_id", F.col("prov.provider").alias("provider"), F.col("prov.base_url").alias("base_url"))


@register("extract_model", with_base(
    "SELECT request_id, CASE WHEN event_id % 89 = 0 THEN 'unknown' ELSE model END AS model FROM ev2"))
def q_extract_model(spark, sf):
    """Model of the request body ('unknown' when undecodable or empty)."""
    ex, _, _ = _inputs(spark, sf)
    return usage.request_models(ex.select("request_id", "request_body")).select("request_id", "model")


def _parser_sql(rs: str, inp: str, cached: str, creation: str) -> str:
    return with_base(
        "SELECT request_id, kind <> 'malformed' AS ok, "
        "CASE WHEN kind = 'normal' AND k % 5 <> 0 THEN model ELSE '' END AS model, "
        f"CASE WHEN kind = 'normal' THEN {inp} ELSE CAST(0 AS BIGINT) END AS input, "
        "CASE WHEN kind = 'normal' THEN tout ELSE CAST(0 AS BIGINT) END AS output, "
        f"CASE WHEN kind = 'normal' THEN {cached} ELSE CAST(0 AS BIGINT) END AS cached, "
        f"CASE WHEN kind = 'normal' THEN {creation} ELSE CAST(0 AS BIGINT) END AS creation "
        f"FROM lg0 WHERE r IN ({rs})")


def _parse_query(spark, sf, providers: list[str], parser: str):
    _, d, _ = _prepared(spark, sf)
    d = d.where(F.col("status_code").isNotNull() & F.col("prov.provider").isin(providers))
    d = usage.parse_usage(d, parser, out="_usage")
    u = F.col("_usage")
    return d.select("request_id", u["ok"].alias("ok"), u["model"].alias("model"), u["input"].alias("input"),
                    u["output"].alias("output"), u["cached"].alias("cached"), u["creation"].alias("creation"))


@register("parse_usage_openai", _parser_sql("0, 1, 5", "tin", "cached", "CAST(0 AS BIGINT)"))
def q_parse_usage_openai(spark, sf):
    """P5: Chat and Responses usage; Responses fields win when they report tokens."""
    return _parse_query(spark, sf, ["openai", "azure", "gemini-openai", "bedrock", "unknown"], "openai")


@register("parse_usage_anthropic", _parser_sql("2, 4", "tin + creation", "cached", "creation"))
def q_parse_usage_anthropic(spark, sf):
    """Input normalised to include cache reads and creation."""
    return _parse_query(spark, sf, ["anthropic", "anthropic-openai"], "anthropic")


@register("parse_usage_gemini", _parser_sql("3", "tin", "cached", "CAST(0 AS BIGINT)"))
def q_parse_usage_gemini(spark, sf):
    """usageMetadata counts, model from modelVersion."""
    return _parse_query(spark, sf, ["gemini"], "gemini")


@register("usage_metrics", with_base(
    "SELECT request_id, parse_ok AS ok, provider, log_model AS model, input_tokens, output_tokens, cached_tokens, "
    "cache_creation_tokens FROM us_all"))
def q_usage_metrics(spark, sf):
    """Parser dispatch, translation of anthropic-openai responses, fallbacks."""
    _, d, _ = _prepared(spark, sf)
    d = d.where(F.col("status_code").isNotNull()).withColumn("provider_detected", F.col("prov.provider"))
    u = usage.usage_metrics(d, provider="provider_detected")
    return u.select("request_id", F.col("usage.ok").alias("ok"), F.col("usage.provider").alias("provider"),
                    F.col("usage.model").alias("model"), F.col("usage.input").alias("input_tokens"),
                    F.col("usage.output").alias("output_tokens"), F.col("usage.cached").alias("cached_tokens"),
                    F.col("usage.creation").alias("cache_creation_tokens"))


@register("translate_requests", """
SELECT conv_id, TRUE AS ok, '/v1/messages' AS path,
  COALESCE(arg_max(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END), '') AS system,
  CAST(COUNT(*) FILTER (WHERE role <> 'system') AS INTEGER) AS n_messages,
  CASE WHEN conv_id % 2 = 0 THEN 256 + conv_id ELSE 4096 END AS max_tokens,
  md5(COALESCE(string_agg(CASE WHEN role <> 'system' THEN role || ':' || text END, chr(10) ORDER BY turn), '')) AS messages_md5
FROM conversations GROUP BY conv_id""")
def q_translate_requests(spark, sf):
    """P9 over chat requests built from every conversation."""
    from tokenledger.plans.conversations import chat_requests
    t = usage.translate_requests(chat_requests(spark, sf), "request_body")
    return t.select("conv_id", F.col("translated.ok").alias("ok"), F.col("translated.path").alias("path"),
                    F.col("translated.system").alias("system"), F.col("translated.n_messages").alias("n_messages"),
                    F.col("translated.max_tokens").alias("max_tokens"),
                    F.md5(F.array_join(F.transform(
                        F.coalesce(F.from_json("translated.body", "messages array<struct<role:string,content:string>>")["messages"],
                                   F.array().cast("array<struct<role:string,content:string>>")),
                        lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("messages_md5"))


@register("translate_responses", f"""
SELECT conv_id,
  {"['stop', 'length', 'stop', 'tool_calls', 'stop']"}[conv_id % 5 + 1] AS finish_reason,
  md5(COALESCE(string_agg(CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN text END, '' ORDER BY turn), '')) AS content_md5,
  CAST(COALESCE(SUM(CASE WHEN role <> 'assistant' THEN length(text) END), 0) AS BIGINT) AS prompt_tokens,
  CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS completion_tokens,
  CAST(COALESCE(SUM(length(text)), 0) AS BIGINT) AS total_tokens
FROM conversations GROUP BY conv_id""")
def q_translate_responses(spark, sf):
    """P10 over Anthropic responses built from every conversation."""
    from tokenledger.plans.conversations import anthropic_responses
    t = usage.translate_responses(anthropic_responses(spark, sf), "response_body")
    return t.select("conv_id", F.col("translated.finish_reason").alias("finish_reason"),
                    F.md5(F.col("translated.content")).alias("content_md5"),
                    F.col("translated.prompt_tokens").alias("prompt_tokens"),
                    F.col("translated.completion_tokens").alias("completion_tokens"),
                    F.col("translated.total_tokens").alias("total_tokens"))


@register("error_messages", with_base(
    "SELECT request_id, " + "CASE WHEN strlen(b) <= 500 THEN b ELSE left(b, len(list_filter(range(1, length(b) + 1), "
    "lambda i: strlen(left(b, CAST(i AS BIGINT))) <= 500))) END AS error_message FROM "
    "(SELECT request_id, err_body AS b FROM us_all WHERE status_code >= 400)"))
def q_error_messages(spark, sf):
    """First 500 bytes of error bodies, never splitting a character."""
    ex, _, cfg = _inputs(spark, sf)
    return ex.where(F.col("status_code") >= 400).select(
        "request_id", H.error_message(F.col("status_code"), F.col("response_body"), cfg).alias("error_message"))


@register("truncate_bodies", with_base(
    "SELECT request_id, CAST(strlen(t) AS INTEGER) AS body_bytes, md5(t) AS body_md5 FROM (SELECT request_id, "
    "CASE WHEN strlen(b) <= 300 THEN b ELSE left(b, len(list_filter(range(1, length(b) + 1), "
    "lambda i: strlen(left(b, CAST(i AS BIGINT))) <= 300))) END AS t "
    "FROM (SELECT request_id, err_body AS b FROM us_all WHERE status_code >= 400))"))
def q_truncate_bodies(spark, sf):
    """Byte-limited body storage (300-byte limit to exercise the cut)."""
    ex, _, _ = _inputs(spark, sf)
    t = H.truncate_bytes(F.col("response_body"), 300)
    return ex.where(F.col("status_code") >= 400).select(
        "request_id", F.octet_length(t).alias("body_bytes"), F.md5(t).alias("body_md5"))


#: the bodies of every exchange by the formulas of FIXTURES.md, for the oracle of P12 over both columns
_MODEL_SQL = "CASE WHEN k % 5 = 0 THEN '' ELSE concat(',\"{}\":\"', model, '\"') END"
_REQUEST_SQL = """CASE WHEN event_id % 89 = 0 THEN '{bad' ELSE concat('{"model":"', model,
  '","messages":[{"role":"system","content":"be brief"},{"role":"user","content":"q', event_id, '"}]',
  CASE WHEN k % 2 = 0 THEN concat(',"max_tokens":', k * 10) ELSE '' END, '}') END"""
_RESPONSE_SQL = f"""CASE WHEN status_code IS NULL THEN NULL
  WHEN status_code = 500 THEN concat('{{"error":{{"message":"xy', repeat('é', 200 + k), '"}}}}')
  WHEN event_id % 97 = 0 THEN '{{"usage": {{'
  WHEN r IN (0, 5) THEN concat('{{"id":"chatcmpl-', event_id, '","object":"chat.completion"', {_MODEL_SQL.format("model")},
    ',"choices":[{{"index":0,"message":{{"role":"assistant","content":"ok"}},"finish_reason":"stop"}}],"usage":{{"prompt_tokens":',
    tin, ',"completion_tokens":', tout, ',"total_tokens":', tin + tout, ',"prompt_tokens_details":{{"cached_tokens":', cached, '}}}}}}')
  WHEN r = 1 THEN concat('{{"id":"resp-', event_id, '","object":"response"', {_MODEL_SQL.format("model")},
    ',"output":[{{"type":"message","content":[{{"type":"output_text","text":"ok"}}]}}],"usage":{{"input_tokens":', tin,
    ',"output_tokens":', tout, ',"total_tokens":', tin + tout, ',"input_tokens_details":{{"cached_tokens":', cached,
    '}},"output_tokens_details":{{"reasoning_tokens":', k, '}}}}}}')
  WHEN r IN (2, 4) THEN concat('{{"id":"msg-', event_id, '","type":"message","role":"assistant"', {_MODEL_SQL.format("model")},
    ',"content":[{{"type":"text","text":"Hello"}},{{"type":"tool_use","id":"tu-', event_id, '","name":"lookup","input":{{"q":', k,
    '}}}},{{"type":"text","text":" world"}}],"stop_reason":"', {list(FX.STOP_REASONS)}[event_id % 5 + 1],
    '","stop_sequence":null,"usage":{{"input_tokens":', tin - cached, ',"output_tokens":', tout, ',"cache_read_input_tokens":', cached,
    ',"cache_creation_input_tokens":', creation, '}}}}')
  ELSE concat('{{"candidates":[{{"content":{{"parts":[{{"text":"ok"}}],"role":"model"}},"finishReason":"STOP"}}]',
    {_MODEL_SQL.format("modelVersion")}, ',"usageMetadata":{{"promptTokenCount":', tin, ',"candidatesTokenCount":', tout,
    ',"totalTokenCount":', tin + tout, ',"cachedContentTokenCount":', cached, '}}}}')
  END"""


def _cut_sql(b: str, n: int) -> str:
    return (f"CASE WHEN strlen({b}) <= {n} THEN {b} ELSE left({b}, len(list_filter(range(1, {n} + 1), "
            f"lambda i: strlen(left({b}, CAST(i AS BIGINT))) <= {n}))) END")


@register("truncate_all_bodies", with_base(
    "SELECT request_id, CAST(strlen(q) AS INTEGER) AS request_bytes, md5(q) AS request_md5, "
    "CAST(strlen(p) AS INTEGER) AS response_bytes, md5(p) AS response_md5 FROM "
    f"(SELECT request_id, {_cut_sql('rq', 120)} AS q, {_cut_sql('rp', 120)} AS p FROM "
    f"(SELECT request_id, {_REQUEST_SQL} AS rq, {_RESPONSE_SQL} AS rp FROM ev2))"))
def q_truncate_all_bodies(spark, sf):
    """P12 over the request and response body of every exchange (120 bytes, so both kinds are cut)."""
    ex, _, _ = _inputs(spark, sf)
    q, p = (H.truncate_bytes(F.col(c), 120) for c in ("request_body", "response_body"))
    return ex.select("request_id", F.octet_length(q).alias("request_bytes"), F.md5(q).alias("request_md5"),
                     F.octet_length(p).alias("response_bytes"), F.md5(p).alias("response_md5"))


@register("hash_keys", with_base(
    "SELECT request_id, sha256('gwsk_' || user_id) AS api_key_hash, "
    "CASE WHEN auth_hdr IS NOT NULL THEN sha256(auth_hdr) END AS provider_api_key_hash FROM ev2"))
def q_hash_keys(spark, sf):
    """SHA-256 of the gateway key and of the whole Authorization header."""
    ex, _, _ = _inputs(spark, sf)
    return ex.select("request_id", H.hash_key(F.col("api_key")).alias("api_key_hash"),
                     H.hash_key(F.col("authorization")).alias("provider_api_key_hash"))


@register("key_format", with_base(
    "SELECT request_id, TRUE AS api_key_format_ok, proxy_j IS NOT NULL AS proxy_key_format_ok FROM ev2"))
def q_key_format(spark, sf):
    """Prefix and length checks of both key kinds (Bearer stripped)."""
    ex, _, cfg = _inputs(spark, sf)
    return ex.select("request_id", H.key_format_ok(F.col("api_key"), cfg.api_key_prefix).alias("api_key_format_ok"),
                     H.key_format_ok(H.strip_bearer(F.col("authorization")), cfg.proxy_key_prefix)
                     .alias("proxy_key_format_ok"))


@register("body_keys", with_base("SELECT id, body_s3_key FROM req_all"))
def q_body_keys(spark, sf):
    """Object key of each logged request's bodies."""
    return materialized_log(spark, sf).select("id", "body_s3_key")


@register("response_times", with_base("SELECT id, response_time_ms FROM req_all"))
def q_response_times(spark, sf):
    """Upstream time in whole milliseconds."""
    return materialized_log(spark, sf).select("id", "response_time_ms")


@register("encrypt_roundtrip", """
SELECT c_custkey, TRUE AS decrypts, FALSE AS decrypts_with_other_key,
  CAST(12 + length('sk-' || c_custkey) + 16 AS INTEGER) AS stored_bytes FROM customer""")
def q_encrypt_roundtrip(spark, sf):
    """AES-256-GCM with random nonces; checked by decryptability and size."""
    c = FX.table(spark, sf, "customer")
    enc = S.encrypt_secret(F.concat(F.lit("sk-"), F.col("c_custkey").cast("string")), FX.FIXTURE_SECRET)
    d = c.select("c_custkey", enc.alias("enc"))
    return d.select("c_custkey", S.secret_ok(F.col("enc"), FX.FIXTURE_SECRET).alias("decrypts"),
                    S.secret_ok(F.col("enc"), FX.OTHER_SECRET).alias("decrypts_with_other_key"),
                    F.octet_length(F.unbase64("enc")).alias("stored_bytes"))


@register("secrets_decryptable", f"""
SELECT {uuid_sql("'pk-' || c_custkey")} AS proxy_key_id, provider,
  NOT (c_custkey % 8 = 3 AND provider = 'anthropic') AS decryptable
FROM customer, (SELECT unnest(['openai', 'anthropic', 'anthropic-openai']) AS provider)
WHERE c_custkey % 8 < 4""")
def q_secrets_decryptable(spark, sf):
    """Which stored provider keys decrypt (never the plaintext)."""
    m = FX.mappings(spark, sf)
    return m.select("proxy_key_id", "provider", S.secret_ok(F.col("encrypted_key"), FX.FIXTURE_SECRET).alias("decryptable"))


# --- sketches --------------------------------------------------------------

META_ROWS_SQL = """
meta_rows AS (
  SELECT api_key_id, responded_at, requested_at, e.key_name AS key_name, e.value AS value FROM (
    SELECT api_key_id, responded_at, requested_at, unnest(list_filter([
      {'key_name': 'user-id', 'value': CASE WHEN event_id % 10 <> 9 THEN CAST(event_user AS VARCHAR) END},
      {'key_name': 'feature', 'value': event_type},
      {'key_name': 'step', 'value': 's' || (k % 4)},
      {'key_name': 'environment', 'value': CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END}
    ], lambda x: x.value IS NOT NULL)) AS e FROM req))"""
KEY_STATS_SQL = with_base(
    "SELECT api_key_id, key_name, COUNT(*) AS request_count, MAX(responded_at) AS last_seen_at, "
    "CAST(COUNT(DISTINCT value) AS BIGINT) AS approx_cardinality FROM meta_rows GROUP BY api_key_id, key_name",
    META_ROWS_SQL)
STAT_COLS = ["api_key_id", "key_name", "request_count", "last_seen_at", "approx_cardinality"]


@register("metadata_key_stats", KEY_STATS_SQL)
def q_metadata_key_stats(spark, sf):
    """H1: per (API key, metadata key): HLL sketch, count, last seen, estimate."""
    from tokenledger.operators import metadata
    return metadata.metadata_key_stats(log_table(spark, sf)).select(*STAT_COLS)


@register("merge_key_stats", KEY_STATS_SQL)
def q_merge_key_stats(spark, sf):
    """H2: stats of the first half merged with the second half = the whole."""
    from tokenledger.operators import metadata
    log = log_table(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    state = metadata.metadata_key_stats(log.where(F.col("requested_at") < cut))
    delta = metadata.metadata_key_stats(log.where(F.col("requested_at") >= cut))
    return metadata.merge_key_stats(state, delta).select(*STAT_COLS)


@register("key_cardinality", with_base(
    "SELECT api_key_id, key_name, CAST(COUNT(DISTINCT value) AS BIGINT) AS approx_cardinality "
    "FROM meta_rows GROUP BY api_key_id, key_name", META_ROWS_SQL))
def q_key_cardinality(spark, sf):
    """H3: cardinality read from stored sketch bytes."""
    from tokenledger.operators import metadata
    return metadata.key_cardinality(metadata.metadata_key_stats(log_table(spark, sf)))


# --- maintenance -----------------------------------------------------------

NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
MAP_TS = "(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(1688169600 + c AS BIGINT)))"


@register("upsert_mappings", f"""
WITH m AS (SELECT c_custkey AS c, provider FROM customer,
             (SELECT unnest(['openai', 'anthropic', 'anthropic-openai']) AS provider) WHERE c_custkey % 8 < 4),
ch AS (SELECT c_custkey AS c, 'openai' AS provider, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS seq
       FROM customer WHERE c_custkey % 5 = 0
       UNION ALL SELECT c_custkey, 'gemini', 1 FROM customer WHERE c_custkey % 5 = 0),
j AS (SELECT COALESCE(m.c, ch.c) AS c, COALESCE(m.provider, ch.provider) AS provider, m.c IS NOT NULL AS existed,
             ch.c IS NOT NULL AS hit, ch.seq FROM m FULL OUTER JOIN ch ON m.c = ch.c AND m.provider = ch.provider)
SELECT CASE WHEN existed THEN {uuid_sql("'map-' || c || '-' || provider")}
            ELSE {uuid_sql("'map-new-' || c || '-' || provider")} END AS id,
  {uuid_sql("'pk-' || c")} AS proxy_key_id, provider,
  CASE WHEN existed THEN {MAP_TS} ELSE {NOW_SQL} END AS created_at,
  CASE WHEN hit THEN {NOW_SQL} ELSE {MAP_TS} END AS updated_at,
  CASE WHEN NOT hit THEN 'kept' WHEN existed THEN 'updated' ELSE 'inserted' END AS status,
  seq AS applied_seq
FROM j""")
def q_upsert_mappings(spark, sf):
    """M1: ON CONFLICT (proxy_key_id, provider) DO UPDATE."""
    from tokenledger.operators import maintenance as M
    now = F.lit(FX.CHANGE_TS).cast("timestamp")
    new = M.upsert_mappings_annotated(FX.mappings(spark, sf), FX.mapping_changes(spark, sf), now)
    return new.drop("encrypted_key")


@register("register_metadata_keys", with_base(f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS api_key_id, key_name,
  (key_name IN ('feature', 'user-id') AND c_custkey % 2 = 0) OR (key_name = 'step' AND c_custkey % 10 = 1) AS is_active,
  FALSE AS is_new
FROM customer, (SELECT unnest(['feature', 'user-id', 'step']) AS key_name)
UNION ALL
SELECT DISTINCT api_key_id, 'environment', FALSE, TRUE FROM req"""))
def q_register_metadata_keys(spark, sf):
    """M2: keys seen in logged requests are registered (inactive) if new."""
    from tokenledger.operators import maintenance as M
    log = log_table(spark, sf)
    observed = log.select("api_key_id", F.explode(F.map_keys("raw_metadata")).alias("key_name"))
    out = M.register_metadata_keys(FX.metadata_keys(spark, sf), observed)
    return out.select("api_key_id", "key_name", "is_active", "is_new")


AK_CREATED = "(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(1672531200 + c_custkey AS BIGINT)))"


@register("revoke_keys", f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS id,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 10 NOT IN (7, 8) THEN FALSE ELSE c_custkey % 10 NOT IN (7, 8) END AS is_active,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 10 NOT IN (7, 8) THEN {NOW_SQL}
       WHEN c_custkey % 10 = 7 THEN {AK_CREATED} + INTERVAL 30 DAY END AS revoked_at,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 10 NOT IN (7, 8) THEN 'revoked'
       WHEN c_custkey % 4 = 0 THEN 'not_found' ELSE 'untouched' END AS status
FROM customer
UNION ALL
SELECT {uuid_sql("'ak-' || (c_custkey + 1000000000)")}, NULL, NULL, 'not_found' FROM customer WHERE c_custkey % 20 = 0""")
def q_revoke_keys(spark, sf):
    """M3: revoke only still-active keys; others and unknown ids not found."""
    from tokenledger.operators import maintenance as M
    now = F.lit(FX.CHANGE_TS).cast("timestamp")
    return M.revoke_keys(FX.api_keys(spark, sf), FX.revoke_ids(spark, sf), now) \
        .select("id", "is_active", "revoked_at", "status")


@register("patch_api_keys", f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS id,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'patched-' || c_custkey ELSE c_mktsegment END AS description,
  CASE WHEN c_custkey % 3 <> 0 THEN 'untouched'
       WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS status
FROM customer
UNION ALL
SELECT {uuid_sql("'ak-' || (c_custkey + 1000000000)")}, 'x', NULL, 'not_found' FROM customer WHERE c_custkey % 21 = 0""")
def q_patch_api_keys(spark, sf):
    """M4: partial updates of name / description."""
    from tokenledger.operators import maintenance as M
    return M.patch_api_keys(FX.api_keys(spark, sf), FX.api_key_patches(spark, sf)) \
        .select("id", "name", "description", "status")


@register("delete_mappings", f"""
WITH m AS (SELECT c_custkey AS c, provider FROM customer,
             (SELECT unnest(['openai', 'anthropic', 'anthropic-openai']) AS provider) WHERE c_custkey % 8 < 4),
d AS (SELECT c_custkey AS c, provider FROM customer, (SELECT unnest(['anthropic', 'gemini']) AS provider)
      WHERE c_custkey % 6 = 0)
SELECT {uuid_sql("'pk-' || m.c")} AS proxy_key_id, m.provider, 'kept' AS status FROM m
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.c = m.c AND d.provider = m.provider)
UNION ALL
SELECT {uuid_sql("'pk-' || d.c")}, d.provider,
  CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.c = d.c AND m.provider = d.provider) THEN 'deleted' ELSE 'missing' END
FROM d""")
def q_delete_mappings(spark, sf):
    """M5: delete by (proxy key, provider); report missing ones."""
    from tokenledger.operators import maintenance as M
    kept, status = M.delete_mappings(FX.mappings(spark, sf), FX.mapping_deletes(spark, sf))
    return kept.select("proxy_key_id", "provider", F.lit("kept").alias("status")).unionByName(status)


@register("create_keys", """
WITH n AS (SELECT c_custkey AS seq, sha256(CASE WHEN c_custkey % 50 = 0 THEN 'gwsk_' || c_custkey
                                              ELSE 'gwsk_new_' || (c_custkey // 2) END) AS key_hash,
                  c_custkey % 50 = 0 AS clashes FROM customer),
f AS (SELECT key_hash, MIN(seq) AS first FROM n GROUP BY key_hash)
SELECT """ + uuid_sql("'new-ak-' || n.seq") + """ AS id, n.key_hash, n.seq,
  CASE WHEN clashes THEN 'duplicate_existing' WHEN n.seq <> f.first THEN 'duplicate_in_batch' ELSE 'created' END AS status
FROM n JOIN f USING (key_hash)""")
def q_create_keys(spark, sf):
    """M6: UNIQUE key_hash: first wins, the rest are refused."""
    from tokenledger.operators import maintenance as M
    _, status = M.create_keys(FX.api_keys(spark, sf), FX.new_api_keys(spark, sf))
    return status


@register("drop_proxy_keys_cascade", f"""
SELECT 'proxy_key' AS kind, {uuid_sql("'pk-' || c_custkey")} AS id, CAST(NULL AS VARCHAR) AS provider
FROM customer WHERE c_custkey % 10 <> 0
UNION ALL
SELECT 'mapping', {uuid_sql("'pk-' || c_custkey")}, provider FROM customer,
  (SELECT unnest(['openai', 'anthropic', 'anthropic-openai']) AS provider)
WHERE c_custkey % 8 < 4 AND c_custkey % 10 <> 0""")
def q_drop_proxy_keys_cascade(spark, sf):
    """M7: dropping proxy keys drops their mappings."""
    from tokenledger.operators import maintenance as M
    kept_keys, kept_maps = M.drop_proxy_keys_cascade(
        FX.proxy_keys(spark, sf), FX.mappings(spark, sf), FX.dropped_proxy_keys(spark, sf))
    return kept_keys.select(F.lit("proxy_key").alias("kind"), "id", F.lit(None).cast("string").alias("provider")) \
        .unionByName(kept_maps.select(F.lit("mapping").alias("kind"), F.col("proxy_key_id").alias("id"), "provider"))


@register("revoke_proxy_keys", f"""
SELECT {uuid_sql("'pk-' || c_custkey")} AS id, c_custkey % 8 NOT IN (4, 5) AND c_custkey % 10 <> 0 AS is_active,
  CASE WHEN c_custkey % 10 = 0 AND c_custkey % 8 NOT IN (4, 5) THEN {NOW_SQL} WHEN c_custkey % 8 = 4
       THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(1685577600 + c_custkey AS BIGINT)) + INTERVAL 10 DAY END AS revoked_at,
  CASE WHEN c_custkey % 10 <> 0 THEN 'untouched' WHEN c_custkey % 8 IN (4, 5) THEN 'not_found' ELSE 'revoked' END AS status
FROM customer""")
def q_revoke_proxy_keys(spark, sf):
    """M3 for proxy keys."""
    from tokenledger.operators import maintenance as M
    now = F.lit(FX.CHANGE_TS).cast("timestamp")
    return M.revoke_keys(FX.proxy_keys(spark, sf), FX.dropped_proxy_keys(spark, sf), now) \
        .select("id", "is_active", "revoked_at", "status")


@register("create_proxy_keys", """
WITH n AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 8 = 7 THEN c_custkey // 16 ELSE c_custkey END AS secret,
                  c_custkey % 8 IN (4, 5) AS clashes FROM customer),
h AS (SELECT seq, sha256(CASE WHEN clashes THEN 'gwpk_' || secret ELSE 'gwpk_new_' || secret END) AS key_hash, clashes FROM n),
f AS (SELECT key_hash, MIN(seq) AS first FROM h GROUP BY key_hash)
SELECT """ + uuid_sql("'new-pk-' || h.seq") + """ AS id, h.key_hash, h.seq,
  CASE WHEN clashes THEN 'duplicate_existing' WHEN h.seq <> f.first THEN 'duplicate_in_batch' ELSE 'created' END AS status
FROM h JOIN f USING (key_hash)""")
def q_create_proxy_keys(spark, sf):
    """M6 for proxy keys: some secrets are stored already, some come twice."""
    from tokenledger.operators import maintenance as M
    return M.create_keys(FX.proxy_keys(spark, sf), FX.new_proxy_keys(spark, sf))[1]


# --- the same changes as deltas of bucketed tables ------------------------

def _key_table(spark, rows, key, bucket_by):
    from tokenledger.sources.key_table import KeyTable
    table = KeyTable(spark, scratch_path(spark, "key-table"), key, bucket_by)
    table.create(rows)
    return table


_PAIR = ["proxy_key_id", "provider"]


@register("upsert_mappings_by_delta",
          f"SELECT id, proxy_key_id, provider, created_at, updated_at FROM ({ORACLE['upsert_mappings']})")
def q_upsert_mappings_by_delta(spark, sf):
    """M1 on a bucketed table: what it holds after the batch."""
    from tokenledger.operators import key_tables
    table = _key_table(spark, FX.mappings(spark, sf), _PAIR, "proxy_key_id")
    key_tables.upsert_mappings(table, FX.mapping_changes(spark, sf), F.lit(FX.CHANGE_TS).cast("timestamp"))
    return table.read().drop("encrypted_key")


@register("register_metadata_keys_by_delta",
          f"SELECT api_key_id, key_name, is_active FROM ({ORACLE['register_metadata_keys']})")
def q_register_metadata_keys_by_delta(spark, sf):
    """M2 on a bucketed table."""
    from tokenledger.operators import key_tables
    table = _key_table(spark, FX.metadata_keys(spark, sf), ["api_key_id", "key_name"], "api_key_id")
    key_tables.register_metadata_keys(table, log_table(spark, sf).select(
        "api_key_id", F.explode(F.map_keys("raw_metadata")).alias("key_name")))
    return table.read().select("api_key_id", "key_name", "is_active")


@register("revoke_and_patch_by_delta", f"""
SELECT r.id, r.is_active, r.revoked_at, p.name, p.description
FROM ({ORACLE['revoke_keys']}) r JOIN ({ORACLE['patch_api_keys']}) p USING (id)
WHERE r.is_active IS NOT NULL AND p.status <> 'not_found'""")
def q_revoke_and_patch_by_delta(spark, sf):
    """M3, then M4, on one bucketed table, compacted after both."""
    from tokenledger.operators import key_tables
    table = _key_table(spark, FX.api_keys(spark, sf), ["id"], "id")
    key_tables.revoke_keys(table, FX.revoke_ids(spark, sf), F.lit(FX.CHANGE_TS).cast("timestamp"))
    key_tables.patch_api_keys(table, FX.api_key_patches(spark, sf))
    table.compact()
    return table.read().select("id", "is_active", "revoked_at", "name", "description")


@register("delete_mappings_by_delta",
          f"SELECT proxy_key_id, provider FROM ({ORACLE['delete_mappings']}) WHERE status = 'kept'")
def q_delete_mappings_by_delta(spark, sf):
    """M5 on a bucketed table."""
    from tokenledger.operators import key_tables
    table = _key_table(spark, FX.mappings(spark, sf), _PAIR, "proxy_key_id")
    key_tables.delete_mappings(table, FX.mapping_deletes(spark, sf))
    return table.read().select(*_PAIR)


@register("create_keys_by_delta", f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS id, c_custkey % 10 NOT IN (7, 8) AS is_active FROM customer
UNION ALL SELECT id, TRUE FROM ({ORACLE['create_keys']}) WHERE status = 'created'""")
def q_create_keys_by_delta(spark, sf):
    """M6 on a bucketed table."""
    from tokenledger.operators import key_tables
    table = _key_table(spark, FX.api_keys(spark, sf), ["id"], "id")
    key_tables.create_keys(table, FX.new_api_keys(spark, sf))
    return table.read().select("id", "is_active")


@register("drop_proxy_keys_by_delta", ORACLE["drop_proxy_keys_cascade"])
def q_drop_proxy_keys_by_delta(spark, sf):
    """M7 on two bucketed tables."""
    from tokenledger.operators import key_tables
    keys_ = _key_table(spark, FX.proxy_keys(spark, sf), ["id"], "id")
    maps = _key_table(spark, FX.mappings(spark, sf), _PAIR, "proxy_key_id")
    key_tables.drop_proxy_keys_cascade(keys_, maps, FX.dropped_proxy_keys(spark, sf))
    return keys_.read().select(F.lit("proxy_key").alias("kind"), "id", F.lit(None).cast("string").alias("provider")) \
        .unionByName(maps.read().select(F.lit("mapping").alias("kind"), F.col("proxy_key_id").alias("id"), "provider"))


# --- key usage counters ----------------------------------------------------

_USED = "SELECT user_id AS key, COUNT(*) AS n, MAX(requested_at) AS t FROM res WHERE api_key_status = 'ok' GROUP BY user_id"


@register("api_key_usage", with_base(
    "SELECT " + uuid_sql("'ak-' || key") + f" AS api_key_id, CAST(n AS BIGINT) AS requests, t AS last_used_at FROM ({_USED})"))
def q_api_key_usage(spark, sf):
    """Requests and last use of every API key."""
    from tokenledger.operators import key_usage
    return key_usage.api_key_usage(_api_keys_resolved(spark, sf)).select("api_key_id", "requests", "last_used_at")


@register("proxy_key_usage", with_base(
    "SELECT " + uuid_sql("'pk-' || proxy_j") + " AS proxy_key_id, CAST(COUNT(*) AS BIGINT) AS requests, "
    "MAX(requested_at) AS last_used_at FROM res WHERE proxy_status = 'ok' GROUP BY proxy_j"))
def q_proxy_key_usage(spark, sf):
    """As U1 for proxy keys."""
    from tokenledger.operators import key_usage
    return key_usage.proxy_key_usage(_resolved(spark, sf)).select("proxy_key_id", "requests", "last_used_at")


def _counted_keys(spark, sf):
    """API keys with their usage folded in."""
    from tokenledger.operators import key_usage
    return key_usage.apply_usage(FX.api_keys(spark, sf), key_usage.api_key_usage(_api_keys_resolved(spark, sf)), "api_key_id")


# --- listings --------------------------------------------------------------

@register("list_api_keys", with_base(f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS id, c_name AS name,
  CASE WHEN c_custkey % 10 NOT IN (7, 8) THEN 'active' ELSE 'revoked' END AS status,
  {AK_CREATED} AS created_at, CAST(COALESCE(u.n, 0) AS BIGINT) AS request_count
FROM customer LEFT JOIN ({_USED}) u ON u.key = c_custkey ORDER BY created_at DESC"""))
def q_list_api_keys(spark, sf):
    """L1, with the counts of U1 folded in."""
    from tokenledger.operators import listings as L
    return L.list_api_keys(_counted_keys(spark, sf))


@register("list_api_keys_by_user", f"""
SELECT {uuid_sql("'ak-' || c_custkey")} AS id, c_name AS name, c_mktsegment AS description,
  'u' || (c_custkey // 3) AS user_id, c_custkey % 10 NOT IN (7, 8) AS is_active, {AK_CREATED} AS created_at,
  CASE WHEN c_custkey % 10 = 7 THEN {AK_CREATED} + INTERVAL 30 DAY END AS revoked_at, CAST(0 AS BIGINT) AS request_count
FROM customer WHERE c_custkey // 3 = {int(USER_FOR_L2[1:])} AND c_custkey % 10 <> 6""")
def q_list_api_keys_by_user(spark, sf):
    """L2."""
    from tokenledger.operators import listings as L
    return L.list_api_keys_by_user(FX.api_keys(spark, sf), USER_FOR_L2)


PK_CREATED = "(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(1685577600 + c_custkey AS BIGINT)))"


@register("list_proxy_keys", f"""
SELECT {uuid_sql("'pk-' || c_custkey")} AS id, 'proxy-' || c_custkey AS name, CAST(NULL AS VARCHAR) AS description,
  {uuid_sql("'ak-' || c_custkey")} AS api_key_id, c_custkey % 8 NOT IN (4, 5) AS is_active, {PK_CREATED} AS created_at,
  CASE WHEN c_custkey % 8 = 4 THEN {PK_CREATED} + INTERVAL 10 DAY END AS revoked_at
FROM customer WHERE c_custkey = {KEY_FOR_L3}""")
def q_list_proxy_keys(spark, sf):
    """L3."""
    from tokenledger.operators import listings as L
    return L.list_proxy_keys(FX.proxy_keys(spark, sf), _ak(KEY_FOR_L3))


@register("list_mappings", f"""
SELECT {uuid_sql("'map-' || c_custkey || '-' || provider")} AS id, {uuid_sql("'pk-' || c_custkey")} AS proxy_key_id,
  provider, {MAP_TS.replace('c AS', 'c_custkey AS')} AS created_at, {MAP_TS.replace('c AS', 'c_custkey AS')} AS updated_at
FROM customer, (SELECT unnest(['openai', 'anthropic', 'anthropic-openai']) AS provider)
WHERE c_custkey = {PK_FOR_A8} AND c_custkey % 8 < 4 ORDER BY provider""")
def q_list_mappings(spark, sf):
    """L4: no encrypted key in the output."""
    from tokenledger.operators import listings as L
    return L.list_mappings(FX.mappings(spark, sf), _pk(PK_FOR_A8))


@register("list_users", """
SELECT 'u' || c_custkey AS id, lower(replace(c_name, '#', '-')) AS username,
  CASE WHEN c_custkey % 7 <> 6 THEN 'active' ELSE 'inactive' END AS status,
  (TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(1669852800 + c_custkey AS BIGINT))) AS created_at
FROM customer ORDER BY created_at DESC""")
def q_list_users(spark, sf):
    """No password hash."""
    from tokenledger.operators import listings as L
    return L.list_users(FX.users(spark, sf))


# --- sources, sinks and streams --------------------------------------------

HEADER_COUNT_SQL = ("3 + CASE WHEN event_id % 10 <> 9 THEN 1 ELSE 0 END + CASE WHEN r = 1 THEN 1 ELSE 0 END "
                    "+ CASE WHEN r = 4 OR (r = 5 AND event_id % 12 = 11) THEN 1 ELSE 0 END")


@register("bodies_roundtrip", with_base(
    f"SELECT id AS request_id, body_s3_key AS object_key, 'POST' AS method, request_path AS path, status_code, "
    f"CAST({HEADER_COUNT_SQL} AS INTEGER) AS header_count, "
    f"CASE WHEN event_id % 89 = 0 THEN 'unknown' ELSE model_src END AS request_model, "
    f"sha256(rq) AS request_sha256, sha256(rp) AS response_sha256 "
    f"FROM req_all JOIN (SELECT request_id AS rid, model AS model_src, {_REQUEST_SQL} AS rq, {_RESPONSE_SQL} AS rp FROM ev2) m "
    f"ON m.rid = req_all.id"))
def q_bodies_roundtrip(spark, sf):
    """S6 then S1: envelopes written (gzip JSON Lines, prefix/date
    partitions) and read back; both bodies survive byte for byte, as raw JSON or strings."""
    from tokenledger.sources import bodies
    ex, dims, cfg = _inputs(spark, sf)
    path = scratch_path(spark, "bodies")
    bodies.write_bodies(enrich.body_envelopes(ex, dims, cfg), path)
    back = bodies.read_exchanges(spark, path)
    return back.select("request_id", "object_key", F.col("request.method").alias("method"),
                       F.col("request.path").alias("path"), F.col("response.status_code").alias("status_code"),
                       F.size("request.headers").alias("header_count"),
                       P.extract_model(F.col("request.body")).alias("request_model"),
                       F.sha2("request.body", 256).alias("request_sha256"),
                       F.sha2("response.body", 256).alias("response_sha256"))


@register("write_request_log", with_base(f"SELECT {LOG_SELECT} FROM req"))
def q_write_request_log(spark, sf):
    """The accepted rows as read back from the date-partitioned table."""
    return A.comparable_log(log_table(spark, sf))


def _stream_source(spark, sf) -> str:
    """Exchanges recorded as JSON Lines files (input of S2/T1/T3)."""
    from tokenledger.sources import bodies
    ex, _, _ = _inputs(spark, sf)
    src = scratch_path(spark, "exchanges")
    bodies.write_exchanges(ex, src)
    return src


@register("stream_enrich", with_base(f"SELECT {WIDE_LOG}, reject_reason FROM req_all"))
def q_stream_enrich(spark, sf):
    """T1 (and S2): the stream, run to completion with availableNow over
    several micro-batches, equals the batch J8 result."""
    from tokenledger.streaming import jobs
    dims = FX.load_dims(spark, sf)
    src = _stream_source(spark, sf)
    out, ckpt = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-ckpt")
    q = jobs.stream_enrich(spark, src, dims, out, ckpt, trigger="availableNow", max_files=2)
    q.awaitTermination()
    return A.comparable_log(spark.read.parquet(out))


@register("stream_key_stats", KEY_STATS_SQL)
def q_stream_key_stats(spark, sf):
    """Sketches kept current per micro-batch equal the batch H1."""
    from tokenledger.streaming import jobs
    log = materialized_log(spark, sf)
    path = _LOGS[(spark.sparkContext.applicationId, sf)]
    root, ckpt = scratch_path(spark, "key-stats"), scratch_path(spark, "key-stats-ckpt")
    q = jobs.stream_key_stats(spark, path, log.schema, root, ckpt, trigger="availableNow", max_files=4)
    q.awaitTermination()
    return jobs.latest_snapshot(spark, root).select(*STAT_COLS)


@register("write_request_log_twice", with_base(f"SELECT {WIDE_LOG}, reject_reason FROM req_all"))
def q_write_request_log_twice(spark, sf):
    """S7's primary key: the whole log appended twice, as two batches of
    different names, holds each request once."""
    from tokenledger.sources import batch_log
    log = materialized_log(spark, sf)
    path = scratch_path(spark, "log-twice")
    batch_log.append_once(log, path, "first")
    batch_log.append_once(log, path, "second")
    return A.comparable_log(log_io.read_request_log(spark, path))


#: T3's second run has every price of the list doubled
_DOUBLED_COSTS = ", ".join(f"CASE WHEN event_id >= {{cut}} THEN TRY_CAST(CAST(2 * {d} AS VARCHAR) AS DECIMAL(12,8)) "
                           f"ELSE {c} END AS {c}"
                           for c, d in (("input_cost", "in_d"), ("output_cost", "out_d"), ("total_cost", "tot_d")))
_CUT_SQL = "(SELECT (MIN(event_id) + MAX(event_id)) // 2 FROM events)"


@register("key_stats_write_back", with_base(
    f"SELECT {uuid_sql("'ak-' || c.i")} AS api_key_id, t.key_name, CAST(COALESCE(s.n, 0) AS BIGINT) AS request_count, "
    "s.last_seen AS last_seen_at, CAST(COALESCE(s.card, 0) AS INTEGER) AS approx_cardinality "
    "FROM cust c CROSS JOIN (SELECT unnest(['feature', 'user-id', 'step']) AS key_name) t "
    "LEFT JOIN (SELECT api_key_id, key_name, COUNT(*) AS n, MAX(responded_at) AS last_seen, COUNT(DISTINCT value) AS card "
    "FROM meta_rows GROUP BY api_key_id, key_name) s "
    f"ON s.api_key_id = {uuid_sql("'ak-' || c.i")} AND s.key_name = t.key_name", META_ROWS_SQL))
def q_key_stats_write_back(spark, sf):
    """T2's sketches and counts written into the metadata-key table."""
    from tokenledger.operators import metadata
    from tokenledger.streaming import jobs
    log = materialized_log(spark, sf)
    root, ckpt = scratch_path(spark, "key-stats"), scratch_path(spark, "key-stats-ckpt")
    jobs.stream_key_stats(spark, _LOGS[(spark.sparkContext.applicationId, sf)], log.schema, root, ckpt,
                          trigger="availableNow", max_files=64).awaitTermination()
    now = F.lit(FX.CHANGE_TS).cast("timestamp")
    keys_ = metadata.apply_key_stats(FX.metadata_keys(spark, sf), jobs.latest_snapshot(spark, root), now)
    return keys_.select("api_key_id", "key_name", "request_count", "last_seen_at", "approx_cardinality")


@register("stream_price_refresh", with_base(
    f"SELECT {WIDE_LOG}, reject_reason FROM (SELECT q.* REPLACE ({_DOUBLED_COSTS.format(cut=_CUT_SQL)}) "
    "FROM (SELECT req_all.*, in_d, out_d, tot_d FROM req_all JOIN "
    "(SELECT request_id AS rid, in_d, out_d, tot_d FROM priced) p ON p.rid = req_all.id) q)"))
def q_stream_price_refresh(spark, sf):
    """The exchanges of the first half of ``events`` priced by the list,
    those of the second half, which arrive after the list was replaced by one of
    doubled prices, by the new one; one log, one checkpoint."""
    from tokenledger.sources import bodies
    from tokenledger.sources import prices as price_src
    from tokenledger.sources.files import Folder
    from tokenledger.streaming import jobs
    ex, dims, _ = _inputs(spark, sf)
    src, out, ckpt, config = (scratch_path(spark, n) for n in ("exchanges", "price-stream", "price-stream-ckpt", "prices"))
    with open(price_src.DEFAULT_PRICES) as f:
        doc = json.load(f)
    Folder(spark, config).write_json("prices.json", doc)
    snap = jobs.PriceSnapshot(spark, f"{config}/prices.json", price_src.DEFAULT_FALLBACK, price_src.DEFAULT_ALIASES,
                              refresh_seconds=0.0)
    ids = FX.table(spark, sf, "events").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("cut")).first()
    cut = ids.cut if ids.cut is not None else 0
    for half in (F.col("event_id") < cut, F.col("event_id") >= cut):
        bodies.write_exchanges(ex.where(half), src)
        jobs.stream_price_refresh(spark, src, dims, out, ckpt, snap, trigger="availableNow", max_files=4).awaitTermination()
        prices = [{k: 2 * v if k in ("input", "output", "input_cached") and v else v for k, v in p.items()} for p in doc["prices"]]
        Folder(spark, config).write_json("prices.json", {**doc, "prices": prices})
    return A.comparable_log(spark.read.parquet(out))
