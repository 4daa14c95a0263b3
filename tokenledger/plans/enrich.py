"""Recorded exchanges -> typed, priced request log (``llm_requests``).

Plan shape (one stage, no shuffle on the fact side when the dimensions, or the
keys in use, fit the broadcast bound; no shuffle ever carries a body):

    exchanges -> gateway headers, provider, key hashes       (narrow)
      -> join API-key dim (+ active metadata keys folded in)  (size-checked broadcast)
      -> join proxy-key dim (+ mappings folded in)            (size-checked broadcast)
      -> F1 gate, before any JSON is parsed (keys beyond the bound: after the
         decode, so that only narrow rows are shuffled)
      -> usage decode (one parse per body), translation path   (narrow)
      -> price lookup: join of the deduplicated price list    (size-checked broadcast)
      -> costs, error text, body pointers, reject reason       (narrow)
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.functions import headers as H
from tokenledger.functions.json_strict import with_strict
from tokenledger.functions.providers import detect_provider
from tokenledger.operators import keys, metadata, pricing, quality, usage
from tokenledger.plans.fixtures import Dims
from tokenledger.session import dim_side

def prepare(exchanges: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Narrow projection of the exchange columns the log needs."""
    gw = H.extract_headers(F.col("headers"), cfg)
    corrupt = [quality.CORRUPT] if quality.CORRUPT in exchanges.columns else []
    return exchanges.select(
        *corrupt,
        "request_id", "requested_at", "responded_at", "upstream_us", "method", "path",
        "authorization", "request_body", "status_code", "response_headers", "response_body",
        gw.alias("gw_headers"),
        F.element_at(gw, F.lit(cfg.key_header)).alias("api_key"),
    ).withColumn("prov", detect_provider(F.col("path"), F.col("gw_headers"), cfg))


def _with_provider(exchanges: DataFrame, cfg: LedgerConfig) -> DataFrame:
    return prepare(exchanges, cfg).withColumn("provider_detected", F.col("prov.provider"))


def fold(dims: Dims, cfg: LedgerConfig = DEFAULT) -> Dims:
    """Dimensions with all that a request needs of a key in one written row per
    key: mappings are decrypted and metadata keys gathered once, not once per use."""
    if dims.folded:
        return dims
    api = keys.api_dimension(dims.api_keys, metadata.active_key_names(dims.metadata_keys), cfg)
    proxy = keys.proxy_dimension(dims.proxy_keys, dims.mappings, dims.secret, cfg)
    return replace(dims, api_keys=keys.written(api, "api-keys"), proxy_keys=keys.written(proxy, "proxy-keys"), folded=True)


def _key_dims(prepared: DataFrame, dims: Dims, cfg: LedgerConfig) -> tuple[Dims, bool]:
    """Dimensions with key tables cut to the keys in use where they exceed the
    broadcast bound, and whether all then fit it."""
    if prepared.isStreaming or (keys.fits(dims.api_keys, cfg) and keys.fits(dims.proxy_keys, cfg)):
        return dims, True
    # one scan for the hashes of both kinds of keys
    hashes = prepared.select(F.explode(F.array(
        F.struct(F.lit("api").alias("kind"), H.hash_key(F.col("api_key")).alias("h")),
        F.struct(F.lit("proxy").alias("kind"), keys.proxy_token_hash(F.col("authorization"), cfg).alias("h")))).alias("u"))
    seen = keys.written(hashes.select("u.*").where("h IS NOT NULL").distinct(), "hashes-in-use")
    api_hash, proxy_hash = ("_ak_hash", "_pk_hash") if dims.folded else ("key_hash", "key_hash")
    api_keys = keys.in_use(dims.api_keys, api_hash, seen.where("kind = 'api'").select("h"), cfg)
    proxy_keys = keys.in_use(dims.proxy_keys, proxy_hash, seen.where("kind = 'proxy'").select("h"), cfg)
    metadata_keys, mappings = dims.metadata_keys, dims.mappings
    if not dims.folded:  # what is folded into a key's row is cut with it
        ids = api_keys.select(F.col("id").alias("api_key_id"))
        metadata_keys = metadata_keys.join(dim_side(ids, cfg.dim_broadcast_bytes), "api_key_id", "left_semi")
        ids = proxy_keys.select(F.col("id").alias("proxy_key_id"))
        mappings = mappings.join(dim_side(ids, cfg.dim_broadcast_bytes), "proxy_key_id", "left_semi")
    cut = fold(replace(dims, api_keys=api_keys, proxy_keys=proxy_keys, mappings=mappings, metadata_keys=metadata_keys), cfg)
    return cut, keys.fits(cut.api_keys, cfg) and keys.fits(cut.proxy_keys, cfg)


def _resolve(df: DataFrame, dims: Dims, cfg: LedgerConfig) -> DataFrame:
    extra = None if dims.folded else metadata.active_key_names(dims.metadata_keys)
    df = keys.resolve_api_keys(df, dims.api_keys, "api_key", extra, cfg, dims.folded)
    return keys.resolve_proxy_keys(df, dims.proxy_keys, dims.mappings, dims.secret,
                                   "authorization", "provider_detected", "api_key_id", cfg, dims.folded)


def resolve(exchanges: DataFrame, dims: Dims, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Exchanges with J1/J2 statuses (all rows, before the F1 gate)."""
    df = _with_provider(exchanges, cfg)
    return _resolve(df, _key_dims(df, dims, cfg)[0], cfg)


def _with_request_path(df: DataFrame) -> DataFrame:
    """The path the gateway logs: a request of the translating provider that
    translates is logged under the new path."""
    translate = F.col("provider_detected") == usage.TRANSLATING_PROVIDER
    df = with_strict(df, "request_body", usage.OPENAI_REQUEST, "_treq", guard=translate)
    path = F.when(translate & F.coalesce(F.col("_treq.ok"), F.lit(False)), F.lit(usage.TRANSLATED_PATH)) \
        .otherwise(F.col("path"))
    return df.withColumn("request_path", path).drop("_treq")


def logged_exchanges(exchanges: DataFrame, dims: Dims, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """F1-gated exchanges with the path the gateway logs."""
    return _with_request_path(quality.loggable(resolve(exchanges, dims, cfg)))


def _decoded(df: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """All that the log keeps of a request's bodies; the bodies themselves go."""
    df = usage.usage_metrics(_with_request_path(df), provider="provider_detected")
    store = cfg.body_mode == "table"
    message = H.error_message(F.col("status_code"), F.col("response_body"), cfg)
    if quality.CORRUPT in df.columns:
        message = F.coalesce(message, H.truncate_bytes(F.col(quality.CORRUPT), cfg.error_message_bytes))

    def kept(body: str, wanted: bool):
        return H.truncate_bytes(F.col(body), cfg.max_body_bytes) if store and wanted else F.lit(None).cast("string")

    return df.withColumns({"error_message": message, "_request": kept("request_body", cfg.store_request_body),
                           "_response": kept("response_body", cfg.store_response_body)}).drop("request_body", "response_body")


def body_envelopes(exchanges: DataFrame, dims: Dims, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Input of S6 for every logged exchange. The gateway-key header is
    dropped from the stored headers (it would store the secret in clear)."""
    df = logged_exchanges(exchanges, dims, cfg)
    return df.select(
        "request_id", "api_key_id", "requested_at", "method", F.col("request_path").alias("path"),
        F.map_filter("gw_headers", lambda k, v: k != cfg.key_header).alias("headers"),
        "request_body", "status_code", "response_headers", "response_body",
    )


def enrich_requests(exchanges: DataFrame, dims: Dims, cfg: LedgerConfig = DEFAULT,
                    with_reason: bool = True) -> DataFrame:
    """The request log, one row per loggable exchange
    (+ ``reject_reason`` for Q1; unreadable input lines become rejects too). Counts are bigint until Q1 narrows them."""
    df = _with_provider(exchanges, cfg)
    dims, fit = _key_dims(df, dims, cfg)
    if fit:  # the gate comes before any body is parsed
        df = _decoded(quality.loggable(_resolve(df, dims, cfg)), cfg)
    else:  # rows are shuffled to the keys, so bodies are read and dropped before
        df = quality.loggable(_resolve(_decoded(df, cfg), dims, cfg))
    df = pricing.lookup_prices(df.withColumn("model", F.col("usage.model")), dims.prices, dims.aliases, "model", cfg)
    raw_meta = H.custom_metadata(F.col("gw_headers"), cfg)
    corrupt = quality.CORRUPT in df.columns
    out = df.select(
        F.col("request_id").alias("id"),
        "user_id", "api_key_id", "proxy_key_id",
        H.hash_key(F.col("authorization")).alias("provider_api_key_hash"),
        F.nullif(F.element_at(F.col("gw_headers"), F.lit(cfg.alias_header)), F.lit("")).alias("provider_api_key_alias"),
        F.col("usage.provider").alias("provider"),
        "model", "request_path",
        F.col("method").alias("request_method"),
        "requested_at", "responded_at",
        H.response_time_ms(F.col("upstream_us"), F.col("requested_at"), F.col("responded_at")).alias("response_time_ms"),
        F.col("usage.input").alias("input_tokens"),
        F.col("usage.output").alias("output_tokens"),
        F.col("usage.cached").alias("cached_tokens"),
        F.col("usage.creation").alias("cache_creation_tokens"),
        *pricing.cost_columns(F.col("usage.input"), F.col("usage.output"), F.col("usage.cached"), F.col("price")),
        "status_code",
        "error_message",
        raw_meta.alias("raw_metadata"),
        metadata.indexed_metadata(raw_meta, F.col("active_keys")).alias("indexed_metadata"),
        F.col("_request").alias("request_body"),
        F.col("_response").alias("response_body"),
        F.col("responded_at").alias("created_at"),
        (H.body_key(F.col("api_key_id"), F.col("request_id"), F.col("requested_at")) if cfg.body_mode == "object"
         else F.lit(None).cast("string")).alias("body_s3_key"),
        "model_alias_found",
        F.to_date("requested_at").alias("requested_date"),
        *([quality.CORRUPT] if corrupt else []),
    )
    return (quality.with_reject_reason(out) if with_reason else out).drop(quality.CORRUPT)


def request_log(exchanges: DataFrame, dims: Dims, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Rows the log table accepts (Q1 ok side), INT-typed counts."""
    ok, _ = quality.split_rejects(enrich_requests(exchanges, dims, cfg))
    return ok
