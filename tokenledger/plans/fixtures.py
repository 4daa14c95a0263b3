"""Engine inputs derived from the driver's tables.

* ``exchanges``: one recorded request/response per row of ``events`` (the
  formulas are in FIXTURES.md section 2; every provider format, failure and
  reject case appears at every scale);
* dimensions (``api_keys``, ``users``, ``proxy_keys``, ``mappings``,
  ``metadata_keys``): one row (or a few) per row of ``customer``, so they grow
  with the data and are joined with size-checked broadcasts;
* prices and aliases: the configuration files in ``tokenledger/resources``.

All derivations are narrow projections (no shuffles).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.functions.secrets import encrypt_secret
from tokenledger.sources import prices as price_src

# Encryption keys of the fixture (hex of a SHA-256 of a label): the main one,
# and a different one that makes some stored provider keys undecryptable.
FIXTURE_SECRET = hashlib.sha256(b"tokenledger-fixture-key").hexdigest()
OTHER_SECRET = hashlib.sha256(b"tokenledger-other-key").hexdigest()

MODELS_OPENAI = ["gpt-alpha", "gpt-alpha-2024-01-01", "gpt-mini-2024-01-01", "mystery-1"]
MODELS_ANTHROPIC = ["cl-big-20240101", "cl-small-20240101", "cl-big", "cl-unlisted"]
MODELS_GEMINI = ["gem-pro-001", "gem-flash", "gem-pro-preview", "gem-unlisted"]
PATHS = ["/v1/chat/completions", "/v1/responses", "/v1/messages",
         "/v1beta/models/g:generateContent", "/v1/chat/completions", "/custom/path"]
STOP_REASONS = ["end_turn", "max_tokens", "stop_sequence", "tool_use", "pause_turn"]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A test table that is one small file, dealt to the cores; tables in
    several files are left alone."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want, *keys) if len(df.inputFiles()) == 1 else df



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def uuid_of(expr: str) -> str:
    """SQL text: a UUID-shaped id from the md5 of ``expr``."""
    h = f"md5({expr})"
    return (f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), "
            f"substr({h},17,4), substr({h},21,12))")


AK_ID = uuid_of("concat('ak-', c_custkey)")
PK_ID = uuid_of("concat('pk-', c_custkey)")


def _arr(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def exchange_params(events: DataFrame) -> DataFrame:
    """Per-event parameters shared by the exchange fixture (narrow)."""
    e = events.select(
        "event_id", "user_id", "event_type", "value",
        F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )
    return e.selectExpr(
        "*",
        "cast(event_id % 6 as int) as r",
        "cast((event_id div 6) % 4 as int) as m",
        "md5(concat('req-', event_id)) as request_id",
        "(50 + event_id % 950) * 1000 + event_id % 1000 as upstream_us",
        "cast(floor(value * 10) as bigint) + case when event_id % 223 = 0 then 3000000000 else 0 end as tin",
        "cast(3 * k + 1 as bigint) as tout",
        "case when event_id % 101 = 0 then null when event_type = 'error' then 500 else 200 end as status_code",
    ).selectExpr(
        "*",
        "case when event_id % 5 = 0 then tin div 2 else cast(0 as bigint) end as cached",
        "case when event_id % 7 = 0 then cast(k as bigint) else cast(0 as bigint) end as creation",
        f"""case when event_id % 211 = 0 then concat('model-', lpad(cast(event_id as string), 114, '0'))
             when r in (0, 1, 5) then element_at({_arr(MODELS_OPENAI)}, m + 1)
             when r in (2, 4) then element_at({_arr(MODELS_ANTHROPIC)}, m + 1)
             else element_at({_arr(MODELS_GEMINI)}, m + 1) end as model""",
        f"element_at({_arr(PATHS)}, r + 1) as path",
        "timestamp_micros(unix_micros(requested_at) + upstream_us + 1500) as responded_at",
    )


def exchanges(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT,
              events: DataFrame | None = None) -> DataFrame:
    """Recorded exchanges, one per event (see FIXTURES.md 2.1)."""
    events = events if events is not None else table(spark, sf_dir, "events")
    p = exchange_params(spread(events, "event_id"))
    pre = "X-" + cfg.header_prefix[2:].upper() if cfg.header_prefix.startswith("x-") else cfg.header_prefix
    model_json = "case when k % 5 = 0 then '' else concat(',\"model\":\"', model, '\"') end"
    gem_model_json = "case when k % 5 = 0 then '' else concat(',\"modelVersion\":\"', model, '\"') end"
    stop = f"element_at({_arr(STOP_REASONS)}, cast(event_id % 5 as int) + 1)"
    response = f"""
      case when status_code is null then null
           when status_code = 500 then concat('{{"error":{{"message":"xy', repeat('é', 200 + k), '"}}}}')
           when event_id % 97 = 0 then '{{"usage": {{'
           when r in (0, 5) then concat('{{"id":"chatcmpl-', event_id, '","object":"chat.completion"', {model_json},
             ',"choices":[{{"index":0,"message":{{"role":"assistant","content":"ok"}},"finish_reason":"stop"}}],',
             '"usage":{{"prompt_tokens":', tin, ',"completion_tokens":', tout, ',"total_tokens":', tin + tout,
             ',"prompt_tokens_details":{{"cached_tokens":', cached, '}}}}}}')
           when r = 1 then concat('{{"id":"resp-', event_id, '","object":"response"', {model_json},
             ',"output":[{{"type":"message","content":[{{"type":"output_text","text":"ok"}}]}}],',
             '"usage":{{"input_tokens":', tin, ',"output_tokens":', tout, ',"total_tokens":', tin + tout,
             ',"input_tokens_details":{{"cached_tokens":', cached, '}},"output_tokens_details":{{"reasoning_tokens":', k, '}}}}}}')
           when r in (2, 4) then concat('{{"id":"msg-', event_id, '","type":"message","role":"assistant"', {model_json},
             ',"content":[{{"type":"text","text":"Hello"}},{{"type":"tool_use","id":"tu-', event_id,
             '","name":"lookup","input":{{"q":', k, '}}}},{{"type":"text","text":" world"}}],',
             '"stop_reason":"', {stop}, '","stop_sequence":null,',
             '"usage":{{"input_tokens":', tin - cached, ',"output_tokens":', tout,
             ',"cache_read_input_tokens":', cached, ',"cache_creation_input_tokens":', creation, '}}}}')
           else concat('{{"candidates":[{{"content":{{"parts":[{{"text":"ok"}}],"role":"model"}},"finishReason":"STOP"}}]',
             {gem_model_json}, ',"usageMetadata":{{"promptTokenCount":', tin, ',"candidatesTokenCount":', tout,
             ',"totalTokenCount":', tin + tout, ',"cachedContentTokenCount":', cached, '}}}}')
      end"""
    request = """
      case when event_id % 89 = 0 then '{bad'
           else concat('{"model":"', model, '","messages":[{"role":"system","content":"be brief"},',
                       '{"role":"user","content":"q', event_id, '"}]',
                       case when k % 2 = 0 then concat(',"max_tokens":', k * 10) else '' end, '}') end"""
    headers = f"""map_from_entries(filter(array(
        struct('{pre}-Key' as key, concat('{cfg.api_key_prefix}', user_id) as value),
        struct('{pre}-User-Id' as key, case when event_id % 10 = 9 then null else cast(user_id as string) end as value),
        struct('{pre}-Feature' as key, event_type as value),
        struct('{pre}-Step' as key, concat('s', k % 4) as value),
        struct('{pre}-Environment' as key, case when k % 2 = 0 then 'prod' else 'dev' end as value),
        struct('{pre}-Provider-Alias' as key, case when r = 1 then concat('team-', user_id % 3) end as value),
        struct('{pre}-Provider' as key, case when r = 4 then 'Anthropic-OpenAI'
                                      when r = 5 and event_id % 12 = 11 then 'Bedrock' end as value),
        struct('Content-Type' as key, 'application/json' as value)
      ), x -> x.value is not null))"""
    authorization = f"""
      case when event_id % 17 = 0 then null
           when (event_id div 6) % 3 = 0 then concat('Bearer {cfg.proxy_key_prefix}',
                case when event_id % 13 = 0 then user_id + 1 else user_id end)
           else concat('Bearer sk-', user_id % 4) end"""
    return p.selectExpr(
        "request_id", "event_id", "requested_at", "responded_at", "upstream_us",
        "'POST' as method", "path", f"{headers} as headers",
        f"concat('{cfg.api_key_prefix}', user_id) as api_key",
        f"{authorization} as authorization",
        f"{request} as request_body",
        "status_code",
        "case when status_code is null then null else map('Content-Type', 'application/json') end as response_headers",
        f"{response} as response_body",
    )


def api_keys(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """One API key per customer: i % 10 in 0-6 active, 7 revoked, 8 inactive,
    9 stored under a rotated secret (so requests with the old one are not found)."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        AK_ID + " as id",
        f"sha2(concat('{cfg.api_key_prefix}', c_custkey, case when c_custkey % 10 = 9 then '-rotated' else '' end), 256) as key_hash",
        "c_name as name", "c_mktsegment as description",
        "c_custkey % 10 not in (7, 8) as is_active",
        "timestamp_seconds(1672531200 + c_custkey) as created_at",
        "case when c_custkey % 10 = 7 then timestamp_seconds(1672531200 + c_custkey + 2592000) end as revoked_at",
        "cast(null as timestamp) as last_used_at",
        "cast(0 as bigint) as request_count",
        "case when c_custkey % 10 = 6 then null else concat('u', c_custkey div 3) end as user_id",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer (no password hash is carried)."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        "concat('u', c_custkey) as id",
        "lower(replace(c_name, '#', '-')) as username",
        "c_custkey % 7 != 6 as is_active",
        "timestamp_seconds(1669852800 + c_custkey) as created_at",
    )


def proxy_keys(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """One proxy key per customer, owned by the API key of the same customer:
    j % 8 in 0-3 and 6 active, 4 revoked, 5 inactive, 7 rotated."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        PK_ID + " as id",
        f"sha2(concat('{cfg.proxy_key_prefix}', c_custkey, case when c_custkey % 8 = 7 then '-rotated' else '' end), 256) as key_hash",
        "concat('proxy-', c_custkey) as name",
        "cast(null as string) as description",
        AK_ID + " as api_key_id",
        "c_custkey % 8 not in (4, 5) as is_active",
        "timestamp_seconds(1685577600 + c_custkey) as created_at",
        "case when c_custkey % 8 = 4 then timestamp_seconds(1685577600 + c_custkey + 864000) end as revoked_at",
        "cast(null as timestamp) as last_used_at",
        "cast(0 as bigint) as request_count",
    )


MAPPED_PROVIDERS = ["openai", "anthropic", "anthropic-openai"]


_STORED: dict[tuple, str] = {}


def mappings(spark: SparkSession, sf_dir: str, secret: str = FIXTURE_SECRET,
             other_secret: str = OTHER_SECRET) -> DataFrame:
    """Provider mappings as a stored table: encrypted once per application
    and input (like the gateway's table, whose keys are encrypted when set),
    then read back by every job instead of being encrypted again."""
    key = (spark.sparkContext.applicationId, sf_dir, secret, other_secret)
    path = _STORED.get(key)
    if path is None:
        from tokenledger.session import scratch_path
        path = scratch_path(spark, "mappings")
        build_mappings(spark, sf_dir, secret, other_secret).write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)


def build_mappings(spark: SparkSession, sf_dir: str, secret: str = FIXTURE_SECRET,
                   other_secret: str = OTHER_SECRET) -> DataFrame:
    """Provider mappings of proxy keys with j % 8 in 0-3 (openai, anthropic,
    anthropic-openai); j % 8 = 3 has its anthropic key under another secret."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")  # AES per row: use every core
    m = c.selectExpr(
        "c_custkey",
        f"explode(case when c_custkey % 8 < 4 then {_arr(MAPPED_PROVIDERS)} else cast(array() as array<string>) end) as provider",
    )
    plain = F.concat(F.lit("sk-"), F.col("provider"), F.lit("-"), F.col("c_custkey").cast("string"))
    wrong = (F.col("c_custkey") % 8 == 3) & (F.col("provider") == "anthropic")
    return m.select(
        F.expr(uuid_of("concat('map-', c_custkey, '-', provider)")).alias("id"),
        F.expr(uuid_of("concat('pk-', c_custkey)")).alias("proxy_key_id"),
        "provider",
        F.when(wrong, encrypt_secret(plain, other_secret)).otherwise(encrypt_secret(plain, secret)).alias("encrypted_key"),
        F.expr("timestamp_seconds(1688169600 + c_custkey)").alias("created_at"),
        F.expr("timestamp_seconds(1688169600 + c_custkey)").alias("updated_at"),
    )


METADATA_KEY_NAMES = ["feature", "user-id", "step"]


def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered metadata keys per API key: feature and user-id active for
    even keys, step for keys with i % 10 = 1, the rest registered inactive."""
    c = table(spark, sf_dir, "customer")
    k = c.selectExpr(
        AK_ID + " as api_key_id", "c_custkey",
        f"explode({_arr(METADATA_KEY_NAMES)}) as key_name",
    )
    return k.selectExpr(
        "api_key_id", "key_name",
        "cast(null as string) as display_name", "'string' as key_type", "false as is_required",
        "(key_name in ('feature', 'user-id') and c_custkey % 2 = 0) or (key_name = 'step' and c_custkey % 10 = 1) as is_active",
        "cast(null as timestamp) as activated_at",
        "cast(0 as bigint) as request_count",
        "cast(null as timestamp) as last_seen_at",
        "cast(null as binary) as hll_state",
        "0 as approx_cardinality",
        "cast(null as timestamp) as hll_updated_at",
        "timestamp_seconds(1672531200 + c_custkey) as created_at",
    )


@dataclass
class Dims:
    api_keys: DataFrame
    proxy_keys: DataFrame
    mappings: DataFrame
    metadata_keys: DataFrame
    prices: DataFrame
    aliases: DataFrame
    secret: str = FIXTURE_SECRET
    #: key tables hold what is folded into them (``enrich.fold``)
    folded: bool = False

    def persisted(self) -> "Dims":
        """The same snapshot, kept in executor memory (recomputed from its
        lineage if an executor is lost): a stream joins it in every
        micro-batch without rebuilding it."""
        return Dims(self.api_keys.persist(), self.proxy_keys.persist(), self.mappings.persist(),
                    self.metadata_keys.persist(), self.prices, self.aliases, self.secret)

    def unpersisted(self) -> None:
        for df in (self.api_keys, self.proxy_keys, self.mappings, self.metadata_keys):
            df.unpersist()


def load_dims(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT) -> Dims:
    return Dims(
        api_keys=api_keys(spark, sf_dir, cfg),
        proxy_keys=proxy_keys(spark, sf_dir, cfg),
        mappings=mappings(spark, sf_dir),
        metadata_keys=metadata_keys(spark, sf_dir),
        prices=price_src.load_prices(spark),
        aliases=price_src.load_aliases(spark),
    )


# --- change batches for the maintenance operators (all derived from customer)

CHANGE_TS = "2024-02-01 00:00:00"
UNKNOWN_OFFSET = 1_000_000_000


def mapping_changes(spark: SparkSession, sf_dir: str, secret: str = FIXTURE_SECRET) -> DataFrame:
    """M1 batch: every fifth customer's proxy key sets 'openai' (twice for
    every tenth, the later one wins) and adds 'gemini'."""
    c = table(spark, sf_dir, "customer")
    ch = c.selectExpr("c_custkey", """explode(case when c_custkey % 5 = 0 then array(
        named_struct('provider', 'openai', 'seq', 1),
        named_struct('provider', 'openai', 'seq', case when c_custkey % 10 = 0 then 2 else 0 end),
        named_struct('provider', 'gemini', 'seq', 1)) else array() end) as ch""") \
        .where("ch.seq > 0").select("c_custkey", "ch.provider", "ch.seq")
    plain = F.concat(F.lit("sk-new"), F.col("seq").cast("string"), F.lit("-"), F.col("c_custkey").cast("string"))
    return ch.select(
        F.expr(PK_ID).alias("proxy_key_id"), "provider", encrypt_secret(plain, secret).alias("encrypted_key"),
        F.col("seq").cast("int").alias("seq"),
        F.expr(uuid_of("concat('map-new-', c_custkey, '-', provider)")).alias("new_id"),
    )


def revoke_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 batch: API keys of every fourth customer, plus unknown ids."""
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 4 = 0").selectExpr(AK_ID + " as id")
    unknown = c.where("c_custkey % 20 = 0").selectExpr(
        uuid_of(f"concat('ak-', c_custkey + {UNKNOWN_OFFSET})") + " as id")
    return known.unionByName(unknown)


def api_key_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 batch: every third customer's key: new name on even ids, new
    description on multiples of 5 (neither -> nothing to set); plus unknown ids."""
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 = 0").selectExpr(
        AK_ID + " as id", "case when c_custkey % 2 = 0 then upper(c_name) end as name",
        "case when c_custkey % 5 = 0 then concat('patched-', c_custkey) end as description", "1 as seq")
    unknown = c.where("c_custkey % 21 = 0").selectExpr(
        uuid_of(f"concat('ak-', c_custkey + {UNKNOWN_OFFSET})") + " as id", "'x' as name",
        "cast(null as string) as description", "1 as seq")
    return known.unionByName(unknown)


def mapping_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 batch: (proxy key, anthropic) and (proxy key, gemini) of every sixth customer."""
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey % 6 = 0").selectExpr(
        PK_ID + " as proxy_key_id", "explode(array('anthropic', 'gemini')) as provider")


def new_api_keys(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """M6 batch: one new key per customer; neighbours share a secret (in-batch
    duplicates) and every 50th reuses an existing key's secret."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        uuid_of("concat('new-ak-', c_custkey)") + " as id",
        f"""sha2(case when c_custkey % 50 = 0 then concat('{cfg.api_key_prefix}', c_custkey)
                 else concat('{cfg.api_key_prefix}new_', c_custkey div 2) end, 256) as key_hash""",
        "concat('new-', c_name) as name", "cast(null as string) as description",
        "timestamp '2024-02-01 00:00:00' as created_at", "cast(null as string) as user_id",
        "c_custkey as seq",
    )


def dropped_proxy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 batch: proxy keys of every tenth customer."""
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey % 10 = 0").selectExpr(PK_ID + " as id")


def new_proxy_keys(spark: SparkSession, sf_dir: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """M6 batch for proxy keys: one per customer; those with i % 8 = 4 or 5 reuse the
    customer's stored secret, those with i % 8 = 7 share one with a neighbour."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        uuid_of("concat('new-pk-', c_custkey)") + " as id",
        f"""sha2(case when c_custkey % 8 in (4, 5) then concat('{cfg.proxy_key_prefix}', c_custkey)
                 when c_custkey % 8 = 7 then concat('{cfg.proxy_key_prefix}new_', c_custkey div 16)
                 else concat('{cfg.proxy_key_prefix}new_', c_custkey) end, 256) as key_hash""",
        "concat('new-', c_name) as name", "cast(null as string) as description", AK_ID + " as api_key_id",
        "timestamp '2024-02-01 00:00:00' as created_at", "c_custkey as seq",
    )
