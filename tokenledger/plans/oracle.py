"""Reference answers in DuckDB SQL, computed from the base tables only.

The oracle never parses the JSON the Spark fixture writes: it derives the
expected provider, model, token counts, statuses and costs directly from the
``events`` / ``customer`` columns with the fixture formulas (FIXTURES.md), so
a Spark query and its oracle are two independent computations.
"""

from __future__ import annotations

import json
import os

from tokenledger.plans import fixtures as FX

RES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")


def _str_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _prices_sql() -> str:
    with open(os.path.join(RES, "prices.json")) as f:
        doc = json.load(f)
    last = {}
    for p in doc["prices"]:
        last[p["id"]] = p
    rows = [f"('{k}', CAST({float(p['input'])} AS DOUBLE), CAST({float(p['output'])} AS DOUBLE), "
            f"CAST({float(p.get('input_cached') or 0.0)} AS DOUBLE))"
            for k, p in last.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(model, input_price, output_price, cached_price)"


def _aliases_sql() -> str:
    with open(os.path.join(RES, "model_aliases.json")) as f:
        doc = json.load(f)
    rows = [f"('{k}', '{v}')" for k, v in doc.items() if isinstance(v, str)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(alias, target)"


def uuid_sql(expr: str) -> str:
    h = f"md5({expr})"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12))"


def ts_sql(base_epoch: int, plus: str) -> str:
    return f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({base_epoch} + {plus} AS BIGINT)))"


def dec(x: str) -> str:
    """Double -> NUMERIC(12,8) the way the log table stores it."""
    return f"TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(12,8))"


def map_text(entries: list[tuple[str, str, str]]) -> str:
    """Sorted ``k=v`` text of a map given (key, value_expr, present_cond)."""
    items = ", ".join(f"CASE WHEN {c} THEN '{k}=' || ({v}) END" for k, v, c in entries)
    return f"array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ';')"


def fits_bytes(b: str, n: int) -> str:
    """Longest character prefix of ``b`` with at most ``n`` UTF-8 bytes."""
    return (f"CASE WHEN strlen({b}) <= {n} THEN {b} ELSE left({b}, "
            f"len(list_filter(range(1, length({b}) + 1), lambda i: strlen(left({b}, CAST(i AS BIGINT))) <= {n}))) END")


BASE = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS requested_at,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(event_id % 6 AS INTEGER) AS r, CAST((event_id // 6) % 4 AS INTEGER) AS m,
         md5('req-' || event_id) AS request_id,
         (50 + event_id % 950) * 1000 + event_id % 1000 AS upstream_us,
         CAST(floor(value * 10) AS BIGINT) + CASE WHEN event_id % 223 = 0 THEN 3000000000 ELSE 0 END AS tin,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
  FROM events
),
ev2 AS (
  SELECT *, CAST(3 * k + 1 AS BIGINT) AS tout,
         CASE WHEN event_id % 5 = 0 THEN tin // 2 ELSE 0 END AS cached,
         CASE WHEN event_id % 7 = 0 THEN CAST(k AS BIGINT) ELSE 0 END AS creation,
         CASE WHEN event_id % 211 = 0 THEN 'model-' || lpad(CAST(event_id AS VARCHAR), 114, '0')
              WHEN r IN (0, 1, 5) THEN {_str_list(FX.MODELS_OPENAI)}[m + 1]
              WHEN r IN (2, 4) THEN {_str_list(FX.MODELS_ANTHROPIC)}[m + 1]
              ELSE {_str_list(FX.MODELS_GEMINI)}[m + 1] END AS model,
         {_str_list(FX.PATHS)}[r + 1] AS path,
         requested_at + to_microseconds(CAST(upstream_us + 1500 AS BIGINT)) AS responded_at,
         CASE WHEN r = 4 THEN 'anthropic-openai'
              WHEN r = 5 AND event_id % 12 = 11 THEN 'bedrock'
              WHEN r = 2 THEN 'anthropic' WHEN r = 3 THEN 'gemini' ELSE 'openai' END AS detected,
         CASE WHEN event_id % 17 = 0 THEN NULL
              WHEN (event_id // 6) % 3 = 0 THEN 'Bearer gwpk_' || CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END
              ELSE 'Bearer sk-' || (user_id % 4) END AS auth_hdr,
         CASE WHEN event_id % 17 <> 0 AND (event_id // 6) % 3 = 0
              THEN CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END END AS proxy_j
  FROM ev
),
cust AS (SELECT c_custkey AS i, c_name, c_mktsegment FROM customer),
res AS (
  SELECT e.*,
    CASE WHEN a.i IS NULL OR a.i % 10 = 9 THEN 'not_found'
         WHEN a.i % 10 = 7 THEN 'revoked' WHEN a.i % 10 = 8 THEN 'inactive' ELSE 'ok' END AS api_key_status,
    CASE WHEN e.proxy_j IS NULL THEN 'passthrough'
         WHEN p.i IS NULL OR p.i % 8 = 7 THEN 'not_found'
         WHEN p.i % 8 = 4 THEN 'revoked' WHEN p.i % 8 = 5 THEN 'inactive'
         WHEN p.i <> e.user_id OR a.i IS NULL OR a.i % 10 = 9 THEN 'wrong_owner'
         WHEN NOT (p.i % 8 < 4 AND e.detected IN ('openai', 'anthropic', 'anthropic-openai')) THEN 'no_mapping'
         WHEN p.i % 8 = 3 AND e.detected = 'anthropic' THEN 'decrypt_failed'
         ELSE 'ok' END AS proxy_status,
    {uuid_sql("'ak-' || e.user_id")} AS api_key_id_if_found,
    a.c_name AS api_key_name,
    CASE WHEN e.user_id % 10 = 6 THEN NULL ELSE 'u' || (e.user_id // 3) END AS owner_user
  FROM ev2 e
  LEFT JOIN cust a ON a.i = e.user_id
  LEFT JOIN cust p ON p.i = e.proxy_j
),
lg0 AS (
  SELECT *,
    CASE WHEN status_code = 500 THEN 'error' WHEN event_id % 97 = 0 THEN 'malformed' ELSE 'normal' END AS kind,
    CASE WHEN event_id % 89 = 0 THEN 'unknown' ELSE model END AS req_model
  FROM res
  WHERE status_code IS NOT NULL
),
us_all AS (
  SELECT *,
    kind <> 'malformed' AS parse_ok,
    CASE WHEN kind = 'malformed' THEN detected
         WHEN detected IN ('anthropic', 'gemini') THEN detected ELSE 'openai' END AS provider,
    CASE WHEN kind = 'normal' AND k % 5 <> 0 THEN model ELSE req_model END AS log_model,
    CASE WHEN kind <> 'normal' THEN 0
         WHEN r = 2 THEN tin + creation WHEN r = 4 THEN tin - cached ELSE tin END AS input_tokens,
    CASE WHEN kind <> 'normal' THEN 0 ELSE tout END AS output_tokens,
    CASE WHEN kind <> 'normal' OR r = 4 THEN 0 ELSE cached END AS cached_tokens,
    CASE WHEN kind = 'normal' AND r = 2 THEN creation ELSE 0 END AS cache_creation_tokens,
    CASE WHEN r = 4 AND event_id % 89 <> 0 THEN '/v1/messages' ELSE path END AS request_path,
    CASE WHEN status_code = 500 THEN '{{"error":{{"message":"xy' || repeat('é', 200 + k) || '"}}}}' END AS err_body
  FROM lg0
),
us AS (SELECT * FROM us_all WHERE api_key_status = 'ok' AND proxy_status IN ('ok', 'passthrough')),
prices AS ({_prices_sql()}),
aliases AS ({_aliases_sql()}),
lookup AS (
  SELECT model AS name, input_price, output_price, cached_price FROM prices
  UNION ALL
  SELECT a.alias, p.input_price, p.output_price, p.cached_price
  FROM aliases a JOIN prices p ON a.target = p.model
  WHERE a.alias NOT IN (SELECT model FROM prices)
),
priced AS (
  SELECT u.*, l.input_price, l.output_price, l.cached_price, l.name IS NOT NULL AS model_alias_found,
    COALESCE(CAST(u.input_tokens - u.cached_tokens AS DOUBLE) * l.input_price / 1000000.0
             + CAST(u.cached_tokens AS DOUBLE) * l.cached_price / 1000000.0, 0.0) AS in_d,
    COALESCE(CAST(u.output_tokens AS DOUBLE) * l.output_price / 1000000.0, 0.0) AS out_d,
    COALESCE(CAST(u.input_tokens - u.cached_tokens AS DOUBLE) * l.input_price / 1000000.0
             + CAST(u.cached_tokens AS DOUBLE) * l.cached_price / 1000000.0
             + CAST(u.output_tokens AS DOUBLE) * l.output_price / 1000000.0, 0.0) AS tot_d
  FROM us u LEFT JOIN lookup l ON l.name = u.log_model
),
req_all AS (
  SELECT
    request_id AS id, owner_user AS user_id, api_key_id_if_found AS api_key_id,
    CASE WHEN proxy_status = 'ok' THEN {uuid_sql("'pk-' || proxy_j")} END AS proxy_key_id,
    CASE WHEN auth_hdr IS NOT NULL THEN sha256(auth_hdr) END AS provider_api_key_hash,
    CASE WHEN r = 1 THEN 'team-' || (user_id % 3) END AS provider_api_key_alias,
    provider, log_model AS model, request_path, 'POST' AS request_method,
    requested_at, responded_at, upstream_us // 1000 AS response_time_ms,
    input_tokens, output_tokens, cached_tokens, cache_creation_tokens,
    {dec('in_d')} AS input_cost, {dec('out_d')} AS output_cost, {dec('tot_d')} AS total_cost,
    status_code,
    CASE WHEN err_body IS NOT NULL THEN {fits_bytes('err_body', 500)} END AS error_message,
    {map_text([('environment', "CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END", 'TRUE'),
               ('feature', 'event_type', 'TRUE'),
               ('step', "'s' || (k % 4)", 'TRUE'),
               ('user-id', 'CAST(user_id AS VARCHAR)', 'event_id % 10 <> 9')])} AS raw_metadata,
    {map_text([('feature', 'event_type', 'user_id % 2 = 0'),
               ('step', "'s' || (k % 4)", 'user_id % 10 = 1'),
               ('user-id', 'CAST(user_id AS VARCHAR)', 'event_id % 10 <> 9 AND user_id % 2 = 0')])} AS indexed_metadata,
    responded_at AS created_at,
    substr({uuid_sql("'ak-' || user_id")}, 1, 16) || '/' || strftime(requested_at, '%Y-%m-%d') || '/' || request_id || '.json.gz' AS body_s3_key,
    model_alias_found, CAST(requested_at AS DATE) AS requested_date,
    CASE WHEN length(log_model) > 100 THEN 'model_too_long'
         WHEN input_tokens NOT BETWEEN -2147483648 AND 2147483647 THEN 'input_tokens_out_of_range'
         WHEN output_tokens NOT BETWEEN -2147483648 AND 2147483647 THEN 'output_tokens_out_of_range'
         WHEN cached_tokens NOT BETWEEN -2147483648 AND 2147483647 THEN 'cached_tokens_out_of_range'
         WHEN cache_creation_tokens NOT BETWEEN -2147483648 AND 2147483647 THEN 'cache_creation_tokens_out_of_range'
         END AS reject_reason,
    event_id, user_id AS event_user, event_type, k, r, detected, kind, err_body
  FROM priced
),
req AS (SELECT * FROM req_all WHERE reject_reason IS NULL)
"""


def with_base(select: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH <base CTEs>[, extra] select``; ``extra`` may add CTEs."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + BASE.strip() + (",\n" + extra.strip() if extra else "") + "\n" + select


LOG_SELECT = """id, user_id, api_key_id, proxy_key_id, provider_api_key_hash, provider_api_key_alias, provider, model,
  request_path, request_method, requested_at, responded_at, CAST(response_time_ms AS INTEGER) AS response_time_ms,
  CAST(input_tokens AS INTEGER) AS input_tokens, CAST(output_tokens AS INTEGER) AS output_tokens,
  CAST(cached_tokens AS INTEGER) AS cached_tokens, CAST(cache_creation_tokens AS INTEGER) AS cache_creation_tokens,
  input_cost, output_cost, total_cost, status_code, error_message, raw_metadata, indexed_metadata,
  created_at, body_s3_key, model_alias_found, requested_date"""
