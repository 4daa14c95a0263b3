"""Header, key and text helpers (P1, P2, P11-P16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger.config import DEFAULT, LedgerConfig

BEARER = "Bearer "


def extract_headers(headers: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """Gateway headers, names lower-cased, first value of a repeated name.

    Recorded maps may hold the same name in two letter cases; entries are
    folded in order so the first one wins instead of a duplicate-key error.
    """
    kept = F.map_filter(headers, lambda k, v: F.lower(k).startswith(cfg.header_prefix))
    lowered = F.transform(F.map_keys(kept), lambda k: F.lower(k))
    clash = F.size(F.array_distinct(lowered)) < F.size(lowered)
    fast = F.map_from_arrays(lowered, F.map_values(kept))
    entries = F.transform(F.map_entries(kept),
                          lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    empty = F.create_map().cast("map<string,string>")
    slow = F.aggregate(
        entries, empty,
        lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc)
        .otherwise(F.map_concat(acc, F.create_map(e["key"], e["value"]))),
    )
    # the fold only runs for the rare map holding one name in two letter cases
    return F.when(F.coalesce(clash, F.lit(False)), slow).otherwise(fast)


def custom_metadata(gw_headers: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """Drop the reserved key/provider/alias headers and strip ``<prefix>-``;
    of two headers that come to share a name the first one stays."""
    reserved = [cfg.key_header, cfg.provider_header, cfg.alias_header]
    kept = F.map_filter(gw_headers, lambda k, v: ~k.isin(reserved))
    # one pass over few entries; the map is mentioned once, so plans stay small
    return F.aggregate(
        F.map_entries(kept), F.create_map().cast("map<string,string>"),
        lambda acc, e: F.when(F.map_contains_key(acc, _stripped(e["key"], cfg)), acc)
        .otherwise(F.map_concat(acc, F.create_map(_stripped(e["key"], cfg), e["value"]))))


def _stripped(k: Column, cfg: LedgerConfig) -> Column:
    head = cfg.header_prefix + "-"
    return F.when(k.startswith(head), F.substring(k, len(head) + 1, 1 << 30)).otherwise(k)


def hash_key(c: Column) -> Column:
    """SHA-256 hex of the whole value; absent or empty -> null."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.sha2(c, 256))


def strip_bearer(authorization: Column) -> Column:
    """Token of an Authorization header: ``Bearer `` removed once, absent -> ''."""
    a = F.coalesce(authorization, F.lit(""))
    return F.when(a.startswith(BEARER), F.substring(a, len(BEARER) + 1, 1 << 30)).otherwise(a)


def key_format_ok(key: Column, prefix: str) -> Column:
    """Has the prefix and something after it."""
    return F.coalesce(key.startswith(prefix) & (F.length(key) > len(prefix)), F.lit(False))


def truncate_bytes(c: Column, n: int) -> Column:
    """Keep at most ``n`` UTF-8 bytes, dropping a character cut in half.

    A character is at most 4 bytes, so one of the cuts at n, n-1, n-2, n-3
    bytes ends on a character boundary.
    """
    b = F.encode(c, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(b, 1, max(n - d, 0)).cast("string")) for d in range(4)]
    return F.when(F.octet_length(c) <= n, c).otherwise(F.coalesce(*cuts))


def error_message(status: Column, body: Column, cfg: LedgerConfig = DEFAULT) -> Column:
    """First bytes of the body of a response with status >= 400, else null."""
    return F.when(status >= 400, truncate_bytes(F.coalesce(body, F.lit("")), cfg.error_message_bytes))


def body_key(api_key_id: Column, request_id: Column, ts: Column) -> Column:
    """``first16(api_key_id)/yyyy-MM-dd/request_id.json.gz`` (UTC date)."""
    return F.concat(
        F.substring(api_key_id, 1, 16), F.lit("/"), F.date_format(ts, "yyyy-MM-dd"), F.lit("/"),
        request_id, F.lit(".json.gz"),
    )


def _whole_ms(us: Column) -> Column:
    """Whole milliseconds, in integer arithmetic."""
    return F.call_function("div", us - F.pmod(us, F.lit(1000).cast("bigint")), F.lit(1000).cast("bigint"))


def response_time_ms(upstream_us: Column, requested_at: Column | None = None,
                     responded_at: Column | None = None) -> Column:
    """Upstream time in whole ms (truncated); wall-clock difference if unrecorded."""
    ms = _whole_ms(upstream_us)
    if requested_at is not None and responded_at is not None:
        wall = _whole_ms(F.unix_micros(responded_at) - F.unix_micros(requested_at))
        ms = F.coalesce(ms, wall)
    return ms
