"""Key usage counters (U1, U2): counts of resolved requests per key, and their
fold into the key tables.

Both are partial + final aggregations: a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.session import dim_side


def _usage(resolved: DataFrame, status: str, key: str) -> DataFrame:
    return (resolved.where(F.col(status) == "ok").groupBy(key)
            .agg(F.count(F.lit(1)).alias("requests"), F.max("requested_at").alias("last_used_at")))


def api_key_usage(resolved: DataFrame) -> DataFrame:
    """U1 over J1 output: every request whose key resolved ``ok`` uses the
    key, whether or not it was logged afterwards."""
    return _usage(resolved, "api_key_status", "api_key_id")


def proxy_key_usage(resolved: DataFrame) -> DataFrame:
    """U2 over J2 output, likewise for proxy keys."""
    return _usage(resolved.where(F.col("proxy_key_id").isNotNull()), "proxy_status", "proxy_key_id")


def apply_usage(keys: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """The next snapshot of a key table: counts added, the later use kept.
    Keys without use stay as they are; usage of unknown keys is ignored."""
    u = usage.select(F.col(key).alias("_id"), F.col("requests").alias("_n"), F.col("last_used_at").alias("_t"))
    j = keys.join(dim_side(u), keys["id"] == F.col("_id"), "left")
    new = {"request_count": F.coalesce(F.col("request_count"), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0)),
           "last_used_at": F.greatest("last_used_at", "_t")}
    return j.select(*[new[c].cast(keys.schema[c].dataType).alias(c) if c in new else keys[c] for c in keys.columns])
