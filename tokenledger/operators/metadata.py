"""Metadata indexing (J5) and per-key distinct-value sketches (H1-H3).

Sketches are Spark's HLL sketches (``hll_sketch_agg`` / ``hll_union_agg``),
which aggregate partially on the map side: a hot (api key, metadata key)
pair is combined per partition before the shuffle, so no task ever holds
its raw values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.session import dim_side

LG_K = 14  # 2^14 registers, ~16 KB per sketch, ~0.8 % standard error


def active_key_names(metadata_keys: DataFrame) -> DataFrame:
    """``api_key_id -> active_keys`` (array). One row per API key with any
    active metadata key; the array is bounded by the key names registered."""
    return (
        metadata_keys.where(F.col("is_active"))
        .groupBy("api_key_id")
        .agg(F.array_sort(F.collect_set("key_name")).alias("active_keys"))
    )


def indexed_metadata(raw: Column, active_keys: Column) -> Column:
    """Entries of ``raw`` whose key is active; no active keys -> {}."""
    keys = F.coalesce(active_keys, F.array().cast("array<string>"))
    return F.map_filter(F.coalesce(raw, F.create_map().cast("map<string,string>")),
                        lambda k, v: F.array_contains(keys, k))


def metadata_key_stats(requests: DataFrame, api_key_id_col: str = "api_key_id",
                       raw_col: str = "raw_metadata", ts_col: str = "responded_at") -> DataFrame:
    """H1: per (api_key_id, key_name): sketch of values, request count, last
    seen, approximate cardinality."""
    e = requests.where(F.col(api_key_id_col).isNotNull()).select(
        F.col(api_key_id_col).alias("api_key_id"), F.col(ts_col).alias("_ts"),
        F.explode(raw_col).alias("key_name", "value"))
    g = e.groupBy("api_key_id", "key_name").agg(
        F.hll_sketch_agg("value", LG_K).alias("hll_state"),
        F.count(F.lit(1)).alias("request_count"),
        F.max("_ts").alias("last_seen_at"),
    )
    return g.withColumn("approx_cardinality", F.hll_sketch_estimate("hll_state"))


def merge_key_stats(state: DataFrame, delta: DataFrame) -> DataFrame:
    """H2: fold new stats into persisted ones: sketch union, counts added,
    last seen advanced. Keys missing from ``state`` are inserted (the
    reference silently loses those counts)."""
    cols = ["api_key_id", "key_name", "hll_state", "request_count", "last_seen_at"]
    return fold_key_stats(state.select(*cols).unionByName(delta.select(*cols)))


def fold_key_stats(stats: DataFrame) -> DataFrame:
    """H2 within one table: one row per key, of all its sketches and counts."""
    g = stats.groupBy("api_key_id", "key_name").agg(
        F.hll_union_agg("hll_state", True).alias("hll_state"),
        F.sum("request_count").cast("bigint").alias("request_count"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return g.withColumn("approx_cardinality", F.hll_sketch_estimate("hll_state"))


def key_cardinality(state: DataFrame) -> DataFrame:
    """H3: cardinality read-out from stored sketch bytes."""
    return state.select("api_key_id", "key_name",
                        F.hll_sketch_estimate("hll_state").alias("approx_cardinality"))


def apply_key_stats(metadata_keys: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of the metadata-key table: sketch, estimate, count
    and last use of H1/H2 written back, ``hll_updated_at`` set where they
    were. Keys without statistics stay as they are."""
    keys = ["api_key_id", "key_name"]
    fresh = ["hll_state", "approx_cardinality", "request_count", "last_seen_at"]
    s = stats.select(*keys, *[F.col(c).alias(f"_{c}") for c in fresh], F.lit(True).alias("_hit"))
    j = metadata_keys.join(dim_side(s), keys, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fresh}
    new["hll_updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("hll_updated_at"))
    return j.select(*[new.get(c, F.col(c)).cast(metadata_keys.schema[c].dataType).alias(c) for c in metadata_keys.columns])
