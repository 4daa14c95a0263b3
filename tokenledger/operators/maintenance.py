"""Bulk dimension maintenance (M1-M7): each takes the current dimension and
a batch of changes and returns the new dimension plus a per-change status.

Plain Parquet has no MERGE, so every operation is a join that produces the
next snapshot; the caller writes it to a new directory (never in place), so
a retried job recomputes the same snapshot from the same inputs. Joins are
on the table keys; the change batch is usually the small side and goes
through the size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.session import dim_side


# Fixed value: length of the metadata-key name column.
MAX_KEY_NAME = 255


def _last_per_key(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Later changes to the same key replace earlier ones (by ``seq``; of
    changes with equal ``seq`` the largest row wins, so a retry agrees).

    A max_by aggregation: partial per partition, bounded per key."""
    other = [c for c in changes.columns if c not in keys]
    agg = changes.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(seq, F.struct(*other))).alias("_c"))
    return agg.select(*keys, *[F.col(f"_c.{c}").alias(c) for c in other])


def upsert_mappings(mappings: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """M1 as (new dimension, per-row status); see ``upsert_mappings_annotated``."""
    new = upsert_mappings_annotated(mappings, changes, now)
    return new.drop("status", "applied_seq"), new.select("proxy_key_id", "provider", "status", "applied_seq")


def upsert_mappings_annotated(mappings: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """M1: INSERT ... ON CONFLICT (proxy_key_id, provider) DO UPDATE key, updated_at.

    ``changes``: proxy_key_id, provider, encrypted_key, seq, new_id. Existing
    rows keep id and created_at; new rows get created_at = updated_at = now.

    The dimension is never shuffled when the batch is small: updates are a
    left join against the (size-checked) broadcast batch, inserts are the
    batch minus the keys a semi join found in the dimension.
    """
    keys = ["proxy_key_id", "provider"]
    ch = _last_per_key(changes, keys).select(
        *keys, F.col("encrypted_key").alias("_new_key"), F.col("new_id").alias("_new_id"), F.col("seq").alias("_seq"))
    updated = mappings.join(dim_side(ch), keys, "left")
    hit = F.col("_new_key").isNotNull()
    kept_or_updated = updated.select(
        "id", *keys,
        F.when(hit, F.col("_new_key")).otherwise(F.col("encrypted_key")).alias("encrypted_key"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.lit("updated")).otherwise(F.lit("kept")).alias("status"),
        F.col("_seq").alias("applied_seq"),
    )
    present = mappings.select(*keys).join(dim_side(ch.select(*keys)), keys, "left_semi")
    inserts = ch.join(dim_side(present), keys, "left_anti").select(
        F.col("_new_id").alias("id"), *keys, F.col("_new_key").alias("encrypted_key"),
        now.alias("created_at"), now.alias("updated_at"), F.lit("inserted").alias("status"),
        F.col("_seq").alias("applied_seq"))
    return kept_or_updated.unionByName(inserts)


def register_metadata_keys(metadata_keys: DataFrame, observed: DataFrame) -> DataFrame:
    """M2: ON CONFLICT DO NOTHING. ``observed`` (api_key_id, key_name) pairs
    not yet registered are added, inactive. Adds ``is_new``. Names longer
    than the table's column are left to ``refused_metadata_keys``."""
    seen = observed.where(F.length("key_name") <= MAX_KEY_NAME).select("api_key_id", "key_name").distinct()
    new = seen.join(metadata_keys.select("api_key_id", "key_name"), ["api_key_id", "key_name"], "left_anti")
    defaults = {"is_active": F.lit(False), "key_type": F.lit("string"), "is_required": F.lit(False),
                "request_count": F.lit(0), "approx_cardinality": F.lit(0)}
    added = new.select(*[
        F.col(f.name) if f.name in ("api_key_id", "key_name")
        else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in metadata_keys.schema.fields])
    return metadata_keys.withColumn("is_new", F.lit(False)).unionByName(added.withColumn("is_new", F.lit(True)))


def refused_metadata_keys(observed: DataFrame) -> DataFrame:
    """Observed pairs that M2 cannot register, with the reason."""
    return (observed.where(F.length("key_name") > MAX_KEY_NAME).select("api_key_id", "key_name").distinct()
            .withColumn("reason", F.lit("key_name_too_long")))


def revoke_keys(keys: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """M3: ``is_active = false, revoked_at = now`` only where still active.

    Works for API keys and proxy keys alike. Returns the new dimension with
    ``status``: revoked / not_found (unknown id or already inactive) /
    untouched; unknown ids appear as rows with only id and status. The id
    batch is the broadcast side; the dimension is not shuffled.
    """
    req = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    j = keys.join(dim_side(req), "id", "left")
    asked = F.coalesce(F.col("_asked"), F.lit(False))
    hit = asked & F.coalesce(F.col("is_active"), F.lit(False))
    out = (j.withColumn("status", F.when(hit, F.lit("revoked")).when(asked, F.lit("not_found"))
                        .otherwise(F.lit("untouched")))
           .withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at")))
           .withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
           .drop("_asked"))
    found = keys.select("id").join(dim_side(req.select("id")), "id", "left_semi")
    unknown = req.select("id").join(dim_side(found), "id", "left_anti")
    missing = unknown.select("id", *[F.lit(None).cast(f.dataType).alias(f.name)
                                     for f in keys.schema.fields if f.name != "id"],
                             F.lit("not_found").alias("status"))
    return out.unionByName(missing)


def patch_api_keys(api_keys: DataFrame, patches: DataFrame) -> DataFrame:
    """M4: set name and/or description; null leaves a field alone; a patch
    with nothing to set leaves the row unchanged; unknown ids -> not_found.

    ``patches``: id, name, description, seq (last patch per id wins). The
    patch batch is the broadcast side; the dimension is not shuffled.
    """
    p = _last_per_key(patches, ["id"]).select(
        "id", F.col("name").alias("_p_name"), F.col("description").alias("_p_desc"), F.lit(True).alias("_asked"))
    j = api_keys.join(dim_side(p), "id", "left")
    asked = F.coalesce(F.col("_asked"), F.lit(False))
    sets = F.col("_p_name").isNotNull() | F.col("_p_desc").isNotNull()
    status = F.when(asked & sets, F.lit("updated")).when(asked, F.lit("unchanged")).otherwise(F.lit("untouched"))
    out = (j.withColumn("name", F.coalesce("_p_name", "name"))
           .withColumn("description", F.coalesce("_p_desc", "description"))
           .withColumn("status", status)
           .drop("_p_name", "_p_desc", "_asked"))
    found = api_keys.select("id").join(dim_side(p.select("id")), "id", "left_semi")
    unknown = p.join(dim_side(found), "id", "left_anti")
    missing = unknown.select("id", *[
        (F.col("_p_name") if f.name == "name" else F.col("_p_desc") if f.name == "description"
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in api_keys.schema.fields if f.name != "id"], F.lit("not_found").alias("status"))
    return out.unionByName(missing)


def delete_mappings(mappings: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: delete by (proxy_key_id, provider); missing pairs are reported."""
    d = deletes.select("proxy_key_id", "provider").distinct()
    kept = mappings.join(dim_side(d), ["proxy_key_id", "provider"], "left_anti")
    found = d.join(mappings.select("proxy_key_id", "provider", F.lit(True).alias("_hit")),
                   ["proxy_key_id", "provider"], "left")
    status = found.select("proxy_key_id", "provider",
                          F.when(F.col("_hit"), F.lit("deleted")).otherwise(F.lit("missing")).alias("status"))
    return kept, status


def create_keys(keys: DataFrame, new_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: insert with a UNIQUE key_hash, in ``seq`` order: the first of a
    hash wins (the smaller id among equal ``seq``), later ones in the batch and hashes already stored are refused.

    ``new_keys``: id, key_hash, name, description, seq (+ owner columns).
    New rows are active with request_count 0.
    """
    # first seq per hash by aggregation (map-side partial), not a window sort,
    # so a hash repeated many times never lands in one sorted partition
    firsts = new_keys.groupBy("key_hash").agg(F.min(F.struct("seq", "id")).alias("_first"))
    existing = keys.select("key_hash", F.lit(True).alias("_exists"))
    tagged = new_keys.join(firsts, "key_hash", "inner").join(existing, "key_hash", "left").withColumn(
        "status",
        F.when(F.col("_exists"), F.lit("duplicate_existing"))
        .when(F.struct("seq", "id") != F.col("_first"), F.lit("duplicate_in_batch"))
        .otherwise(F.lit("created")))
    created = tagged.where(F.col("status") == "created")
    cols = keys.columns
    extra = {
        "is_active": F.lit(True), "request_count": F.lit(0).cast("bigint"),
        "revoked_at": F.lit(None).cast("timestamp"), "last_used_at": F.lit(None).cast("timestamp"),
    }
    rows = created.select(*[
        (F.col(c) if c in created.columns and c not in extra else extra.get(c, F.lit(None)).cast(keys.schema[c].dataType)).alias(c)
        for c in cols])
    return keys.unionByName(rows), tagged.select("id", "key_hash", "seq", "status")


def drop_proxy_keys_cascade(proxy_keys: DataFrame, mappings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: delete proxy keys; their mappings go with them (ON DELETE CASCADE)."""
    d = ids.select("id").distinct()
    kept_keys = proxy_keys.join(dim_side(d), "id", "left_anti")
    kept_maps = mappings.join(dim_side(d.withColumnRenamed("id", "proxy_key_id")), "proxy_key_id", "left_anti")
    return kept_keys, kept_maps
