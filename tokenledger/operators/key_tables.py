"""M1-M7 on ``KeyTable``s: a change batch meets the rows it names and only what
it changes is written.

Each takes the rows of the batch's keys out of the table, applies the operator
of ``maintenance`` to them and commits the changed rows. The status it
returns is a plan over the version that the batch met. ``name`` makes a
repeated job harmless (``KeyTable.commit``). Change batches are read more
than once: hand over tables, or plans that give the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators import maintenance as M
from tokenledger.session import dim_side
from tokenledger.sources.key_table import KeyTable


def upsert_mappings(mappings: KeyTable, changes: DataFrame, now: Column, name: str | None = None) -> DataFrame:
    """M1; the table is bucketed by proxy_key_id."""
    new = M.upsert_mappings_annotated(mappings.read(changes), changes, now)
    mappings.commit(new.where(F.col("status") != "kept").drop("status", "applied_seq"), name=name)
    return new.where(F.col("status") != "kept").select("proxy_key_id", "provider", "status", "applied_seq")


def register_metadata_keys(metadata_keys: KeyTable, observed: DataFrame, name: str | None = None) -> DataFrame:
    """M2; the table is bucketed by api_key_id."""
    observed = observed.select("api_key_id", "key_name").distinct()
    new = M.register_metadata_keys(metadata_keys.read(observed), observed).where("is_new").drop("is_new")
    metadata_keys.commit(new, name=name)
    return new


def revoke_keys(keys: KeyTable, ids: DataFrame, now: Column, name: str | None = None) -> DataFrame:
    """M3; the table is bucketed by id."""
    out = M.revoke_keys(keys.read(ids), ids, now)
    keys.commit(out.where(F.col("status") == "revoked").drop("status"), name=name)
    return out.select("id", "status")


def patch_api_keys(api_keys: KeyTable, patches: DataFrame, name: str | None = None) -> DataFrame:
    """M4; the table is bucketed by id."""
    out = M.patch_api_keys(api_keys.read(patches), patches)
    api_keys.commit(out.where(F.col("status") == "updated").drop("status"), name=name)
    return out.select("id", "status")


def delete_mappings(mappings: KeyTable, deletes: DataFrame, name: str | None = None) -> DataFrame:
    """M5; the table is bucketed by proxy_key_id."""
    _, status = M.delete_mappings(mappings.read(deletes), deletes)
    mappings.commit(deletes=status.where(F.col("status") == "deleted").select("proxy_key_id", "provider"), name=name)
    return status


def create_keys(keys: KeyTable, new_keys: DataFrame, name: str | None = None) -> DataFrame:
    """M6. Uniqueness is by key_hash while the table is bucketed by id, so the
    key hashes of all rows are scanned; only new rows are written."""
    met = keys.read().join(dim_side(new_keys.select("key_hash").distinct()), "key_hash", "left_semi")
    after, status = M.create_keys(met, new_keys)
    created = status.where(F.col("status") == "created").select("id")
    keys.commit(after.join(dim_side(created), "id", "left_semi"), name=name)
    return status


def drop_proxy_keys_cascade(proxy_keys: KeyTable, mappings: KeyTable, ids: DataFrame, name: str | None = None) -> None:
    """M7. Mappings go first: a job that dies in between leaves keys without
    mappings, and done again it deletes the keys."""
    ids = ids.select("id").distinct()
    gone = mappings.read(ids.withColumnRenamed("id", "proxy_key_id")).select("proxy_key_id", "provider")
    mappings.commit(deletes=gone, name=name)
    proxy_keys.commit(deletes=proxy_keys.read(ids).select("id"), name=name)
