"""Key resolution joins (J1, J2) and ownership chains.

Requests carry whole bodies, so their rows are not shuffled to meet a key
dimension. One within the broadcast bound is broadcast. A larger one is first
cut down to the keys in use: the distinct hashes of a narrow scan meet it in a
shuffle, and what they find is written and, within the bound, broadcast. Should
even the keys in use exceed it, ``fit`` says so, and the caller reads
what it needs from the bodies first and shuffles narrow rows (see ``plans.enrich``).

Dimensions are joined once each on their hash, with a size-checked
broadcast; everything a request needs from a dimension (owner, active
metadata keys, provider mappings) is folded into that one dimension row
first, so the fact side sees a single join per dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.functions.headers import hash_key, strip_bearer
from tokenledger.functions.secrets import secret_ok, secret_set
from tokenledger.session import dim_side, scratch_path, within


def api_key_status(found, is_active, revoked_at, given):
    return (
        F.when(~given, F.lit("missing"))
        .when(~found, F.lit("not_found"))
        .when(~is_active & revoked_at.isNotNull(), F.lit("revoked"))
        .when(~is_active, F.lit("inactive"))
        .otherwise(F.lit("ok"))
    )


def _spread_key(key_hash, df: DataFrame):
    """The join key; rows without one get values that match nothing, so in a
    shuffle join they spread over all tasks instead of meeting in one."""
    ids = [c for c in ("request_id", "event_id") if c in df.columns]
    return F.coalesce(key_hash, F.concat(F.lit("none-"), F.col(ids[0]).cast("string"))) if ids else key_hash


def fits(dim: DataFrame, cfg: LedgerConfig = DEFAULT) -> bool:
    return within(dim, cfg.dim_broadcast_bytes)


def written(df: DataFrame, name: str) -> DataFrame:
    """A written copy: what it was made from does not run again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_use(dim: DataFrame, hash_col: str, hashes: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Rows of a key dimension that ``hashes`` (one column) name.

    A dimension within the broadcast bound stays as it is. Of a larger one the
    rows in use are written and read back, so their size is known. Only
    hashes and dimension rows are shuffled, each hash once per map task."""
    if fits(dim, cfg):
        return dim
    name = hashes.columns[0]
    wanted = hashes.where(F.col(name).isNotNull()).distinct()
    wanted = dim_side(wanted, cfg.dim_broadcast_bytes)
    return written(dim.join(wanted, F.col(hash_col) == F.col(name), "left_semi"), "keys-in-use")


def proxy_token_hash(authorization, cfg: LedgerConfig = DEFAULT):
    """Hash of the token of an Authorization header if it is a proxy key, else null."""
    token = strip_bearer(authorization)
    return F.when(token.startswith(cfg.proxy_key_prefix), F.sha2(token, 256))


def api_dimension(api_keys: DataFrame, extra: DataFrame | None = None, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """API keys with ``extra`` (keyed by ``api_key_id``) folded in."""
    dim = api_keys.select(
        F.col("key_hash").alias("_ak_hash"), F.col("id").alias("_ak_id"),
        F.col("user_id").alias("_ak_user"), F.col("name").alias("_ak_name"),
        F.col("is_active").alias("_ak_active"), F.col("revoked_at").alias("_ak_revoked"),
    )
    if extra is None:
        return dim
    extra = extra.withColumnRenamed("api_key_id", "_ak_id")
    return dim.join(extra if fits(api_keys, cfg) else extra.hint("merge"), "_ak_id", "left")


def resolve_api_keys(df: DataFrame, api_keys: DataFrame, key_col: str = "api_key",
                     extra: DataFrame | None = None, cfg: LedgerConfig = DEFAULT, folded: bool = False) -> DataFrame:
    """Hash the gateway key and look it up.

    Adds ``api_key_status`` (ok / missing / not_found / revoked / inactive),
    ``api_key_id``, ``user_id``, ``api_key_name``. ``extra`` (keyed by
    ``api_key_id``) is folded into the dimension before the fact join;
    ``folded``: ``api_keys`` is an ``api_dimension`` already.
    """
    dim = dim_side(api_keys if folded else api_dimension(api_keys, extra, cfg), cfg.dim_broadcast_bytes, api_keys)
    df = df.withColumn("_key_hash", hash_key(F.col(key_col)))
    j = df.join(dim, _spread_key(F.col("_key_hash"), df) == F.col("_ak_hash"), "left")
    found = F.col("_ak_hash").isNotNull()
    status = api_key_status(found, F.col("_ak_active"), F.col("_ak_revoked"), F.col("_key_hash").isNotNull())
    ok = status == "ok"
    return (
        j.withColumn("api_key_status", status)
        .withColumn("api_key_id", F.when(found, F.col("_ak_id")))
        .withColumn("user_id", F.when(ok, F.col("_ak_user")))
        .withColumn("api_key_name", F.when(found, F.col("_ak_name")))
        .drop("_key_hash", "_ak_hash", "_ak_id", "_ak_user", "_ak_name", "_ak_active", "_ak_revoked")
    )


def proxy_dimension(proxy_keys: DataFrame, mappings: DataFrame, secret: str, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Proxy keys with their mappings folded in as ``provider -> <decryptable,
    not empty>``.

    Decryption is checked once per stored mapping, not once per request; a
    (proxy key, provider) pair stored twice counts with its better row.
    """
    per_key = (
        mappings.select("proxy_key_id", "provider", F.struct(
            secret_ok(F.col("encrypted_key"), secret).alias("readable"),
            secret_set(F.col("encrypted_key"), secret).alias("set")).alias("ok"))
        .groupBy("proxy_key_id", "provider").agg(F.max("ok").alias("ok"))
        .groupBy("proxy_key_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("provider", "ok"))).alias("mapped"))
    )
    per_key = per_key.withColumnRenamed("proxy_key_id", "_pk_id")
    return proxy_keys.select(
        F.col("key_hash").alias("_pk_hash"), F.col("id").alias("_pk_id"),
        F.col("api_key_id").alias("_pk_owner"), F.col("is_active").alias("_pk_active"),
        F.col("revoked_at").alias("_pk_revoked"),
    ).join(per_key if fits(proxy_keys, cfg) else per_key.hint("merge"), "_pk_id", "left")


def resolve_proxy_keys(df: DataFrame, proxy_keys: DataFrame, mappings: DataFrame, secret: str,
                       auth_col: str = "authorization", provider_col: str = "provider",
                       api_key_id_col: str = "api_key_id", cfg: LedgerConfig = DEFAULT, folded: bool = False) -> DataFrame:
    """Proxy key checks, in order: passthrough (not a proxy key),
    not_found, revoked, inactive, wrong_owner, no_mapping, decrypt_failed, ok.

    Adds ``proxy_status`` and ``proxy_key_id`` (set when ok and the stored
    provider key is not empty). ``folded``: ``proxy_keys`` is a
    ``proxy_dimension`` already.
    """
    df = df.withColumn("_pk_token_hash", proxy_token_hash(F.col(auth_col), cfg))
    dim = dim_side(proxy_keys if folded else proxy_dimension(proxy_keys, mappings, secret, cfg),
                   cfg.dim_broadcast_bytes, proxy_keys)
    j = df.join(dim, _spread_key(F.col("_pk_token_hash"), df) == F.col("_pk_hash"), "left")
    mapped = F.element_at(F.col("mapped"), F.col(provider_col))
    has_mapping = F.coalesce(F.map_contains_key(F.col("mapped"), F.col(provider_col)), F.lit(False))
    status = (
        F.when(F.col("_pk_token_hash").isNull(), F.lit("passthrough"))
        .when(F.col("_pk_hash").isNull(), F.lit("not_found"))
        .when(~F.col("_pk_active") & F.col("_pk_revoked").isNotNull(), F.lit("revoked"))
        .when(~F.col("_pk_active"), F.lit("inactive"))
        .when(~F.coalesce(F.col("_pk_owner") == F.col(api_key_id_col), F.lit(False)), F.lit("wrong_owner"))
        .when(~has_mapping, F.lit("no_mapping"))
        .when(~F.coalesce(mapped["readable"], F.lit(False)), F.lit("decrypt_failed"))
        .otherwise(F.lit("ok"))
    )
    return (
        j.withColumn("proxy_status", status)
        .withColumn("proxy_key_id", F.when((F.col("proxy_status") == "ok") & mapped["set"], F.col("_pk_id")))
        .drop("_pk_token_hash", "_pk_hash", "_pk_id", "_pk_owner", "_pk_active", "_pk_revoked", "mapped")
    )


def owned_proxy_keys(users: DataFrame, api_keys: DataFrame, proxy_keys: DataFrame,
                     cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Ownership chain user -> API key -> proxy key (users without keys dropped).

    The two dimension joins go through the size check like any other: at
    scale they become shuffle joins on the key ids.
    """
    ak = api_keys.where(F.col("user_id").isNotNull()).select(
        F.col("id").alias("api_key_id"), F.col("user_id"), F.col("name").alias("api_key_name"))
    u = users.select(F.col("id").alias("user_id"), "username")
    owned = ak.join(dim_side(u, cfg.dim_broadcast_bytes), "user_id", "inner")
    pk = proxy_keys.select(F.col("id").alias("proxy_key_id"), F.col("name").alias("proxy_key_name"),
                           "api_key_id", F.col("is_active").alias("proxy_key_active"))
    return pk.join(owned, "api_key_id", "inner")
