"""Listings (L1-L5): projection, filter, sort. Never select secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _status(active: str = "is_active", yes: str = "active", no: str = "revoked"):
    return F.when(F.col(active), F.lit(yes)).otherwise(F.lit(no)).alias("status")


def list_api_keys(api_keys: DataFrame) -> DataFrame:
    """L1: all keys, newest first; status active / revoked (any inactive key)."""
    return api_keys.select("id", "name", _status(), "created_at", "request_count") \
        .orderBy(F.desc("created_at"), "id")


def list_api_keys_by_user(api_keys: DataFrame, user_id: str) -> DataFrame:
    """L2: keys of one user, newest first."""
    return api_keys.where(F.col("user_id") == user_id) \
        .select("id", "name", "description", "user_id", "is_active", "created_at", "revoked_at", "request_count") \
        .orderBy(F.desc("created_at"), "id")


def list_proxy_keys(proxy_keys: DataFrame, api_key_id: str) -> DataFrame:
    """L3: proxy keys of one API key, newest first."""
    return proxy_keys.where(F.col("api_key_id") == api_key_id) \
        .select("id", "name", "description", "api_key_id", "is_active", "created_at", "revoked_at") \
        .orderBy(F.desc("created_at"), "id")


def list_mappings(mappings: DataFrame, proxy_key_id: str) -> DataFrame:
    """L4: mappings of one proxy key by provider; the encrypted key is never selected."""
    return mappings.where(F.col("proxy_key_id") == proxy_key_id) \
        .select("id", "proxy_key_id", "provider", "created_at", "updated_at") \
        .orderBy("provider")


def list_users(users: DataFrame) -> DataFrame:
    """Users newest first, active / inactive; no password hash."""
    return users.select("id", "username", _status(no="inactive"), "created_at") \
        .orderBy(F.desc("created_at"), "id")
