"""Loggability gate (F1) and the split of rows the log table would refuse (Q1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1
INT_COLUMNS = ["input_tokens", "output_tokens", "cached_tokens", "cache_creation_tokens", "response_time_ms"]
TEXT_COLUMNS = ["model", "provider", "request_path", "error_message", "request_body", "response_body",
                "provider_api_key_alias"]
# Column length limits of the log table.
# columns the log table declares NOT NULL
REQUIRED = ["provider", "model", "request_path", "request_method", "requested_at", "responded_at", "response_time_ms",
            "input_tokens", "output_tokens", "status_code"]
MAX_LEN = {"provider": 100, "model": 100, "provider_api_key_alias": 255, "provider_api_key_hash": 64}


def loggable(df: DataFrame) -> DataFrame:
    """valid API key, acceptable proxy key and an upstream response.

    Input lines that could not be read (``_corrupt_record``) pass, so that Q1
    reports them instead of losing them."""
    keep = ((F.col("api_key_status") == "ok") & F.col("proxy_status").isin("ok", "passthrough")
            & F.col("status_code").isNotNull())
    return df.where(keep | F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else keep)


CORRUPT = "_corrupt_record"


def _has_nul(c: Column) -> Column:
    return F.coalesce(F.instr(c, "\u0000") > 0, F.lit(False))


def reject_reason(df: DataFrame) -> Column:
    """First constraint a row breaks, else null."""
    missing = F.lit(False)
    for col in REQUIRED:
        if col in df.columns:
            missing = missing | F.col(col).isNull()
    chain = F.when(F.col(CORRUPT).isNotNull(), F.lit("corrupt_record")).when(missing, F.lit("not_null")) \
        if CORRUPT in df.columns else F.when(missing, F.lit("not_null"))
    for col, n in MAX_LEN.items():
        chain = chain.when(F.coalesce(F.length(col) > n, F.lit(False)), F.lit(f"{col}_too_long"))
    for col in INT_COLUMNS:
        chain = chain.when(~F.coalesce(F.col(col).between(INT_MIN, INT_MAX), F.lit(True)), F.lit(f"{col}_out_of_range"))
    for col in ["input_cost", "output_cost", "total_cost"]:
        chain = chain.when(F.col(col).isNull(), F.lit("numeric_overflow"))
    nul = F.lit(False)
    for col in TEXT_COLUMNS:
        if col in df.columns:
            nul = nul | _has_nul(F.col(col))
    if "raw_metadata" in df.columns:
        nul = nul | F.coalesce(F.exists(F.map_values("raw_metadata"), lambda v: _has_nul(v)), F.lit(False)) \
            | F.coalesce(F.exists(F.map_keys("raw_metadata"), lambda v: _has_nul(v)), F.lit(False))
    broken = F.lit(False)
    for col in TEXT_COLUMNS:
        if col in df.columns:
            broken = broken | ~F.coalesce(F.is_valid_utf8(F.col(col)), F.lit(True))
    return chain.when(nul, F.lit("nul_in_text")).when(broken, F.lit("invalid_utf8"))


def with_reject_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(df))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q1: ``(ok_rows, rejects)``; ok rows get INT-typed counts, rejects keep
    the wide types and a ``reject_reason``. Both are views of one plan; a job
    writing both should write the reason-tagged rows once and split on read."""
    tagged = df if "reject_reason" in df.columns else with_reject_reason(df)
    ok = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    for c in INT_COLUMNS:
        ok = ok.withColumn(c, F.col(c).cast("int"))
    rejects = tagged.where(F.col("reject_reason").isNotNull())
    return ok, rejects
