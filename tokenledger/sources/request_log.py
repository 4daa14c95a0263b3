"""The request-log table (S7): written once by the ETL, read by the analytics.

The table is Parquet partitioned by ``requested_date``; rows the reference's
table would refuse stay in it with their ``reject_reason`` (Q1) instead of
being lost, and readers split on that column. Writing the log also cuts the
long expression lineage of the decode stage, which is what every analytics
query would otherwise re-plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.operators.quality import INT_COLUMNS

PARTITION = "requested_date"


def write_request_log(requests: DataFrame, path: str, mode: str = "append", rebalance: bool = True) -> None:
    """Append rows (partitioned by date); task retries and the commit
    protocol make a job that loses executors write each row once.

    ``rebalance`` clusters rows by date before the write (an AQE rebalance:
    partitions of the advisory size, skewed dates split), so each task
    writes few, well-sized files instead of one small file per date. Rows lie
    by (API key, time) within a file, so a key's row groups are found by
    their statistics; request id, proxy key and provider key hash have Bloom
    filters: these stand for the reference table's indexes."""
    if rebalance:
        requests = requests.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, "api_key_id", "requested_at")
    writer = requests.write.mode(mode).partitionBy(PARTITION)
    for column in ("id", "proxy_key_id", "provider_api_key_hash"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def accepted(log: DataFrame) -> DataFrame:
    """Rows the log table keeps, INT-typed counts."""
    ok = log
    if "reject_reason" in log.columns:
        ok = log.where(F.col("reject_reason").isNull()).drop("reject_reason")
    for c in INT_COLUMNS:
        ok = ok.withColumn(c, F.col(c).cast("int"))
    return ok


def rejected(log: DataFrame) -> DataFrame:
    return log.where(F.col("reject_reason").isNotNull())
