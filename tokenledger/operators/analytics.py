"""Documented analytics over the request log.

All are partial+final aggregations (map-side combine), so a hot model, key
or metadata value costs one pre-aggregated row per partition in the shuffle.
Dimension joins happen after the aggregation, on the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.session import dim_side

MONEY = "decimal(38,8)"


def _money_sum(c: str = "total_cost") -> Column:
    return F.sum(c).cast(MONEY)


def spend_by_model(requests: DataFrame) -> DataFrame:
    """A1: requests, tokens and cost per model, most expensive first."""
    return (
        requests.groupBy("model")
        .agg(F.count(F.lit(1)).alias("requests"),
             F.sum("input_tokens").cast("bigint").alias("input_tokens"),
             F.sum("output_tokens").cast("bigint").alias("output_tokens"),
             _money_sum().alias("total_cost"))
        .orderBy(F.desc("total_cost"), "model")
    )


def daily_spend(requests: DataFrame, days: int = 30) -> DataFrame:
    """A2: requests and cost per insert date, newest ``days`` dates."""
    return (
        requests.groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("requests"), _money_sum().alias("total_cost"))
        .orderBy(F.desc("date"))
        .limit(days)
    )


def spend_by_api_key(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """A3: per API key (id and name), output the name. Aggregate first, then
    join the (small) aggregate to the dimension."""
    agg = requests.groupBy("api_key_id").agg(F.count(F.lit(1)).alias("requests"), _money_sum().alias("total_cost"))
    ak = api_keys.select(F.col("id").alias("api_key_id"), F.col("name").alias("key_name"))
    return agg.join(dim_side(ak), "api_key_id", "inner").select("key_name", "requests", "total_cost") \
        .orderBy(F.desc("total_cost"), "key_name")


def meta(key: str) -> Column:
    """Metadata value lookup; names are stored lower case."""
    return F.element_at(F.col("raw_metadata"), F.lit(key.lower()))


def spend_by_metadata(requests: DataFrame, key: str = "user-id", alias: str = "user_id") -> DataFrame:
    """A4: per value of one metadata key, rows where it is present."""
    return (
        requests.where(meta(key).isNotNull())
        .groupBy(meta(key).alias(alias))
        .agg(F.count(F.lit(1)).alias("requests"), _money_sum().alias("total_cost"))
        .orderBy(F.desc("total_cost"), alias)
    )


def user_cost_in_feature(requests: DataFrame, feature: str, feature_key: str = "feature",
                         user_key: str = "user-id") -> DataFrame:
    """A5: per user within one feature; the null-user group is kept."""
    return (
        requests.where(meta(feature_key) == feature)
        .groupBy(meta(user_key).alias("user_id"))
        .agg(F.count(F.lit(1)).alias("requests"), _money_sum().alias("total_cost"))
        .orderBy(F.desc("total_cost"))
    )


def cost_by_step(requests: DataFrame, feature: str, feature_key: str = "feature",
                 step_key: str = "step") -> DataFrame:
    """Average and total cost per step within one feature."""
    return (
        requests.where(meta(feature_key) == feature)
        .groupBy(meta(step_key).alias("step"))
        .agg(F.avg("total_cost").cast("decimal(38,6)").alias("avg_cost"), _money_sum().alias("total_cost"))
    )


def spend_by_proxy_key(requests: DataFrame, proxy_keys: DataFrame) -> DataFrame:
    """Per proxy key (id and name)."""
    agg = requests.where(F.col("proxy_key_id").isNotNull()).groupBy("proxy_key_id") \
        .agg(F.count(F.lit(1)).alias("requests"), _money_sum().alias("total_cost"))
    pk = proxy_keys.select(F.col("id").alias("proxy_key_id"), F.col("name").alias("proxy_key_name"))
    return agg.join(dim_side(pk), "proxy_key_id", "inner").select("proxy_key_name", "requests", "total_cost") \
        .orderBy(F.desc("total_cost"), "proxy_key_name")


def recent_by_proxy_key(requests: DataFrame, proxy_key_id: str, n: int = 10) -> DataFrame:
    """The ``n`` newest rows of one proxy key (id breaks ties)."""
    return (
        requests.where(F.col("proxy_key_id") == proxy_key_id)
        .orderBy(F.desc("requested_at"), F.desc("id"))
        .limit(n)
        .select("model", "input_tokens", "output_tokens", "total_cost", "requested_at")
    )


def latest_request(requests: DataFrame) -> DataFrame:
    """The newest row."""
    return requests.orderBy(F.desc("created_at"), F.desc("id")).limit(1) \
        .select("model", "input_tokens", "output_tokens", "total_cost")


def body_pointer(requests: DataFrame, request_id: str) -> DataFrame:
    """A10: object key of one request's bodies."""
    return requests.where(F.col("id") == request_id).select("id", "body_s3_key")


def unpriced_models(requests: DataFrame) -> DataFrame:
    """Models without a price: requests, tokens, first and last seen."""
    return (
        requests.where(~F.col("model_alias_found"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("requests"),
             F.sum("input_tokens").cast("bigint").alias("input_tokens"),
             F.sum("output_tokens").cast("bigint").alias("output_tokens"),
             F.min("requested_at").alias("first_seen"), F.max("requested_at").alias("last_seen"))
    )


def metadata_contains(requests: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``indexed_metadata`` contains every given key/value pair."""
    cond = F.lit(True)
    for k, v in wanted.items():
        cond = cond & F.coalesce(F.element_at(F.col("indexed_metadata"), F.lit(k)) == v, F.lit(False))
    return requests.where(cond)


def requests_in_range(requests: DataFrame, column: str, value: str, start: str, end: str) -> DataFrame:
    """rows of one API key / provider key hash / user in [start, end),
    newest first. A date-partitioned log prunes partitions on ``requested_date``."""
    return (
        requests.where((F.col(column) == value)
                       & (F.col("requested_date") >= F.to_date(F.lit(start)))
                       & (F.col("requested_date") <= F.to_date(F.lit(end)))
                       & (F.col("requested_at") >= F.lit(start).cast("timestamp"))
                       & (F.col("requested_at") < F.lit(end).cast("timestamp")))
        .orderBy(F.desc("requested_at"), F.desc("id"))
    )


def map_text(c: Column) -> Column:
    """A map as sorted ``k=v`` text joined by ';' (for comparisons and CSV)."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def comparable_log(requests: DataFrame) -> DataFrame:
    """The log with map columns rendered as text and no body text columns."""
    return requests.drop("request_body", "response_body") \
        .withColumn("raw_metadata", map_text(F.col("raw_metadata"))) \
        .withColumn("indexed_metadata", map_text(F.col("indexed_metadata")))

