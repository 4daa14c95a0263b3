from pyspark.sql import functions as F

from tokenledger.session import dim_side, estimated_bytes, scratch_path, within


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dim_side_broadcasts_only_within_bound(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # only explicit hints may broadcast
    try:
        fact = spark.range(1000).withColumnRenamed("id", "k")
        dim = spark.range(100).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
        assert estimated_bytes(dim) is not None
        small = _plan(fact.join(dim_side(dim, max_bytes=1 << 30), "k"))
        large = _plan(fact.join(dim_side(dim, max_bytes=1), "k"))
        assert "BroadcastHashJoin" in small
        assert "BroadcastHashJoin" not in large        # beyond the bound: a shuffle join instead
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_a_small_file_of_long_rows_is_not_broadcast(spark):
    """The files of a key table hold a few bytes a key; its rows are hashes and ids."""
    path = scratch_path(spark, "numbers")
    spark.range(200_000).coalesce(1).write.parquet(path)
    dim = spark.read.parquet(path).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.md5(F.hex("id")).alias("v"))
    bound = 8 << 20
    assert estimated_bytes(dim) < bound and not within(dim, bound)
    fact = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    joined = fact.join(dim_side(dim, bound), "k", "left")  # Spark must not broadcast it by its own estimate either
    assert "BroadcastHashJoin" not in _plan(joined) and joined.where("v is not null").count() == 1000
    assert within(dim.limit(10), bound) and "BroadcastHashJoin" in _plan(fact.join(dim_side(dim.limit(10), bound), "k"))
