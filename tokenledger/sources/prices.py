"""Price list and model alias sources.

Price documents are configuration files of any length; they are read with
Spark so the result is a DataFrame that joins like any dimension.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.session import scratch_path

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")
DEFAULT_PRICES = os.path.join(RESOURCES, "prices.json")
DEFAULT_FALLBACK = os.path.join(RESOURCES, "prices_fallback.json")
DEFAULT_ALIASES = os.path.join(RESOURCES, "model_aliases.json")

PRICE_COLUMNS = ["model", "input_price", "output_price", "cached_price"]
REMOTE_SCHEMA = ("updated_at string, prices array<struct<id:string, vendor:string, name:string, "
                 "input:double, output:double, input_cached:double>>")
FALLBACK_SCHEMA = ("map<string, struct<input_price_per_million:double, output_price_per_million:double, "
                   "cached_price_per_million:double>>")


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def load_prices_remote(spark: SparkSession, path: str = DEFAULT_PRICES) -> DataFrame:
    """S3: ``{updated_at, prices:[{id, vendor, name, input, output, input_cached}]}``.

    A null cached price becomes 0; when an id repeats the later entry wins.
    """
    doc = _whole_text(spark, path).select(F.from_json("value", REMOTE_SCHEMA).alias("d"))
    rows = doc.select(F.posexplode("d.prices").alias("pos", "p"))
    last = rows.groupBy(F.col("p.id").alias("model")).agg(F.max_by("p", "pos").alias("p"))
    return last.select(
        "model",
        F.coalesce("p.input", F.lit(0.0)).alias("input_price"),
        F.coalesce("p.output", F.lit(0.0)).alias("output_price"),
        F.coalesce("p.input_cached", F.lit(0.0)).alias("cached_price"),
    )


def load_prices_fallback(spark: SparkSession, path: str = DEFAULT_FALLBACK) -> DataFrame:
    """``{model: {input_price_per_million, output_..., cached_...}}``; absent -> 0."""
    doc = _whole_text(spark, path).select(F.from_json("value", FALLBACK_SCHEMA).alias("m"))
    e = doc.select(F.explode("m").alias("model", "p"))
    return e.select(
        "model",
        F.coalesce("p.input_price_per_million", F.lit(0.0)).alias("input_price"),
        F.coalesce("p.output_price_per_million", F.lit(0.0)).alias("output_price"),
        F.coalesce("p.cached_price_per_million", F.lit(0.0)).alias("cached_price"),
    )


PRICE_SCHEMA = "model string, input_price double, output_price double, cached_price double"
ALIAS_SCHEMA = "alias string, target string"

_SNAPSHOTS: dict[tuple, str] = {}


def _file_key(spark: SparkSession, path: str, kind: str) -> tuple | None:
    """(application, kind, path, size, mtime) of a local or Hadoop path."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        st = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        return (spark.sparkContext.applicationId, kind, path, st.getLen(), st.getModificationTime())
    except Exception:
        return None


def _snapshot(spark: SparkSession, df: DataFrame, schema: str, key: tuple | None = None) -> DataFrame | None:
    """A written copy of a price or alias list of any size; None when empty.
    An unchanged file (same size and mtime) is copied once per application."""
    path = _SNAPSHOTS.get(key) if key is not None else None
    if path is None:
        path = scratch_path(spark, "price-list")
        df.coalesce(1).write.parquet(path)
    snap = spark.read.schema(schema).parquet(path)
    if key not in _SNAPSHOTS and snap.isEmpty():
        return None
    if key is not None:
        _SNAPSHOTS[key] = path
    return snap


def refreshed_prices(spark: SparkSession, remote: str) -> DataFrame | None:
    """The remote list as it is now; None when it is unreadable or empty."""
    try:
        return _snapshot(spark, load_prices_remote(spark, remote), PRICE_SCHEMA, _file_key(spark, remote, "remote"))
    except Exception:  # unreadable or undecodable document
        return None


def load_prices(spark: SparkSession, remote: str | None = DEFAULT_PRICES,
                fallback: str = DEFAULT_FALLBACK) -> DataFrame:
    """Price snapshot chosen at start-up: the remote document, else the fallback.

    The list is copied once, so the snapshot cannot change under a running
    job and its file is not parsed again per use.
    """
    snap = refreshed_prices(spark, remote) if remote else None
    if snap is not None:
        return snap
    snap = _snapshot(spark, load_prices_fallback(spark, fallback), PRICE_SCHEMA,
                     _file_key(spark, fallback, "fallback"))
    return snap if snap is not None else spark.createDataFrame([], PRICE_SCHEMA)


def load_aliases(spark: SparkSession, path: str | None = DEFAULT_ALIASES) -> DataFrame:
    """``{api_model_name: priced_name}``; missing or bad file -> empty table.

    A ``_comment`` entry is loaded like any alias and is harmless.
    """
    empty = spark.createDataFrame([], ALIAS_SCHEMA)
    if not path:
        return empty
    try:
        doc = _whole_text(spark, path).select(F.from_json("value", "map<string,string>").alias("m"))
        snap = _snapshot(spark, doc.select(F.explode("m").alias("alias", "target")), ALIAS_SCHEMA,
                         _file_key(spark, path, "aliases"))
        return snap if snap is not None else empty
    except Exception:
        return empty


def price_versions(spark: SparkSession, prices: DataFrame | None = None) -> DataFrame:
    """Dated price snapshots for repricing (J7): the list from 2024-01-01,
    doubled from 2024-01-15."""
    prices = prices if prices is not None else load_prices(spark)
    v1 = prices.withColumn("effective_from", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    v2 = prices.select(
        "model", (F.col("input_price") * 2).alias("input_price"), (F.col("output_price") * 2).alias("output_price"),
        (F.col("cached_price") * 2).alias("cached_price"),
    ).withColumn("effective_from", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return v1.unionByName(v2)
