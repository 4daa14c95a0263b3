"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.config import DEFAULT


def get_session(app: str = "tokenledger", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC time, AQE and skew handling on.

    On a cluster ``master`` is left to spark-submit; locally it defaults to
    ``local[N]`` with a shuffle partition count near the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and not os.environ.get("SPARK_MASTER"):
        cpus = os.environ.get("BENCH_CPUS", "8")
        master = f"local[{cpus}]"
        if shuffle_partitions is None:
            shuffle_partitions = int(cpus)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # keys given as literals stay out of plan texts and event logs
        .config("spark.sql.redaction.string.regex", "(?i)(0x|x')[0-9a-f]{64}'?")
        # call-site capture on every Column call costs a JVM round trip each;
        # plans here are built from hundreds of expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set with
    ``setCheckpointDir``). Without one a local master, which is one machine,
    gets a temporary folder; on a cluster such a folder would be missing on
    the executors, so that is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tokenledger-ckpt-")
    if not context.getCheckpointDir():  # each call would nest one more folder
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan, or None when unavailable."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size))  # py4j may hand over a Python int or a JVM BigInt
    except Exception:  # Spark Connect or plan without stats
        return None


#: an estimate this many times below the bound is not counted: Parquet holds
#: no table so much smaller than its rows in memory
COMPRESSED = 256


def _width(kind: T.DataType) -> int:
    """Bytes of a value in a hash table; a text counts as long as a key hash."""
    if isinstance(kind, T.StructType):
        return 8 + sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8 + 64
    return 8 + (96 if isinstance(kind, (T.ArrayType, T.MapType)) else 0)


def within(df: DataFrame, max_bytes: int = DEFAULT.dim_broadcast_bytes, rows_of: DataFrame | None = None) -> bool:
    """Whether ``df`` fits ``max_bytes`` in memory.

    The optimizer goes by the bytes of compressed files: 5 a customer, whose
    key row takes 300. So the rows are counted where its estimate lets a table
    pass (a narrow scan, for Parquet its footers). ``rows_of``: a plainer table
    with as many rows."""
    size = estimated_bytes(df)
    if size is None or size > max_bytes:
        return False
    if size * COMPRESSED <= max_bytes:
        return True
    rows = (df if rows_of is None else rows_of).count()
    return rows * (16 + sum(_width(f.dataType) for f in df.schema.fields)) <= max_bytes


def dim_side(df: DataFrame, max_bytes: int = DEFAULT.dim_broadcast_bytes, rows_of: DataFrame | None = None) -> DataFrame:
    """Broadcast a dimension only when it is ``within`` the bound.

    Beyond the bound the join is a shuffle join; where the estimate says so
    too, AQE may still turn it into a broadcast at run time from real shuffle
    sizes. AQE splits skewed partitions of the fact side.
    """
    if within(df, max_bytes, rows_of):
        return F.broadcast(df)
    size = estimated_bytes(df)
    # the estimate is too low, so Spark itself must not broadcast by it
    return df.hint("merge") if size is not None and size <= max_bytes else df
