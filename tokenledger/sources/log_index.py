"""Index tables beside the request log: point and top-k reads open few files.

* ``zones``: one row per log file with its accepted rows, oldest and newest
  ``created_at`` (A9);
* ``postings``: one row per metadata pair, or proxy key, and file, with rows,
  oldest and newest ``requested_at`` (F2, A8);
* ``ids``: request id and file (A10).

``postings`` and ``ids`` lie in directories by a hash of what is looked up, so a
lookup reads one of them. Names of files are handled on the driver, as Spark's
own file listing does; rows never are. ``update`` indexes the files that came
since the last call and a lookup sees the log as of then. A file indexed twice
(after a job that failed half-way) is told by its name and counted once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.sources import request_log as log_io

PROXY_KEY = "proxy key"  # the postings' kind for proxy keys; pairs have kind "metadata"
METADATA = "metadata"


_LOCAL = "^file:/+"  # local paths are written with one or three slashes


_COLUMNS = {
    "zones": "file string, rows long, oldest timestamp, newest timestamp",
    "postings": "kind string, key string, value string, file string, rows long, oldest timestamp, newest timestamp, bucket int",
    "ids": "id string, file string, bucket int",
}


class LogIndex:
    """Index of the log at ``log_path``, kept at ``path``."""

    def __init__(self, spark: SparkSession, log_path: str, path: str, buckets: int = 16) -> None:
        self.spark, self.log_path, self.path, self.buckets = spark, log_path, path.rstrip("/"), buckets
        self.schema = log_io.read_request_log(spark, log_path).schema
        self.files: set[str] = set()
        if self._exists("zones"):
            self.files = {r.file for r in self._table("zones").select("file").distinct().collect()}

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_COLUMNS[name]).parquet(f"{self.path}/{name}")

    def _bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def _read(self, files) -> DataFrame:
        """The accepted rows of some files of the log."""
        files = sorted(files)
        reader = self.spark.read.schema(self.schema).option("basePath", self.log_path)
        rows = reader.parquet(*files) if files else reader.parquet(self.log_path).where(F.lit(False))
        return log_io.accepted(rows)

    def update(self) -> int:
        """Indexes the log files not yet known; how many these were."""
        listed = log_io.read_request_log(self.spark, self.log_path).inputFiles()
        new = {re.sub(_LOCAL, "file:///", f) for f in listed} - self.files
        if not new:
            return 0
        rows = self._read(new).withColumn(
            "file", F.regexp_replace("_metadata.file_path", _LOCAL, "file:///"))
        pairs = rows.select("file", "requested_at", F.explode("indexed_metadata").alias("key", "value")) \
            .select(F.lit(METADATA).alias("kind"), "key", "value", "file", "requested_at")
        of_key = rows.where(F.col("proxy_key_id").isNotNull()).select(
            F.lit(PROXY_KEY).alias("kind"), F.lit("").alias("key"), F.col("proxy_key_id").alias("value"), "file", "requested_at")
        postings = (pairs.union(of_key).groupBy("kind", "key", "value", "file")
                    .agg(F.count(F.lit(1)).alias("rows"), F.min("requested_at").alias("oldest"),
                         F.max("requested_at").alias("newest"))
                    .withColumn("bucket", self._bucket(F.col("kind"), F.col("key"), F.col("value"))))
        ids = rows.select("id", "file", self._bucket(F.col("id")).alias("bucket"))
        for name, table, order in (("postings", postings, ["kind", "key", "value"]), ("ids", ids, ["id"])):
            (table.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
             .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}"))
        # last, as it says which files are indexed; a file without accepted rows is known too
        counted = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("oldest"),
                                           F.max("created_at").alias("newest"))
        every = self.spark.createDataFrame([(f,) for f in sorted(new)], "file string")
        (every.join(counted, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
         .coalesce(1).write.mode("append").parquet(f"{self.path}/zones"))
        self.files |= new
        return len(new)

    def _postings(self, kind: str, key: str, value: str) -> DataFrame:
        """One row per file that holds the value."""
        bucket = self._bucket(F.lit(kind), F.lit(key), F.lit(value))
        # the bucket is a constant of the plan: only its directory is read
        found = self._table("postings").where((F.col("bucket") == bucket) & (F.col("kind") == kind)
                                              & (F.col("key") == key) & (F.col("value") == value))
        return found.groupBy("file").agg(F.max("rows").alias("rows"), F.min("oldest").alias("oldest"),
                                         F.max("newest").alias("newest"))

    def files_containing(self, wanted: dict[str, str]) -> set[str]:
        """Files with a row for each of the pairs (one row need not hold all)."""
        if not wanted:
            return set(self.files)
        per_pair = [{r.file for r in self._postings(METADATA, k, v).select("file").collect()} for k, v in wanted.items()]
        return reduce(set.intersection, per_pair)

    def containing(self, wanted: dict[str, str]) -> DataFrame:
        """Rows of the files that can hold rows with all pairs (F2)."""
        return self._read(self.files_containing(wanted))

    def _files_of_newest(self, zones: DataFrame, n: int) -> set[str]:
        """Files that can hold one of the ``n`` newest rows.

        A file has one row as new as its newest and the rest at least as new as
        its oldest. The n newest of these times, and the rows they
        stand for, give a time that n rows reach; older files are not needed."""
        zones = zones.where("rows > 0")
        times = zones.select(F.col("newest").alias("t"), F.lit(1).cast("bigint").alias("rows")).union(
            zones.where("rows > 1").select(F.col("oldest").alias("t"), F.col("rows") - 1))
        reached, since = 0, None
        for r in times.orderBy(F.desc("t")).limit(n).collect():
            reached, since = reached + r.rows, r.t
            if reached >= n:
                break
        if since is None:
            return set()
        if reached >= n:
            zones = zones.where(F.col("newest") >= F.lit(since))
        return {r.file for r in zones.select("file").collect()}

    def newest(self, n: int) -> DataFrame:
        """Rows of the files that can hold the ``n`` newest by ``created_at``."""
        zones = self._table("zones").groupBy("file").agg(F.max("rows").alias("rows"), F.min("oldest").alias("oldest"),
                                                         F.max("newest").alias("newest"))
        return self._read(self._files_of_newest(zones, n))

    def newest_of_proxy_key(self, proxy_key_id: str, n: int) -> DataFrame:
        """Rows of the files that can hold the ``n`` newest of a proxy key."""
        return self._read(self._files_of_newest(self._postings(PROXY_KEY, "", proxy_key_id), n))

    def request(self, request_id: str) -> DataFrame:
        """Rows of the file that holds a request (A10)."""
        found = self._table("ids").where((F.col("bucket") == self._bucket(F.lit(request_id))) & (F.col("id") == request_id))
        return self._read({r.file for r in found.select("file").distinct().collect()})
