"""A dimension table that takes change batches without being rewritten.

Rows lie in hash buckets. A change batch is written as delta files of the
buckets it has keys of: changed and new rows, and deleted keys. A manifest names, for every
bucket, its base and its deltas in order; a reader takes the newest delta row
of a key, else its base row. ``compact`` folds the deltas of a bucket into
a new base once they outgrow it. Files never change, so a plan made before
a commit still reads what it was made for, and a job that dies before its
manifest leaves only files that the next attempt overwrites. One job at a time
may write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.session import dim_side
from tokenledger.sources.files import Folder

_VERSION, _BUCKET, _DELETED = "version", "bucket", "_deleted"

#: manifests that stay behind the newest one, for plans that still read them
KEEP = 3


class KeyTable:
    """The table at ``root`` with primary key ``key`` (never null), in
    ``buckets`` buckets by hash of the key column ``bucket_by``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], bucket_by: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.bucket_by, self.buckets = spark, root.rstrip("/"), key, bucket_by, buckets
        self.folder = Folder(spark, root)

    # --- manifests

    def _manifest(self) -> dict | None:
        names = self.folder.names("manifests")
        return self.folder.read_json(f"manifests/{names[-1]}") if names else None

    def _publish(self, manifest: dict) -> None:
        self.folder.write_json(f"manifests/{manifest['version']:012d}", manifest)
        names = self.folder.names("manifests")
        kept = set().union(*(_files(self.folder.read_json(f"manifests/{n}")) for n in names[-KEEP - 1:]))
        for n in names[:-KEEP - 1]:
            for file in _files(self.folder.read_json(f"manifests/{n}")) - kept:
                self.folder.delete(file)
            self.folder.delete(f"manifests/{n}")

    # --- rows

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        """Files of a version by bucket; the buckets that have rows."""
        path = f"files/{_VERSION}={version}"
        (self._bucketed(rows).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET)
         .parquet(f"{self.root}/{path}"))
        return [n.split("=")[1] for n in self.folder.names(path) if n.startswith(f"{_BUCKET}=")]

    def _files_of(self, schema: T.StructType, named: list[tuple[str, int]]) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField(_VERSION, T.LongType()), T.StructField(_BUCKET, T.IntegerType())])
        if not named:
            return self.spark.createDataFrame([], schema).drop(_BUCKET)
        return (self.spark.read.schema(schema).option("basePath", f"{self.root}/files")
                .parquet(*[f"{self.root}/files/{_VERSION}={v}/{_BUCKET}={b}" for b, v in named]).drop(_BUCKET))

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        """The rows of some buckets. The base is not shuffled while the deltas'
        keys are within the broadcast bound."""
        schema = T.StructType.fromJson(manifest["schema"])
        base = self._files_of(schema, [(b, manifest["base"][b]) for b in buckets if b in manifest["base"]]).drop(_VERSION)
        named = [(b, v) for b in buckets for v in manifest["deltas"].get(b, [])]
        if not named:
            return base
        flagged = T.StructType([*schema.fields, T.StructField(_DELETED, T.BooleanType())])
        every = self._files_of(flagged, named)
        newest = (every.groupBy(*self.key).agg(F.max_by(F.struct(*schema.names, _DELETED), _VERSION).alias("_row"))
                  .select("_row.*"))
        kept = base.join(dim_side(every.select(*self.key)), self.key, "left_anti")
        return kept.unionByName(newest.where(~F.col(_DELETED)).drop(_DELETED)).select(*schema.names)

    # --- the table

    def create(self, rows: DataFrame) -> None:
        """The first version; over an older table it is the next one."""
        old = self._manifest()
        version = old["version"] + 1 if old else 0
        base = dict.fromkeys(self._write(rows, version), version)
        self._publish({"version": version, "name": None, "base": base, "deltas": {}, "schema": rows.schema.jsonValue()})

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """All rows, or those whose ``bucket_by`` column is in ``wanted``: then
        only the buckets of these values are opened."""
        manifest = self._manifest()
        if wanted is None:
            return self._rows(manifest, sorted({*manifest["base"], *manifest["deltas"]}))
        wanted = wanted.select(self.bucket_by).distinct()
        buckets = sorted(str(r[0]) for r in self._bucketed(wanted).select(_BUCKET).distinct().collect())
        return self._rows(manifest, buckets).join(dim_side(wanted), self.bucket_by, "left_semi")

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, name: str | None = None) -> bool:
        """Writes a change batch: whole rows, and keys to delete, each key at
        most once. False if the last batch had the same ``name``: a job done
        again after a failure."""
        manifest = self._manifest()
        if name is not None and manifest["name"] == name:
            return False
        schema = T.StructType.fromJson(manifest["schema"])
        parts = []
        if upserts is not None:
            parts.append(upserts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields],
                                        F.lit(False).alias(_DELETED)))
        if deletes is not None:
            parts.append(deletes.select(*[F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name)
                                          for f in schema.fields], F.lit(True).alias(_DELETED)))
        version = manifest["version"] + 1
        touched = self._write(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), version)
        deltas = {**manifest["deltas"], **{b: [*manifest["deltas"].get(b, []), version] for b in touched}}
        self._publish({**manifest, "version": version, "name": name, "deltas": deltas})
        return True

    def compact(self, ratio: float = 0.5) -> list[str]:
        """New bases for the buckets whose deltas hold more than ``ratio`` times
        the bytes of their base; which these are."""
        manifest = self._manifest()

        def size(bucket: str, version: int) -> int:
            return self.folder.size(f"files/{_VERSION}={version}/{_BUCKET}={bucket}")

        due = [b for b, versions in manifest["deltas"].items() if versions and sum(size(b, v) for v in versions)
               > ratio * (size(b, manifest["base"][b]) if b in manifest["base"] else 0)]
        if due:
            version = manifest["version"] + 1
            written = self._write(self._rows(manifest, due), version)
            base = {b: v for b, v in manifest["base"].items() if b not in due} | dict.fromkeys(written, version)
            deltas = {b: v for b, v in manifest["deltas"].items() if b not in due}
            self._publish({**manifest, "version": version, "base": base, "deltas": deltas})
        return sorted(due)


def _files(manifest: dict) -> set[str]:
    named = [*manifest["base"].items(), *((b, v) for b, versions in manifest["deltas"].items() for v in versions)]
    return {f"files/{_VERSION}={v}/{_BUCKET}={b}" for b, v in named}
