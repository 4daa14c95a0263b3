"""Names and small JSON documents in the shared folder, by Hadoop paths.

Only names of files and manifests pass through here (as in Spark's own file
listing and job commit), never rows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system that Spark can read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self, name: str = "") -> list[str]:
        """Sorted names of what lies directly inside; none if it is absent."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._of(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        """Bytes of all files below; 0 if it is absent."""
        return self._fs.getContentSummary(self._of(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self._fs.delete(self._of(name), True)

    def move(self, name: str, to: str) -> None:
        """Moves a file; the folder of ``to`` is made."""
        target = self._of(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._of(name), target):
            raise OSError(f"could not move {self.path}/{name} to {to}")

    def read_json(self, name: str):
        stream = self._fs.open(self._of(name))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        """Written aside and moved, so a reader finds all of it or none."""
        head, _, tail = name.rpartition("/")
        aside = f"{head}/.{tail}.tmp" if head else f".{tail}.tmp"
        stream = self._fs.create(self._of(aside), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self.exists(name):
            self.delete(name)
        self.move(aside, name)
