"""Batches committed to the request log (S7) exactly once.

A batch has a name (for a stream: the query and its batch number). Its files
are written aside, under ``_staged``; then a list of them is recorded under
``_commits`` as pending; then they are moved into the log's date folders;
then the record is marked as done. Whatever dies, the next attempt goes on
from there: without a record the batch is written anew over what was
staged, with a pending one the moves are finished from the list without
computing anything again, and a batch that is done is not touched. Folders
that begin with ``_`` are invisible to readers, so the log keeps S7's layout:
``requested_date=.../part-*.parquet``. While files are moved a reader may see
part of a batch, as during the job commit of any Parquet write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.session import dim_side, scratch_path
from tokenledger.sources import request_log as log_io
from tokenledger.sources.files import Folder

STAGED, COMMITS = "_staged", "_commits"


def is_committed(spark: SparkSession, path: str, name: str) -> bool:
    return Folder(spark, path).exists(f"{COMMITS}/{name}.done")


def commit_batch(requests: DataFrame, path: str, name: str) -> bool:
    """Appends a batch to the log; False if ``name`` had been committed."""
    spark = requests.sparkSession
    folder = Folder(spark, path)
    pending, done, staged = f"{COMMITS}/{name}.pending", f"{COMMITS}/{name}.done", f"{STAGED}/{name}"
    if folder.exists(done):
        return False
    if not folder.exists(pending):
        log_io.write_request_log(requests, f"{folder.path}/{staged}", mode="overwrite")
        files = [f"{day}/{file}" for day in folder.names(staged) if day.startswith(f"{log_io.PARTITION}=")
                 for file in folder.names(f"{staged}/{day}") if file.endswith(".parquet")]
        folder.write_json(pending, files)
    _publish(folder, staged, pending, done)
    return True


def _publish(folder: Folder, staged: str, pending: str, done: str) -> None:
    """Moves the listed files that are not yet in place. A file's name holds the
    id of the write that made it, so it cannot meet another batch's."""
    for file in folder.read_json(pending):
        if folder.exists(f"{staged}/{file}"):
            folder.move(f"{staged}/{file}", file)
        elif not folder.exists(file):
            raise FileNotFoundError(f"{folder.path}/{file} is neither staged nor in the log")
    folder.move(pending, done)
    folder.delete(staged)


_DAY, _REASON = "_log_day", "_log_reason"


def _keyed(rows: DataFrame) -> DataFrame:
    """With the rest of S7's key beside ``id``: the date and the reject reason."""
    reason = F.coalesce("reject_reason", F.lit("")) if "reject_reason" in rows.columns else F.lit("")
    return rows.withColumn(_DAY, F.coalesce(F.col(log_io.PARTITION).cast("string"), F.lit(""))).withColumn(_REASON, reason)


def new_rows(requests: DataFrame, path: str) -> DataFrame:
    """Rows of a batch that the log does not hold: S7's primary key.

    The key is the request id within its date and, since the table refuses a
    rejected row, its reject reason: a row accepted after a rejected one of the
    same id is new. Of a batch's rows with one key the earliest by
    ``requested_at`` stays (then the smallest hash of all columns). Rows
    without an id have no key and all stay.

    Of the log only the key columns of the batch's dates are read, and cut to
    the batch's ids before anything else. What is left, the repeats, is written
    and meets the batch by broadcast within the bound, so no body is shuffled
    for rows that come once. The batch is read several times: hand
    over a written table.
    """
    spark = requests.sparkSession
    key = [_DAY, "id", _REASON]
    rows = _keyed(requests)
    keys = rows.where("id IS NOT NULL").select(*key)
    repeated = spark.read.parquet(_written(keys.groupBy(*key).count().where("count > 1").drop("count"), "log-repeated"))
    columns = [F.col(f"`{c}`") for c in requests.columns]
    order = F.struct("requested_at", F.xxhash64(F.to_json(F.struct(*columns))))
    firsts = (rows.join(dim_side(repeated), key, "left_semi").groupBy(*key)
              .agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*"))
    rows = rows.join(dim_side(repeated), key, "left_anti").unionByName(_keyed(firsts))
    if any(n.startswith(f"{log_io.PARTITION}=") for n in Folder(spark, path).names()):
        days = [r[0] for r in keys.select(_DAY).distinct().collect()]  # one row a day
        day = F.col(log_io.PARTITION)
        log = log_io.read_request_log(spark, path).where(
            day.isin([d for d in days if d]) | (day.isNull() if "" in days else F.lit(False)))
        held = _keyed(log).select(*key).join(dim_side(keys.distinct()), key, "left_semi").distinct()
        rows = rows.join(dim_side(spark.read.parquet(_written(held, "log-held"))), key, "left_anti")
    return rows.select(*columns)


def _written(rows: DataFrame, name: str) -> str:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def append_once(requests: DataFrame, path: str, name: str) -> bool:
    """Appends a batch's new rows (``new_rows``) as the commit ``name``."""
    spark = requests.sparkSession
    if is_committed(spark, path, name):
        return False
    batch = spark.read.parquet(_written(requests, "log-batch"))
    return commit_batch(new_rows(batch, path), path, name)
