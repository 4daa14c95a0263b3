"""Structured Streaming jobs.

* T1 ``stream_enrich``: recorded exchanges arriving as files -> J8 -> the
  request log in its own layout (S7). Each micro-batch is committed once under
  the batch's number (``sources/batch_log.py``), whatever dies in between.
* T2 ``stream_key_stats``: the log as a stream -> per micro-batch sketch
  deltas (H1) merged into the state (H2). The state lies in hash buckets by API
  key, each in a few runs; a batch adds a run to the buckets it touches, now and
  then merged with older ones, and a manifest names each bucket's runs.
* T3 ``stream_price_refresh``: T1 with the price list re-read when older than
  the refresh interval; a failed read keeps the previous snapshot (a static
  side fixed at plan time would go stale).

The reference's windows are processing-time tickers; event-time windows,
watermarks and stream-stream joins do not occur in it.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenledger.config import DEFAULT, LedgerConfig
from tokenledger.operators import metadata
from tokenledger.plans import enrich
from tokenledger.plans.fixtures import Dims
from tokenledger.sources import batch_log, bodies
from tokenledger.sources import prices as price_src
from tokenledger.sources import request_log as log_io
from tokenledger.sources.files import Folder

LOG = logging.getLogger(__name__)


def _trigger(writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def _folded(dims: Dims | DimsSnapshot, cfg: LedgerConfig) -> Callable[[], Dims]:
    """The dimensions in force, folded once for all micro-batches that use them."""
    last: list[Dims] = []

    def current() -> Dims:
        now = dims.current() if isinstance(dims, DimsSnapshot) else dims
        if not last or last[0] is not now:
            last[:] = [now, enrich.fold(now, cfg)]
        return last[1]

    return current


def _stream_log(spark: SparkSession, source: str, dims: Callable[[], Dims], out: str, checkpoint: str, name: str,
                unique: bool, trigger: str | None, max_files: int, cfg: LedgerConfig) -> StreamingQuery:
    """Exchanges -> J8 -> the log at ``out``, each batch committed once."""
    append = batch_log.append_once if unique else batch_log.commit_batch

    def run(batch: DataFrame, batch_id: int) -> None:
        commit = f"{name}-{batch_id:012d}"
        if not batch_log.is_committed(spark, out, commit):
            append(enrich.enrich_requests(batch, dims(), cfg), out, commit)

    ex = bodies.stream_exchanges(spark, source, max_files)
    return _trigger(ex.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint), trigger).start()


def stream_enrich(spark: SparkSession, source: str, dims: Dims | DimsSnapshot, out: str, checkpoint: str,
                  trigger: str | None = "availableNow", max_files: int = 8,
                  cfg: LedgerConfig = DEFAULT, name: str = "enrich", unique: bool = False) -> StreamingQuery:
    """Exchanges (files) -> request log in S7's layout.

    Given a ``DimsSnapshot``, each micro-batch uses the dimensions as of then.
    Rows keep their ``reject_reason`` (Q1) as in the batch ETL. Queries that
    write to one log need different ``name``s; ``unique`` also drops rows whose
    id the log holds already (a request recorded twice)."""
    return _stream_log(spark, source, _folded(dims, cfg), out, checkpoint, name, unique, trigger, max_files, cfg)


#: hash buckets of T2's state
STATE_BUCKETS = 256
#: manifests of T2 that stay behind the newest one
KEEP_SNAPSHOTS = 3
#: runs of a bucket of T2's state that are merged into one
FAN = 4

_STATE_SCHEMA = ("api_key_id string, key_name string, hll_state binary, request_count bigint, last_seen_at timestamp, "
                 "approx_cardinality bigint, batch bigint, bucket int")


class KeyStatsState:
    """T2's state under ``root``: ``files/batch=n/bucket=b`` and ``manifests/n``.

    A bucket's state is the H2 merge of its runs. Batch ``n`` writes a run for
    each bucket it has keys of. Once a bucket has ``FAN - 1`` runs of as many
    batches as the new one, the new one takes them up. So a row is written
    again with the logarithm of the number of batches, not in each of them, and
    a bucket has as few runs. ``newest`` in a manifest says which batch wrote
    each bucket last, ``runs`` lists the runs with their numbers of batches.

    A manifest is a function of manifest ``n-1`` and batch ``n``: a batch done
    again after a failure gives the same state. Files that no kept manifest
    names are deleted. ``owner`` is the checkpoint whose batches are counted."""

    def __init__(self, spark: SparkSession, root: str, owner: str, buckets: int = STATE_BUCKETS) -> None:
        self.spark, self.root, self.owner, self.buckets = spark, root.rstrip("/"), owner, buckets
        self.folder = Folder(spark, root)

    def _manifest(self, batch_id: int) -> dict:
        found = self.folder.read_json(f"manifests/{batch_id:012d}")
        if found["owner"] != self.owner or found["buckets"] != self.buckets:
            raise ValueError(f"{self.root} holds the state of {found['owner']} in {found['buckets']} buckets; "
                             f"{self.owner} with {self.buckets} buckets needs a folder of its own")
        return found

    def _read(self, files: list[tuple[str, int]]) -> DataFrame:
        """Rows of some runs, given as (bucket, batch)."""
        paths = [f"{self.root}/files/batch={n}/bucket={b}" for b, n in files]
        reader = self.spark.read.schema(_STATE_SCHEMA)
        rows = reader.option("basePath", f"{self.root}/files").parquet(*paths) if paths \
            else self.spark.createDataFrame([], _STATE_SCHEMA)
        return rows.drop("batch", "bucket")

    def merge(self, delta: DataFrame, batch_id: int) -> list[str]:
        """Adds the buckets of ``delta`` to the state (H2); the buckets written."""
        done = self.folder.names("manifests")
        for old in done:
            if int(old) < batch_id - KEEP_SNAPSHOTS:
                self._forget(int(old))
        if f"{batch_id:012d}" in done:  # the batch died behind its manifest
            self._manifest(batch_id)
            return []
        if batch_id and f"{batch_id - 1:012d}" not in done:
            raise FileNotFoundError(f"{self.root}: the manifest of batch {batch_id - 1} is missing, the state is incomplete")
        if not batch_id and done:
            raise ValueError(f"{self.root} holds the state of an older checkpoint")
        before = self._manifest(batch_id - 1) if batch_id else {"newest": {}, "runs": {}}
        runs = _runs(before)
        # the sketches of the batch are needed twice; without an executor they are computed again
        delta = delta.withColumn("bucket", F.pmod(F.xxhash64("api_key_id"), F.lit(self.buckets)).cast("int")).persist()
        touched = sorted(str(r.bucket) for r in delta.select("bucket").distinct().collect())  # at most `buckets` rows
        taken: list[tuple[str, int]] = []
        for b in touched:
            kept, weight = _stacked(own := runs.get(b, []))
            taken += [(b, n) for n, _ in own[len(kept):]]
            runs[b] = [*kept, [batch_id, weight]]
        if touched:
            rows = delta
            if taken:
                merged = metadata.merge_key_stats(self._read(taken), delta.drop("bucket"))
                rows = merged.withColumn("bucket", F.pmod(F.xxhash64("api_key_id"), F.lit(self.buckets)).cast("int"))
            (rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
             .parquet(f"{self.root}/files/batch={batch_id}"))
        delta.unpersist()
        self.folder.write_json(f"manifests/{batch_id:012d}", {
            "owner": self.owner, "buckets": self.buckets, "runs": runs,
            "newest": {**before["newest"], **{b: batch_id for b in touched}}})
        return touched

    def _forget(self, batch_id: int) -> None:
        """Deletes manifest ``batch_id`` and the files only it names."""
        name = f"manifests/{batch_id:012d}"
        for bucket, batch in sorted(_files(self._manifest(batch_id)) - _files(self._manifest(batch_id + 1))):
            self.folder.delete(f"files/batch={batch}/bucket={bucket}")
        self.folder.delete(name)

    def latest(self) -> DataFrame | None:
        """All key statistics as of the newest manifest (None: no batch yet)."""
        done = self.folder.names("manifests")
        if not done:
            return None
        found = self.folder.read_json(f"manifests/{done[-1]}")
        return metadata.fold_key_stats(self._read(sorted(_files(found))))


def _runs(manifest: dict) -> dict[str, list]:
    """A manifest's runs by bucket, oldest first, as [batch, number of batches];
    those written before there were runs hold all batches."""
    return manifest["runs"] if "runs" in manifest else {b: [[n, n + 1]] for b, n in manifest["newest"].items()}


def _files(manifest: dict) -> set[tuple[str, int]]:
    return {(b, n) for b, own in _runs(manifest).items() for n, _ in own}


def _stacked(runs: list) -> tuple[list, int]:
    """The runs that stay beside a new one, and the number of batches in that."""
    kept, weight = runs, 1
    while len(kept) >= FAN - 1 and kept[1 - FAN][1] <= weight:
        kept, weight = kept[:1 - FAN], weight * FAN
    return kept, weight


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest key statistics under ``root`` (or None)."""
    return KeyStatsState(spark, root, "").latest()


def stream_key_stats(spark: SparkSession, log_path: str, log_schema, state_root: str, checkpoint: str,
                     trigger: str | None = "60 seconds", max_files: int = 8,
                     buckets: int = STATE_BUCKETS) -> StreamingQuery:
    """H1 deltas per micro-batch merged (H2) into the bucketed state.

    Only accepted rows feed the sketches. The reference flushes dirty
    sketches every 60 s; here each micro-batch adds a run to the dirty buckets.
    ``metadata.apply_key_stats`` writes ``latest_snapshot`` into the key table."""
    src = (spark.readStream.schema(log_schema).option("maxFilesPerTrigger", max_files).parquet(log_path))
    state = KeyStatsState(spark, state_root, checkpoint, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        state.merge(metadata.metadata_key_stats(log_io.accepted(batch)), batch_id)

    return _trigger(src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), trigger).start()


class DimsSnapshot:
    """The dimensions in force, loaded again when older than
    ``refresh_seconds``: keys revoked or added meanwhile, and metadata names
    switched on, count from the next micro-batch on. A failed load keeps the
    previous ones and is logged. Replaced dimensions stay in memory until the
    refresh after, for plans that still run on them."""

    def __init__(self, load, refresh_seconds: float = 300.0, clock=time.monotonic):
        self.load, self.refresh_seconds, self.clock = load, refresh_seconds, clock
        self.dims, self.loaded_at = load().persisted(), clock()
        self.replaced: Dims | None = None

    def current(self) -> Dims:
        if self.clock() - self.loaded_at >= self.refresh_seconds:
            try:
                fresh = self.load().persisted()
                if self.replaced is not None:
                    self.replaced.unpersisted()
                self.replaced, self.dims = self.dims, fresh
            except Exception:  # keep the last good dimensions
                LOG.exception("dimensions could not be loaded again; the previous ones stay in force")
            self.loaded_at = self.clock()
        return self.dims


class PriceSnapshot:
    """The price list in force, re-read when older than ``refresh_seconds``.

    A snapshot is a written copy, so it cannot change when the file changes
    later. A failed or empty read keeps the previous snapshot; the first read
    uses the fallback file when the remote document is unusable."""

    def __init__(self, spark: SparkSession, remote: str | None, fallback: str, aliases: str | None,
                 refresh_seconds: float = 3600.0, clock=time.monotonic):
        self.spark, self.remote, self.refresh_seconds, self.clock = spark, remote, refresh_seconds, clock
        self.prices = price_src.load_prices(spark, remote, fallback)
        self.aliases = price_src.load_aliases(spark, aliases)
        self.loaded_at = clock()

    def current(self) -> DataFrame:
        if self.remote and self.clock() - self.loaded_at >= self.refresh_seconds:
            fresh = price_src.refreshed_prices(self.spark, self.remote)
            if fresh is not None:  # else keep the last good prices
                self.prices = fresh
            self.loaded_at = self.clock()
        return self.prices


def stream_price_refresh(spark: SparkSession, source: str, dims: Dims | DimsSnapshot, out: str, checkpoint: str,
                         prices: PriceSnapshot, trigger: str | None = "availableNow", max_files: int = 8,
                         cfg: LedgerConfig = DEFAULT, name: str = "priced", unique: bool = False) -> StreamingQuery:
    """T1 with the price snapshot of the moment in every micro-batch."""
    folded = _folded(dims, cfg)

    def current() -> Dims:
        return replace(folded(), prices=prices.current(), aliases=prices.aliases)

    return _stream_log(spark, source, current, out, checkpoint, name, unique, trigger, max_files, cfg)
