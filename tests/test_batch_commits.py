"""Batches that die on their way into the log, rows that come twice, and the
bucketed state of the sketch stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import metadata
from tokenledger.session import scratch_path
from tokenledger.sources import batch_log
from tokenledger.sources import request_log as log_io
from tokenledger.sources.files import Folder
from tokenledger.streaming import jobs

SCHEMA = ("id string, requested_at timestamp, requested_date date, reject_reason string, api_key_id string, "
          "proxy_key_id string, provider_api_key_hash string, raw_metadata map<string,string>")


def rows(spark, *given):
    """(id, day, hour, reason) -> log rows."""
    made = []
    for id_, day, hour, reason in given:
        at = None if day is None else dt.datetime(2024, 1, day, hour)
        made.append((id_, at, at and at.date(), reason, "k", None, None, {"a": "b"}))
    return spark.createDataFrame(made, SCHEMA)


def content(spark, path):
    return sorted(((r.id, r.requested_at and (r.requested_at.day, r.requested_at.hour), r.reject_reason)
                   for r in log_io.read_request_log(spark, path).collect()), key=str)


def test_a_batch_is_committed_once(spark):
    path = scratch_path(spark, "log")
    batch = rows(spark, ("a", 1, 1, None), ("b", 2, 1, None))
    assert batch_log.commit_batch(batch, path, "s-0") and not batch_log.commit_batch(batch, path, "s-0")
    assert batch_log.commit_batch(rows(spark, ("c", 1, 2, None)), path, "s-1")
    assert [c[0] for c in content(spark, path)] == ["a", "b", "c"]
    assert [n for n in os.listdir(path) if not n.startswith(("_", "."))] and not os.listdir(f"{path}/_staged")
    assert all(n.startswith(("requested_date=", "_")) for n in os.listdir(path))


@pytest.mark.parametrize("moves", [0, 1, 2])
def test_a_killed_batch_leaves_no_copy(spark, monkeypatch, moves):
    """The job dies before, between and behind the moves of its files."""
    path = scratch_path(spark, "log")
    batch_log.commit_batch(rows(spark, ("z", 1, 5, None)), path, "s-0")
    batch = rows(spark, ("a", 1, 1, None), ("b", 2, 1, None))
    move, made = Folder.move, []

    def dying(self, name, to):
        if name.startswith("_staged") or name.endswith(".pending"):
            if len(made) == moves:
                raise RuntimeError("killed")
            made.append(name)
        move(self, name, to)

    monkeypatch.setattr(Folder, "move", dying)
    with pytest.raises(RuntimeError):
        batch_log.commit_batch(batch, path, "s-1")
    monkeypatch.undo()
    computed = batch.where(F.raise_error(F.lit("computed again")).isNull())
    assert batch_log.commit_batch(computed, path, "s-1")  # finished from the list
    assert [c[0] for c in content(spark, path)] == ["a", "b", "z"]


def test_a_batch_killed_while_it_is_staged_is_written_anew(spark, monkeypatch):
    path = scratch_path(spark, "log")
    monkeypatch.setattr(Folder, "write_json", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        batch_log.commit_batch(rows(spark, ("a", 1, 1, None), ("b", 2, 1, None)), path, "s-0")
    monkeypatch.undo()
    batch_log.commit_batch(rows(spark, ("a", 1, 1, None)), path, "s-0")
    assert [c[0] for c in content(spark, path)] == ["a"]


def test_the_same_rows_written_twice_stay_once(spark):
    path = scratch_path(spark, "log")
    batch = rows(spark, ("a", 1, 1, None), ("a", 1, 0, None), ("a", 1, 1, None), ("b", 2, 1, "not_null"),
                 ("c", None, 0, "not_null"), (None, None, 0, "corrupt_record"), (None, None, 0, "corrupt_record"))
    assert batch_log.append_once(batch, path, "first")
    want = sorted([("a", (1, 0), None), ("b", (2, 1), "not_null"), ("c", None, "not_null"),
                   (None, None, "corrupt_record"), (None, None, "corrupt_record")], key=str)
    assert content(spark, path) == want
    assert not batch_log.append_once(batch, path, "first")
    batch_log.append_once(batch.where("id IS NOT NULL"), path, "again")
    assert content(spark, path) == want
    # accepted now, and an id of another date
    batch_log.append_once(rows(spark, ("b", 2, 3, None), ("a", 3, 1, None)), path, "more")
    assert content(spark, path) == sorted(want + [("b", (2, 3), None), ("a", (3, 1), None)], key=str)
    batch_log.append_once(rows(spark), path, "empty")
    assert len(content(spark, path)) == len(want) + 2


def test_the_key_check_reads_key_columns_of_the_batch_dates(spark):
    path = scratch_path(spark, "log")
    batch_log.commit_batch(rows(spark, *[(f"r{d}", d, 1, None) for d in range(1, 6)]), path, "s-0")
    seen = []
    written = batch_log._written

    def spy(df, name):
        if name == "log-held":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    batch_log._written = spy
    try:
        left = batch_log.new_rows(rows(spark, ("r2", 2, 1, None), ("new", 2, 1, None)), path)
    finally:
        batch_log._written = written
    assert [r.id for r in left.collect()] == ["new"]
    scan = next(line for line in seen[0].splitlines() if "FileScan parquet" in line)
    assert "raw_metadata" not in scan and "PartitionFilters: [" in scan and "2024-01-02" in scan.replace("19724", "2024-01-02")


def deltas(spark, pairs):
    """(api key, value) -> H1 statistics."""
    made = [(k, dt.datetime(2024, 1, 1), {"user": v}) for k, v in pairs]
    return metadata.metadata_key_stats(spark.createDataFrame(
        made, "api_key_id string, responded_at timestamp, raw_metadata map<string,string>"))


def stats(state):
    return {r.api_key_id: (r.request_count, r.approx_cardinality) for r in state.latest().collect()}


def test_a_batch_rewrites_the_buckets_it_touches(spark):
    root = scratch_path(spark, "state")
    state = jobs.KeyStatsState(spark, root, "ck", buckets=8)
    first = state.merge(deltas(spark, [(f"key{i}", "v0") for i in range(40)]), 0)
    assert len(first) > 4
    assert len(state.merge(deltas(spark, [("key3", "v1"), ("key3", "v0")]), 1)) == 1
    assert [n for n in os.listdir(f"{root}/files/batch=1") if n.startswith("bucket=")].__len__() == 1
    assert stats(state) == {f"key{i}": (1, 1) if i != 3 else (3, 2) for i in range(40)}
    assert state.merge(deltas(spark, []), 2) == []
    assert len(stats(state)) == 40


def test_state_after_a_restart_and_after_a_repeated_batch(spark, monkeypatch):
    root = scratch_path(spark, "state")
    state = jobs.KeyStatsState(spark, root, "ck", buckets=4)
    state.merge(deltas(spark, [("a", "1"), ("b", "1")]), 0)
    second = deltas(spark, [("a", "2")])
    monkeypatch.setattr(Folder, "write_json", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        state.merge(second, 1)          # files written, no manifest
    monkeypatch.undo()
    assert stats(state) == {"a": (1, 1), "b": (1, 1)}
    again = jobs.KeyStatsState(spark, root, "ck", buckets=4)
    again.merge(second, 1)
    again.merge(second, 1)              # the batch died behind its manifest
    assert stats(again) == {"a": (2, 2), "b": (1, 1)}


def test_lost_or_foreign_state_is_an_error(spark):
    root = scratch_path(spark, "state")
    state = jobs.KeyStatsState(spark, root, "ck", buckets=4)
    one = deltas(spark, [("a", "1")])
    with pytest.raises(FileNotFoundError):
        state.merge(one, 7)
    state.merge(one, 0)
    with pytest.raises(ValueError):
        jobs.KeyStatsState(spark, root, "other", buckets=4).merge(one, 1)
    with pytest.raises(ValueError):
        jobs.KeyStatsState(spark, root, "ck", buckets=5).merge(one, 1)


def test_files_no_manifest_names_are_deleted(spark):
    root = scratch_path(spark, "state")
    state = jobs.KeyStatsState(spark, root, "ck", buckets=4)
    for n in range(7):
        state.merge(deltas(spark, [("a", str(n))] + [("b", "0")] * (n == 0)), n)
    assert stats(state) == {"a": (7, 7), "b": (1, 1)}
    assert len(os.listdir(f"{root}/manifests")) <= 2 * (jobs.KEEP_SNAPSHOTS + 2)  # with checksums
    bucket = {b: n for b, n in Folder(spark, root).read_json("manifests/000000000006")["newest"].items()}
    live = [n for n in range(7) if os.path.isdir(f"{root}/files/batch={n}")
            and any(x.startswith("bucket=") for x in os.listdir(f"{root}/files/batch={n}"))]
    assert set(bucket.values()) <= set(live) and 1 not in live


def test_a_batch_leaves_most_older_rows_alone(spark):
    """Batches of new keys: each wrote all rows of its buckets, so 1, 2, ... 8."""
    root = scratch_path(spark, "state")
    state = jobs.KeyStatsState(spark, root, "ck", buckets=1)
    written = []
    for n in range(8):
        state.merge(deltas(spark, [(f"key{n}", str(v)) for v in range(n + 1)]), n)
        written.append(spark.read.parquet(f"{root}/files/batch={n}").count())
        if n == 3:  # a manifest of older code names one run for a bucket
            found = state.folder.read_json("manifests/000000000003")
            state.folder.write_json("manifests/000000000003", {k: v for k, v in found.items() if k != "runs"})
    assert written == [1, 1, 1, 4, 1, 1, 1, 4]
    assert stats(state) == {f"key{n}": (n + 1, n + 1) for n in range(8)}
    state.merge(deltas(spark, [("key0", "new"), ("key7", "0")]), 8)
    assert stats(state) == {f"key{n}": (n + 1, n + 1) for n in range(1, 7)} | {"key0": (2, 2), "key7": (9, 8)}


def test_a_request_recorded_twice_is_logged_once(spark):
    """T1 with ``unique``, a new file of old requests, in S7's layout."""
    from tests.conftest import SF
    from tokenledger.plans import fixtures as FX
    from tokenledger.sources import bodies
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    ex = FX.exchanges(spark, SF).where("event_id < 80").coalesce(1)
    counts = []
    for _ in range(2):
        bodies.write_exchanges(ex, src)
        jobs.stream_enrich(spark, src, FX.load_dims(spark, SF), out, ckpt, unique=True).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts[0] > 0 and counts[0] == counts[1]
    assert all(n.startswith(("requested_date=", "_")) for n in os.listdir(out))
