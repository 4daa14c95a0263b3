"""Bucketed dimension tables: what a change batch writes and reads, failures
half-way, compaction, and M1-M7 on them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import key_tables
from tokenledger.operators import maintenance as M
from tokenledger.plans import fixtures as FX
from tokenledger.session import scratch_path
from tokenledger.sources.files import Folder
from tokenledger.sources.key_table import KEEP, KeyTable
from tests.conftest import SF

SCHEMA = "id string, n int, note string"


def table(spark, rows, buckets=8):
    t = KeyTable(spark, scratch_path(spark, "table"), ["id"], "id", buckets)
    t.create(spark.createDataFrame(rows, SCHEMA))
    return t


def content(t):
    return sorted(tuple(r) for r in t.read().collect())


def ids(spark, *given):
    return spark.createDataFrame([(i,) for i in given], "id string")


def test_changes_and_deletes(spark):
    t = table(spark, [(f"k{i}", i, None) for i in range(20)])
    t.commit(spark.createDataFrame([("k3", 30, "x"), ("new", 1, None)], SCHEMA), ids(spark, "k4", "unknown"))
    t.commit(spark.createDataFrame([("k3", 31, None), ("k4", 4, "back")], SCHEMA))
    t.commit(deletes=ids(spark, "new"))
    want = sorted([(f"k{i}", i, None) for i in range(20) if i not in (3, 4)] + [("k3", 31, None), ("k4", 4, "back")], key=lambda r: r[0])
    assert content(t) == want
    t.compact(0.0)
    assert content(t) == want and t.folder.read_json("manifests/" + t.folder.names("manifests")[-1])["deltas"] == {}
    t.commit(deletes=ids(spark, *[r[0] for r in want]))
    assert content(t) == []
    t.compact()
    assert content(t) == []
    t.commit(spark.createDataFrame([("k1", 1, None)], SCHEMA))
    assert content(t) == [("k1", 1, None)]


def test_an_empty_table_and_an_empty_batch(spark):
    t = table(spark, [])
    assert content(t) == []
    t.commit(spark.createDataFrame([], SCHEMA), ids(spark))
    assert content(t) == [] and t.compact() == []
    t.commit(spark.createDataFrame([("a", 1, None)], SCHEMA))
    assert content(t) == [("a", 1, None)]


def test_a_batch_writes_by_its_own_size(spark):
    """One key changed among many: one bucket, and bytes that do not grow with the table."""
    written = []
    for n in (500, 50_000):
        rows = spark.range(n).selectExpr("concat('k', id) as id", "cast(id as int) as n", "sha2(string(id), 512) as note")
        t = KeyTable(spark, scratch_path(spark, "table"), ["id"], "id", 8)
        t.create(rows)
        t.commit(spark.createDataFrame([("k7", -1, None)], SCHEMA))
        assert [x for x in t.folder.names("files/version=1") if x.startswith("bucket=")].__len__() == 1
        written.append((t.folder.size("files/version=0"), t.folder.size("files/version=1")))
    assert written[1][0] > 20 * written[0][0] and written[1][1] <= written[0][1] * 1.1


def test_a_lookup_opens_the_buckets_of_its_keys(spark):
    t = table(spark, [(f"k{i}", i, None) for i in range(100)])
    t.commit(spark.createDataFrame([(f"k{i}", -i, None) for i in range(50)], SCHEMA))
    found = t.read(ids(spark, "k7", "k70", "none"))
    assert sorted(tuple(r) for r in found.collect()) == [("k7", -7, None), ("k70", 70, None)]
    every = len(t.read().inputFiles())
    assert len(t.read(ids(spark, "k7")).inputFiles()) <= 2 < every


def test_a_killed_batch_and_a_repeated_one(spark, monkeypatch):
    t = table(spark, [("a", 1, None), ("b", 2, None)])
    batch = spark.createDataFrame([("a", 10, None)], SCHEMA)
    monkeypatch.setattr(Folder, "write_json", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.commit(batch, name="one")
    monkeypatch.undo()
    assert content(t) == [("a", 1, None), ("b", 2, None)]
    again = KeyTable(spark, t.root, ["id"], "id", 8)
    assert again.commit(batch, name="one") and not again.commit(batch, name="one")
    assert content(again) == [("a", 10, None), ("b", 2, None)]


def test_plans_read_the_version_they_were_made_for(spark):
    t = table(spark, [("a", 1, None), ("b", 2, None)], buckets=1)
    before = t.read()
    t.commit(spark.createDataFrame([("a", 10, None)], SCHEMA))
    t.compact(0.0)
    assert before.where("id = 'a'").first().n == 1 and t.read().where("id = 'a'").first().n == 10
    for n in range(KEEP + 2):
        t.commit(spark.createDataFrame([("b", n, None)], SCHEMA))
    assert len(t.folder.names("manifests")) == KEEP + 1
    assert "bucket=0" not in t.folder.names("files/version=0")  # no kept manifest names it
    assert content(t) == [("a", 10, None), ("b", KEEP + 1, None)]


def same(a, b):
    cols = sorted(set(a.columns) & set(b.columns))
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_maintenance_equals_whole_snapshots(spark):
    """Three batches one after another on each table against M1-M7 on whole dimensions."""
    now = F.lit("2024-02-01").cast("timestamp")
    maps, keys, proxies = FX.mappings(spark, SF).cache(), FX.api_keys(spark, SF), FX.proxy_keys(spark, SF)
    tm = KeyTable(spark, scratch_path(spark, "t"), ["proxy_key_id", "provider"], "proxy_key_id", 4)
    tk, tp = (KeyTable(spark, scratch_path(spark, "t"), ["id"], "id", 4) for _ in range(2))
    for t, rows in ((tm, maps), (tk, keys), (tp, proxies)):
        t.create(rows)
    changes = FX.mapping_changes(spark, SF).cache()
    status = key_tables.upsert_mappings(tm, changes, now, "m1")
    whole, every = M.upsert_mappings(maps, changes, now)
    assert same(status, every.where("status <> 'kept'"))
    deletes = FX.mapping_deletes(spark, SF)
    status = key_tables.delete_mappings(tm, deletes, "m5")
    whole, every = M.delete_mappings(whole, deletes)
    assert same(status, every) and same(tm.read(), whole)
    status = key_tables.revoke_keys(tk, FX.revoke_ids(spark, SF), now, "m3")
    after = M.revoke_keys(keys, FX.revoke_ids(spark, SF), now)
    assert same(status, after.where("status <> 'untouched'"))
    after = after.where("key_hash IS NOT NULL").drop("status")
    key_tables.patch_api_keys(tk, FX.api_key_patches(spark, SF), "m4")
    after = M.patch_api_keys(after, FX.api_key_patches(spark, SF)).where("key_hash IS NOT NULL").drop("status")
    tk.compact(0.1)
    status = key_tables.create_keys(tk, FX.new_api_keys(spark, SF), "m6")
    after, every = M.create_keys(after, FX.new_api_keys(spark, SF))
    assert same(status, every) and same(tk.read(), after)
    dropped = FX.dropped_proxy_keys(spark, SF)
    key_tables.drop_proxy_keys_cascade(tp, tm, dropped, "m7")
    left, whole = M.drop_proxy_keys_cascade(proxies, whole, dropped)
    assert same(tp.read(), left) and same(tm.read(), whole)
    assert isinstance(tm.read().agg(F.max("updated_at")).first()[0], dt.datetime)
