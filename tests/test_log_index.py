"""Index tables beside the request log: which files a lookup reads, and that
the answers equal those of a full scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tokenledger.operators import analytics as A
from tokenledger.plans import catalog
from tokenledger.session import scratch_path
from tokenledger.sources import request_log as log_io
from tokenledger.sources.log_index import LogIndex

DAY = dt.datetime(2024, 1, 1)


def make_log(spark, path, days, per_day=30, first=0):
    """Ten requests an hour; one rare metadata pair and one rare proxy key."""
    template = catalog.materialized_log(spark, SF).where("reject_reason is null").limit(1)
    rows = []
    for d in range(days):
        for k in range(per_day):
            n = first + d * per_day + k
            at = DAY + dt.timedelta(days=first + d, minutes=6 * k)
            meta = {"feature": "search", "step": str(k % 3)}
            if n in (65, 68):
                meta["rare"] = "yes"
            rows.append((f"r{n}", at, at + dt.timedelta(seconds=n % 7), meta, "pk-rare" if n % 40 == 5 else "pk-usual",
                         None if n % 11 else "model_too_long"))
    own = spark.createDataFrame(rows, "id string, requested_at timestamp, created_at timestamp, "
                                      "indexed_metadata map<string,string>, proxy_key_id string, reject_reason string")
    drop = ["id", "requested_at", "created_at", "indexed_metadata", "proxy_key_id", "reject_reason", "requested_date"]
    log = own.withColumn("requested_date", F.to_date("requested_at")).crossJoin(F.broadcast(template.drop(*drop)))
    log_io.write_request_log(log.select(template.columns), path)


@pytest.fixture(scope="module")
def indexed(spark):
    path = scratch_path(spark, "log")
    make_log(spark, path, 6)
    index = LogIndex(spark, path, scratch_path(spark, "index"), buckets=4)
    assert index.update() >= 6 and index.update() == 0
    return path, index


def log(spark, path):
    return log_io.accepted(log_io.read_request_log(spark, path))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_containment_reads_only_files_with_the_pairs(spark, indexed):
    path, index = indexed
    for wanted, files in (({"rare": "yes"}, 1), ({"rare": "yes", "step": "2"}, 1), ({"feature": "search"}, 6),
                          ({"rare": "no"}, 0), ({"feature": "search", "rare": "yes"}, 1), ({}, 6)):
        rows = index.containing(wanted)
        assert len(index.files_containing(wanted)) == files
        same(A.metadata_contains(rows, wanted), A.metadata_contains(log(spark, path), wanted))
    assert A.metadata_contains(index.containing({"rare": "yes"}), {"rare": "yes"}).count() == 2


def test_newest_rows_read_few_files(spark, indexed):
    path, index = indexed
    assert len(index.newest(1).inputFiles()) == 1
    same(A.latest_request(index.newest(1)), A.latest_request(log(spark, path)))
    for key, n in (("pk-rare", 1), ("pk-rare", 3), ("pk-usual", 10), ("pk-usual", 1000), ("nobody", 5)):
        rows = index.newest_of_proxy_key(key, n)
        same(A.recent_by_proxy_key(rows, key, n), A.recent_by_proxy_key(log(spark, path), key, n))
    assert len(index.newest_of_proxy_key("pk-usual", 10).inputFiles()) == 1
    assert len(index.newest_of_proxy_key("pk-rare", 1).inputFiles()) == 1


def test_a_point_read_opens_one_bucket_and_one_file(spark, indexed):
    path, index = indexed
    assert A.body_pointer(index.request("r66"), "r66").count() == 0       # a rejected row
    rows = index.request("r64")
    assert len(rows.inputFiles()) == 1
    same(A.body_pointer(rows, "r64"), A.body_pointer(log(spark, path), "r64"))
    assert index.request("r-none").count() == 0
    ids = spark.read.parquet(f"{index.path}/ids")
    found = ids.where((F.col("bucket") == index._bucket(F.lit("r64"))) & (F.col("id") == "r64"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "xxhash64" not in plan


def test_appended_files_are_added_and_double_indexing_counts_once(spark):
    path, place = scratch_path(spark, "log"), scratch_path(spark, "index")
    make_log(spark, path, 2)
    index = LogIndex(spark, path, place, buckets=4)
    index.update()
    make_log(spark, path, 1, first=60)
    assert len(index.newest(1).inputFiles()) == 1 and index.update() == 1
    same(A.latest_request(index.newest(1)), A.latest_request(log(spark, path)))
    again = LogIndex(spark, path, place, buckets=4)
    assert again.files == index.files and again.update() == 0
    again.files = set()                          # as after a job that failed before it wrote its zones
    again.update()
    for n in (1, 40, 70):
        same(again.newest(n).orderBy(F.desc("created_at"), "id").limit(n).select("id"),
             log(spark, path).orderBy(F.desc("created_at"), "id").limit(n).select("id"))
    same(A.body_pointer(again.request("r61"), "r61").select("id"), log(spark, path).where("id = 'r61'").select("id"))


def test_a_log_without_accepted_rows(spark):
    path = scratch_path(spark, "log")
    log_io.write_request_log(catalog.materialized_log(spark, SF).limit(3).withColumn("reject_reason", F.lit("not_null")), path)
    index = LogIndex(spark, path, scratch_path(spark, "index"), buckets=2)
    assert index.update() > 0
    assert index.newest(5).count() == 0 and index.files_containing({"a": "b"}) == set()
