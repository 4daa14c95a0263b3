import random

from pyspark.sql import functions as F

from tokenledger.operators import maintenance as M
from tokenledger.operators import metadata



def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _maps(spark):
    return spark.createDataFrame([
        ("m1", "p1", "openai", "e1", "2023-01-01 00:00:00", "2023-01-01 00:00:00"),
        ("m2", "p1", "anthropic", "e2", "2023-01-02 00:00:00", "2023-01-02 00:00:00")],
        "id string, proxy_key_id string, provider string, encrypted_key string, created_at string, updated_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_upsert_semantics_and_idempotence(spark):
    maps = _maps(spark)
    ch = spark.createDataFrame([("p1", "openai", "new1", 1, "n1"), ("p1", "openai", "new2", 2, "n2"),
                                ("p1", "gemini", "g", 1, "n3")],
                               "proxy_key_id string, provider string, encrypted_key string, seq int, new_id string")
    new, status = M.upsert_mappings(maps, ch, now())
    rows = {r["provider"]: r for r in new.collect()}
    assert rows["openai"]["id"] == "m1" and rows["openai"]["encrypted_key"] == "new2"
    assert str(rows["openai"]["created_at"]) == "2023-01-01 00:00:00" and str(rows["openai"]["updated_at"]) == "2024-02-01 00:00:00"
    assert rows["gemini"]["id"] == "n3" and rows["anthropic"]["encrypted_key"] == "e2"
    again, _ = M.upsert_mappings(new, ch, now())   # applying the same batch twice changes nothing
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, new.collect()))


def test_register_revoke_patch_delete_create_drop(spark):
    mk = spark.createDataFrame([("a1", "feature", True)], "api_key_id string, key_name string, is_active boolean")
    seen = spark.createDataFrame([("a1", "feature"), ("a1", "step"), ("a1", "step")], "api_key_id string, key_name string")
    reg = M.register_metadata_keys(mk, seen)
    assert sorted((r["key_name"], r["is_active"], r["is_new"]) for r in reg.collect()) == \
        [("feature", True, False), ("step", False, True)]
    assert M.register_metadata_keys(reg.drop("is_new"), seen).where("is_new").count() == 0

    ak = spark.createDataFrame([("a1", "h1", "n1", "d1", True, None), ("a2", "h2", "n2", "d2", False, None)],
                               "id string, key_hash string, name string, description string, is_active boolean, revoked_at timestamp")
    rev = {r["id"]: r for r in M.revoke_keys(ak, spark.createDataFrame([("a1",), ("a2",), ("zz",)], "id string"), now()).collect()}
    assert (rev["a1"]["status"], rev["a1"]["is_active"]) == ("revoked", False)
    assert rev["a2"]["status"] == "not_found" and rev["zz"]["status"] == "not_found"

    patches = spark.createDataFrame([("a1", "new", None, 1), ("a2", None, None, 1), ("zz", "x", None, 1)],
                                    "id string, name string, description string, seq int")
    pat = {r["id"]: r for r in M.patch_api_keys(ak, patches).collect()}
    assert (pat["a1"]["name"], pat["a1"]["description"], pat["a1"]["status"]) == ("new", "d1", "updated")
    assert pat["a2"]["status"] == "unchanged" and pat["zz"]["status"] == "not_found"

    kept, st = M.delete_mappings(_maps(spark), spark.createDataFrame(
        [("p1", "openai"), ("p1", "gemini")], "proxy_key_id string, provider string"))
    assert [r["provider"] for r in kept.collect()] == ["anthropic"]
    assert sorted((r["provider"], r["status"]) for r in st.collect()) == [("gemini", "missing"), ("openai", "deleted")]

    new_keys = spark.createDataFrame([("n1", "h1", "x", None, 1), ("n2", "h9", "y", None, 2), ("n3", "h9", "z", None, 3)],
                                     "id string, key_hash string, name string, description string, seq int")
    table, st = M.create_keys(ak, new_keys)
    assert sorted((r["id"], r["status"]) for r in st.collect()) == \
        [("n1", "duplicate_existing"), ("n2", "created"), ("n3", "duplicate_in_batch")]
    assert table.count() == 3

    pk = spark.createDataFrame([("p1",), ("p2",)], "id string")
    kk, km = M.drop_proxy_keys_cascade(pk, _maps(spark), spark.createDataFrame([("p1",)], "id string"))
    assert [r["id"] for r in kk.collect()] == ["p2"] and km.count() == 0


def test_sketch_merge_law(spark):
    random.seed(7)
    rows = [("k1" if i % 3 else "k2", {"user": f"u{random.randint(0, 300)}", "f": f"x{i % 5}"}, i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "api_key_id string, raw_metadata map<string,string>, t long") \
        .withColumn("responded_at", F.timestamp_seconds("t"))
    whole = metadata.metadata_key_stats(df)
    parts = [metadata.metadata_key_stats(df.where(F.col("t") % 3 == i)) for i in range(3)]
    merged = metadata.merge_key_stats(metadata.merge_key_stats(parts[0], parts[1]), parts[2])
    cols = ["api_key_id", "key_name", "request_count", "last_seen_at", "approx_cardinality"]
    assert sorted(map(tuple, merged.select(*cols).collect())) == sorted(map(tuple, whole.select(*cols).collect()))
    exact = {(r[0], r[1]): r[2] for r in df.select("api_key_id", F.explode("raw_metadata")).groupBy("api_key_id", "key")
             .agg(F.countDistinct("value")).collect()}
    for r in whole.collect():
        assert abs(r["approx_cardinality"] - exact[(r["api_key_id"], r["key_name"])]) <= 2
    back = metadata.key_cardinality(whole)
    assert back.count() == whole.count()
