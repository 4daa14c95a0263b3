import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import SF
from tests.llm.common import groups, odd, odd_rows, words


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_dedup":
            label = groups(list(before.items()), 5, 80)
            assert set(after) == {i for i in before if label[i] == i}
        if name == "secret_scan":
            assert set(after) == set(before)
        else:
            assert all(after[i] == before[i] for i in after)
        at = out.cache()
    kept = {r.doc_id for r in at.collect()}
    packed = cp.packed(spark, at, SF).collect()
    assert {r.doc_id for r in packed} == kept and kept < set(rows)


def test_stages_on_odd_rows(spark):
    for name, stage in cp.STAGES:
        out = stage(spark, odd(spark), SF)
        n = out.count()
        assert n >= (0 if name == "quality_rules" else 1), name
        if name == "near_dedup":
            ids = [r.doc_id for r in out.collect()]
            assert sorted(i for i in ids if i in (4, 5)) == [4]
        if name in ("decontamination", "secret_scan"):
            assert n == len(odd_rows())
        assert stage(spark, odd(spark).limit(0), SF).count() == 0, name


def test_stages_carry_every_column(spark):
    """Columns named like the operators' own come through as they were."""
    names = ["_hits", "_items", "_words", "_hit", "_quality", "_quality_rule", "_quality_base_failed", "_bench_contaminated",
             "stats", "kept", "column0", "component_id", "a b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    before = {r.doc_id: r for r in docs.collect()}
    docs = spark.createDataFrame(list(before.values()), docs.schema)
    for stage, run in cp.STAGES[:-1]:
        out = run(spark, docs, SF)
        assert out.columns == docs.columns, stage
        rows = out.collect()
        assert rows
        for r in rows:
            own = before[r.doc_id]
            changed = {c for c in docs.columns if r[c] != own[c]}
            assert changed <= ({"text", "n_chars"} if stage == "secret_scan" else set()), (stage, changed)


def test_other_texts_of_an_id_stay(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, c), (None, a)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in cp.near_dedup(spark, docs, SF).collect())
    assert got == sorted([(0, a), (1, a), (1, b), (2, c)])


def test_hot_group_leaves_one(spark):
    rng = random.Random(3)
    base = words(rng, 90)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    out = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    label = groups(rows, 5, 80)
    assert {r.doc_id for r in out.collect()} == {i for i in label if label[i] == i}
