"""Registered queries of the corpus operators, and their DuckDB SQL.

Each query applies its operator with production parameters to the whole table
and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import (
    byte_pair, cross_align, decontaminate, fill_middle, html_extract, license_scan, packing, quality_classifier, quality_rules, secret_scan, sketch_dedup,
    token_counts, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = quality_classifier.learnable(table(spark, sf_dir, "labels"), "quality", 3, 1)
    scored = quality_classifier.scored(docs, quality_classifier.train(docs, known))
    return _verdicts(scored, 3, 1)


def _verdicts(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", quality_classifier.held_out(modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", limit=2048)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"), least=0.8)
    covered = F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.split_part(
            m["license"], F.lit(":"), F.lit(1))))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"),
        covered.alias("license_words"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"),
                                                                  m["end"].cast("string"))), ",").alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in secret_scan.BASE],
        F.sha2(secret_scan.spans_text(F.col("spans"), secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = quality_classifier.learnable(table(spark, sf_dir, "labels"), "toxic", 5, 0)
    return _verdicts(toxicity.scored(docs, toxicity.train(docs, known)), 5, 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judged(docs, table(spark, sf_dir, "labels"), drop_text=True)
    return judged.select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in quality_rules.COUNTS],
        F.col("stats_base_failed").alias("base_failed"),
        (~F.col("stats_base_failed") & (F.col("stats_rule") == 0)).alias("kept"))


def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_align.align(table(spark, sf_dir, "documents"), a="byte_bpe_50k.json", b="piece_bpe_32k.model",
                              digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"), seed=7, plain_percent=0, spm_percent=50)
    return fill_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_pair.encode(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json")
    return byte_pair.decode(encoded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                            F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_main_text": op7_main_text,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_cross_align": op11_cross_align,
    "op12_fill_middle": op12_fill_middle,
    "op13_bpe": op13_bpe,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x20\\x09-\\x0D]+')"

ORACLE = {
    "op5_decontaminate": f"""
WITH items AS (
  SELECT item_id, {_ALNUM_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, w[s : s + least(13, len(w)) - 1] AS win
  FROM items, UNNEST(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce({_ALNUM_WORDS.format('text')}, []) AS w FROM documents
), doc_windows AS (
  SELECT doc_id, s, m, w[s : s + m - 1] AS win
  FROM docs, (SELECT DISTINCT m FROM windows) AS l, UNNEST(range(1, len(w) - m + 2)) AS t(s)
), found AS (
  SELECT d.doc_id, d.s, d.m, i.item_id FROM doc_windows AS d JOIN windows AS i ON d.m = i.m AND d.win = i.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, UNNEST(range(s, s + m)) AS t(p) GROUP BY doc_id
), items_of AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs AS d LEFT JOIN hit AS h USING (doc_id) LEFT JOIN items_of AS i USING (doc_id)
""",
    "op8_near_duplicates": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce({_SPACED_WORDS.format('text')}, []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[s : s + 2] AS x FROM docs, UNNEST(range(1, greatest(len(w) - 1, 2))) AS t(s) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT DISTINCT a AS id, a AS other FROM links
  UNION SELECT r.id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
), labels AS (SELECT id, min(other) AS label FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(label, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(label, d.doc_id)) = d.doc_id AS kept
FROM docs AS d LEFT JOIN sizes AS s USING (doc_id) LEFT JOIN labels AS l ON l.id = d.doc_id
""",
}
