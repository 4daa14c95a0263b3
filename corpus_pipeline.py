"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns they were given.

Cases, for every stage: null and empty texts pass through the filters they do
not fail (a null text has no words, so the quality rules reject it); repeated
rows are judged alike, and near-dedup keeps one row of them; empty tables give
empty tables; columns beyond those of ``documents`` are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import decontaminate, packing, quality_rules, secret_scan, sketch_dedup
from tokenledger.llm.queries import table
from tokenledger.session import scratch_path


def _own(docs: DataFrame) -> DataFrame:
    """The documents under names that no operator uses, but for id and text."""
    return docs.select([F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"column{k}")
                        for k, c in enumerate(docs.columns)])


def _given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows made from ``_own(docs)`` with the columns and names of ``docs``."""
    return rows.select([F.col(c if c in ("doc_id", "text") else f"column{k}").alias(c)
                        for k, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    judged = quality_rules.judged(_own(docs), table(spark, sf_dir, "labels"), name="_quality")
    return _given(judged.where(~F.col("_quality_base_failed") & (F.col("_quality_rule") == 0)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8) stays:
    the one with the smallest id.  Rows with a null id are not compared and stay.
    Of rows that repeat an id and its text one stays; an id's other texts stay."""
    own = _own(docs)
    found = sketch_dedup.near_duplicates(own, shingle=5, percent=80)
    path = scratch_path(spark, "duplicates")
    found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct().write.parquet(path)
    kept = sketch_dedup.without(own, spark.read.parquet(path))
    repeated = own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return _given(kept, docs)
    # only ids that do repeat are shuffled with their texts
    once = sketch_dedup.without(kept, repeated)
    several = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*kept.columns)
    return _given(once.union(several), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.contamination(_own(docs), table(spark, sf_dir, "benchmark"), prefix="_bench_")
    return _given(found.where(~F.col("_bench_contaminated")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows the text."""
    masked = _given(secret_scan.redacted(_own(docs)), docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                                   .otherwise(F.col("n_chars")))
    return masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as op1 returns them, with their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secrets), ("packing", packed)]

#: learned rules, sketches and a tokenizer are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
