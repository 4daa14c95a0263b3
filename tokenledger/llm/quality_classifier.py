"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

Features of a text are hashed n-grams of its words: words and pairs of words
(lower-cased), and singles, pairs and triples of word shapes (runs of capitals,
small letters, digits and symbols; a pair also says whether the word repeats).
Their values are relative frequencies, so a score is a sparse dot product:
the mean weight of all n-gram occurrences, scaled, through the logistic.

Training takes at most ``MAX_LABELLED`` labelled rows (those with the smallest
id hash): their features are made in parallel and streamed through one task
that runs follow-the-regularised-leader updates; the weight vector has a fixed
size and is broadcast.

Cases: a null, empty or wordless text scores the intercept alone; without
labels every score is 0.5; contradicting or null labels are not learned from;
repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at

DIM = 1 << 18
SCALE = 20.0
MAX_LABELLED = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.002, 0.01


def features_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(n-grams per row, [(row, hashed index)]) over the n-gram kinds."""
    offsets, values = at.words(texts, at.SPACED)
    n = len(texts)
    if not len(values):
        return np.zeros(n, np.int64), []
    coded = values.dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    shape = pc.replace_substring_regex(words, "[A-ZÀ-ÖØ-Þ]+", "X")
    shape = pc.replace_substring_regex(shape, r"[a-zß-öø-ÿ\x{100}-\x{10FFFF}]+", "x")
    shape = pc.replace_substring_regex(shape, "[0-9]+", "9")
    low = at.hash_strings(pc.utf8_lower(words))[code]
    form = at.word_hashes(shape)[code]
    row = at.row_of(offsets)
    two, three = np.zeros(len(row), bool), np.zeros(len(row), bool)
    two[1:] = row[1:] == row[:-1]
    three[2:] = row[2:] == row[:-2]
    before, form1, form2 = np.roll(low, 1), np.roll(form, 1), np.roll(form, 2)
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        grams = [(row, low), (row[two], (before * k1 + low)[two] + np.uint64(1)), (row, form * k1 + np.uint64(2)),
                 (row[two], (form1 * k1 + form * k2 + (before == low))[two] + np.uint64(3)),
                 (row[three], ((form2 * k1 + form1) * k2 + form)[three] + np.uint64(4))]
    grams = [(r, (at.mix(h) & np.uint64(DIM - 1)).astype(np.int64)) for r, h in grams]
    return sum(np.bincount(r, minlength=n) for r, _ in grams), grams


def margins(texts: pa.LargeStringArray, weights: np.ndarray, intercept: float) -> np.ndarray:
    total, grams = features_of(texts)
    dot = np.zeros(len(texts))
    for row, index in grams:
        dot += np.bincount(row, weights[index], minlength=len(texts))
    return intercept + SCALE * np.divide(dot, total, out=np.zeros(len(texts)), where=total > 0)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader, proximal, with per-coordinate rates;
    coordinate DIM is the intercept and has no penalty."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(self, at_: np.ndarray) -> np.ndarray:
        z, free = self.z[at_], at_ == DIM
        l1 = np.where(free, 0.0, L1)
        step = (BETA + np.sqrt(self.n[at_])) / ALPHA + np.where(free, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / step)

    def update(self, at_: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at_)
        g = (logistic(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at_] + g * g) - np.sqrt(self.n[at_])) / ALPHA
        self.z[at_] += g - sigma * w
        self.n[at_] += g * g


def learnable(labels: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, y) of usable labels that are not held out."""
    return (labels.where(~held_out(modulus, remainder) & F.col(column).isNotNull()).groupBy("doc_id")
            .agg(F.min(column).alias("y"), F.max(column).alias("y2")).where("y = y2").select("doc_id", "y"))


def smallest(rows: DataFrame, most: int, by: str = "h") -> DataFrame:
    """The rows whose hash ``by`` is at most a bound: all of the ``most``
    smallest and, unless hashes repeat, fewer than ``most`` others.  Counts per
    hash prefix give the bound, so no task and no driver sees more rows than
    it keeps, however large the input."""
    low, bits, taken = 0, 64, 0
    while bits > 0:
        above, bits = bits, bits - min(12, bits)
        # arithmetic shift: prefixes are in the order of the signed hashes
        here = rows.select(by) if above == 64 else rows.select(by).where(F.shiftright(by, above) == low)
        counts = here.groupBy(F.shiftright(by, bits).alias("p")).count().collect()
        for prefix, count in sorted((r[0], r[1]) for r in counts):
            if taken + count >= most:
                break
            taken += count
        else:  # only at the first level: fewer rows than ``most``
            return rows
        low = prefix
        if count <= most:
            break
    return rows.where(F.shiftright(by, bits) <= low)


def sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows: the smallest id hashes."""
    hashed = labelled.withColumn("h", F.xxhash64("doc_id"))
    return smallest(hashed, most).orderBy("h", "doc_id").limit(most)


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id",
          most: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(weights, intercept) from at most ``most`` labelled rows."""
    chosen = sample(labelled, most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in at.slices(batches, "t"):
            total, grams = features_of(at.texts_of(batch.column("t")))
            n = batch.num_rows
            key = np.concatenate([r * DIM + i for r, i in grams]) if grams else np.zeros(0, np.int64)
            key, count = np.unique(key, return_counts=True)
            cut = np.searchsorted(key, np.arange(n + 1) * DIM)
            index, x = (key % DIM).astype(np.int32), np.zeros(len(key), np.float32)
            if len(key):
                x = (SCALE * count / total[key // DIM]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y").cast(pa.int32()),
                 pa.array([index[cut[k]:cut[k + 1]].tobytes() for k in range(n)], pa.binary()),
                 pa.array([x[cut[k]:cut[k + 1]].tobytes() for k in range(n)], pa.binary())], ["h", "y", "i", "x"])

    def fit(batches):
        held = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), float(y)) for b in batches
                for y, i, x in zip(b.column("y").to_pylist(), b.column("i").to_pylist(), b.column("x").to_pylist())]
        model = Ftrl()
        for _ in range(EPOCHS):
            for i, x, y in held:
                model.update(np.append(i, DIM), np.append(x, 1.0), y)
        w = model.weights(np.arange(DIM + 1)).astype(np.float32) if held else np.zeros(DIM + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    # one bounded task: at most ``most`` feature vectors
    fitted = (rows.mapInArrow(features, "h long, y int, i binary, x binary").repartition(1).sortWithinPartitions("h", "y")
              .mapInArrow(fit, "w binary").collect())
    w = np.frombuffer(fitted[0].w, np.float32) if fitted else np.zeros(DIM + 1, np.float32)
    return w[:DIM].copy(), float(w[DIM])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, intercept = shared.value
        for batch in at.slices(batches, text):
            score = logistic(margins(at.texts_of(batch.column(text)), weights, intercept))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))
