"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of every
benchmark text; a text with fewer words is one shorter pattern.  Words are
coded by the vocabulary of the patterns (any other word is code 0), so the
alphabet is large and blocks of two words are selective:

* ``shift``: for each hashed block, how far a window end may jump;
* ``bucket``: patterns ordered by the hash of their last block; each also
  keeps the hash of its first block, which is compared before the words;
* direct comparison of all words confirms an occurrence.

Patterns of one length form a class with tables of its own, so that one short
benchmark text does not shorten the jumps for all others.

Cases: a null or wordless text has no words and no hits; benchmark rows
without words are ignored; repeated benchmark texts count once per item id
(items with a null id mark words but are not listed); repeated document rows
each get their row; an empty benchmark hits nothing; extra columns of either
table are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.session import scratch_path

LANE = 1024
MIX = np.int64(0x9E3779B1)
ENTRIES = 1 << 20   # of a table at most; what shares an entry is told apart by its words


@dataclass
class LengthClass:
    """Tables for all patterns of one length."""
    length: int
    patterns: np.ndarray                  # (patterns, length) word codes
    item_at: np.ndarray                   # per pattern: where its items begin in item_of
    item_of: np.ndarray                   # indexes of items
    shift: np.ndarray = field(init=False)
    mask: int = field(init=False)

    def __post_init__(self) -> None:
        n, m = self.patterns.shape
        size = min(ENTRIES, 1 << max(8, int(np.ceil(np.log2(max(1, n * m) * 4)))))
        self.mask = size - 1
        b = min(2, m)
        self.shift = np.full(size, m - b + 1, np.int32)
        for end in range(b - 1, m):
            np.minimum.at(self.shift, self.block(self.patterns, end), m - 1 - end)
        last = self.block(self.patterns, m - 1)
        order = np.argsort(last, kind="stable")
        self.patterns = self.patterns[order]
        count = np.diff(self.item_at)[order]
        begin = self.item_at[:-1][order]
        self.item_at = np.concatenate([[0], np.cumsum(count)])
        self.item_of = self.item_of[np.arange(count.sum()) + np.repeat(begin - self.item_at[:-1], count)]
        self.first = self.block(self.patterns, b - 1)
        last = last[order]
        self.bucket_at = np.searchsorted(last, np.arange(size + 1)).astype(np.int32)

    def block(self, rows: np.ndarray, end: int) -> np.ndarray:
        """Hash of the block that ends at word ``end`` of each row."""
        h = rows[..., end].astype(np.int64)
        if self.length > 1:
            h = h + rows[..., end - 1].astype(np.int64) * MIX
        return (h ^ (h >> 15)) & self.mask

    def block_at(self, codes: np.ndarray, pos: np.ndarray) -> np.ndarray:
        h = codes[pos].astype(np.int64)
        if self.length > 1:
            h = h + codes[pos - 1].astype(np.int64) * MIX
        return (h ^ (h >> 15)) & self.mask

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence.  Many lanes of the
        text are walked side by side, each jumping by its own shifts."""
        m = self.length
        pos = np.arange(m - 1, len(codes), LANE, dtype=np.int64)
        stop = np.minimum(pos + LANE, len(codes))
        ends = []
        while len(pos):
            jump = self.shift[self.block_at(codes, pos)]
            ends.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        end = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        found_end, found = [], []
        for part in np.array_split(end, max(1, len(end) // 100_000)):
            h = self.block_at(codes, part)
            lo, count = self.bucket_at[h], self.bucket_at[h + 1] - self.bucket_at[h]
            e = np.repeat(part, count)
            p = np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            ok = self.first[p] == self.block_at(codes, e - m + min(2, m))
            e, p = e[ok], p[ok]
            for k in range(m):
                ok = codes[e - m + 1 + k] == self.patterns[p, k]
                e, p = e[ok], p[ok]
            found_end.append(e)
            found.append(p)
        return np.concatenate(found_end), np.concatenate(found)


@dataclass
class Patterns:
    vocabulary: pa.Array
    classes: list[LengthClass]
    ids: list


def compile_patterns(items: list[tuple], window: int) -> Patterns:
    """Pattern tables of [(item id, text)]."""
    offsets, values = at.words(at.texts_of(pa.array([t for _, t in items], pa.string())), at.LOWER_ALNUM)
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32) + 1 if len(values) else np.zeros(0, np.int32)
    length = np.minimum(np.diff(offsets), window)
    classes = []
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        windows = np.diff(offsets)[own] - m + 1
        first = np.arange(windows.sum()) + np.repeat(offsets[own] - np.cumsum(windows) + windows, windows)
        rows = np.lib.stride_tricks.sliding_window_view(codes, m)[first]
        kinds, kind = np.unique(rows.view(np.dtype((np.void, 4 * m))).ravel(), return_inverse=True)
        pairs = np.unique(kind * np.int64(len(items)) + np.repeat(own, windows))
        classes.append(LengthClass(m, kinds.view(np.int32).reshape(-1, m), np.searchsorted(pairs // len(items), np.arange(len(kinds) + 1)),
                                   (pairs % len(items)).astype(np.int32)))
    return Patterns(coded.dictionary, classes, [i for i, _ in items])


def scan(texts: pa.LargeStringArray, patterns: Patterns):
    """Per text: number of words, mask of hit words, and the (row, item)
    pairs found, as (word offsets, hit mask, rows, item indexes)."""
    import pyarrow.compute as pc
    offsets, values = at.words(texts, at.LOWER_ALNUM)
    n = len(texts)
    code = pc.fill_null(pc.index_in(values, value_set=patterns.vocabulary.cast(pa.large_string())), -1).to_numpy(
        zero_copy_only=False).astype(np.int32) + 1
    rows = at.row_of(offsets)
    # a 0 between texts: no pattern holds it, so none crosses
    where = np.arange(len(code)) + rows + 1
    codes = np.zeros(len(code) + n + 1, np.int32)
    codes[where] = code
    depth = np.zeros(len(codes) + 1, np.int32)
    row_found, item_found = [], []
    starts = offsets[:-1] + np.arange(n) + 1
    for cls in patterns.classes:
        end, p = cls.find(codes)
        np.add.at(depth, end - cls.length + 1, 1)
        np.add.at(depth, end + 1, -1)
        row = np.searchsorted(starts, end, "right") - 1
        pairs = np.unique(np.stack([row, p], 1), axis=0) if len(end) else np.zeros((0, 2), np.int64)
        for r, q in pairs.tolist():
            for i in cls.item_of[cls.item_at[q]:cls.item_at[q + 1]].tolist():
                row_found.append(r)
                item_found.append(i)
    hit = np.cumsum(depth)[where] > 0
    return offsets, hit, row_found, item_found


def _scan_table(docs: DataFrame, text: str, patterns: Patterns) -> DataFrame:
    """Adds the hits of one block of patterns to _hits (spans of words that
    are hit, as start and end pairs) and _items."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    names = docs.columns
    schema = docs.schema

    def run(batches):
        pats = shared.value
        for batch in at.slices(batches, text):
            offsets, hit, rows, items = scan(at.texts_of(batch.column(text)), pats)
            found: dict[int, set] = defaultdict(set)
            for r, i in zip(rows, items):
                if pats.ids[i] is not None:
                    found[r].add(pats.ids[i])
            any_hit = np.flatnonzero(np.add.reduceat(np.append(hit, 0).astype(np.int64), offsets[:-1])
                                     * (np.diff(offsets) > 0)) if len(hit) else []
            old_hits, old_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            for r in any_hit:
                own = hit[offsets[r]:offsets[r + 1]].astype(np.int8)
                edge = np.flatnonzero(np.diff(own, prepend=0, append=0))
                old_hits[r] = old_hits[r] + edge.tolist()
                old_items[r] = sorted(set(old_items[r]) | found[r])
            cols = {"_hits": old_hits, "_items": old_items, "_words": np.diff(offsets)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[c], to_type(c)) if c in cols else batch.column(c) for c in names], names)

    def to_type(c):
        return {"_hits": pa.list_(pa.int64()), "_items": pa.list_(pa.int64()), "_words": pa.int64()}[c]

    return docs.mapInArrow(run, schema)


def covered(spans: list[int]) -> int:
    """Words in the union of [start, end) pairs listed flat."""
    total = last = 0
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        total += max(0, e - max(s, last))
        last = max(last, e)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13, block_bytes: int = 16 << 20,
                  prefix: str = "") -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted as strings) and contaminated to
    each row of ``docs``.

    The benchmark is broadcast in blocks of at most about ``block_bytes`` of
    text; beyond one block the documents pass the blocks one after another,
    with a written table in between, so neither the driver nor a task ever
    holds more than one block, whatever the benchmark's size.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    out = docs.withColumns({"_hits": F.array().cast("array<bigint>"), "_items": F.array().cast("array<bigint>"),
                            "_words": F.lit(0).cast("long")})
    for k in range(blocks):
        rows = [(r.i, r.t) for r in texts.where(block == k).where("t is not null").collect()]
        out = _scan_table(out, text, compile_patterns(rows, window))
        if k < blocks - 1:
            path = scratch_path(spark, "decontaminate")
            out.write.parquet(path)
            out = spark.read.parquet(path)
    if blocks == 1:  # spans of one block do not overlap
        n_hit = F.aggregate(F.transform("_hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                            F.lit(0).cast("long"), lambda a, x: a + x)
    else:
        n_hit = F.udf(covered, "bigint")("_hits")
    out = out.withColumn("_hit", n_hit)
    return out.select(
        *docs.columns, F.col("_words").alias(prefix + "n_words"), F.col("_hit").alias(prefix + "n_hit"),
        F.array_sort(F.transform("_items", lambda x: x.cast("string"))).alias(prefix + "item_ids"),
        ((F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_words"))).alias(prefix + "contaminated"))
