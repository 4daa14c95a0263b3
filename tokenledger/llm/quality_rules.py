"""Quality rules: a decision list learned from labelled text statistics.

``text_stats`` computes counts and ratios of every whole text.  ``learn``
grows rules by sequential covering: a rule is a conjunction of thresholds,
grown on two thirds of the labelled rows by information gain, pruned on the
other third from its end, and kept while it is precise enough there; rows it
covers are taken away before the next rule.  ``as_column`` emits the list as an
ordered Spark conditional expression, so it is applied without Python.

Cases: words are [^\\x20\\x09-\\x0D]+; a null text counts as empty; ratios of
nothing are 0; without labels, or without one of the two classes, the list is
empty and rejects nothing; labels that are null, or contradict each other for
one id, are not learned from; repeated rows each get their row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.quality_classifier import smallest
from tokenledger.session import scratch_path

#: counts of the contract, then the inputs of the learned rules
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "bang_ratio", "digit_ratio",
          "distinct_ratio", "wordless_ratio", "sentence_ratio")
#: Labelled rows used for learning, at most (those with the smallest id hash).
MAX_LABELLED = 20_000
#: Least share of rejected rows among those a rule covers in the pruning rows.
PRECISION = 0.97


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _in_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANK, _SYMBOL = _in_class(b" \t\n\v\f\r"), _in_class(b"#*$%&|<>")
_UPPER, _LETTER = _in_class(bytes(range(65, 91))), _in_class(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _END = _in_class(b"0123456789"), _in_class(b".!?")


def repeats_in_rows(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each (row, key) occurs more than once."""
    order = np.lexsort((key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stats_of(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    n = len(texts)
    off, body = at.raw(texts)
    offsets, values = at.words(texts, at.SPACED)
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.uint64) if len(values) else np.zeros(0, np.uint64)
    row = at.row_of(offsets)
    words = np.diff(offsets)
    out = {"n_words": words, "word_chars": _per_row(((body & 0xC0) != 0x80) & ~_BLANK[body], off),
           "n_symbols": _per_row(_SYMBOL[body], off)}
    # lines with a word, equal to an earlier line of the text
    lists = pc.split_pattern(texts, "\n")
    line_off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    lines = lists.flatten()
    line_row = at.row_of(line_off)
    full = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    line_code = lines.dictionary_encode().indices.to_numpy()[full]
    distinct = np.unique(np.column_stack([line_row[full], line_code]), axis=0)[:, 0] if full.any() else []
    n_lines = np.bincount(line_row[full], minlength=n)
    out["n_dup_lines"] = n_lines - np.bincount(np.asarray(distinct, np.int64), minlength=n)
    # words inside 3-word windows that occur twice or more
    hit = np.zeros(len(code) + 3, np.int64)
    if len(code) > 2:
        inside = row[2:] == row[:-2]
        if len(coded.dictionary) < 1 << 21:
            key = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
        else:
            with np.errstate(over="ignore"):
                key = at.mix(at.mix(at.mix(code[:-2]) + code[1:-1]) + code[2:])
        start = np.flatnonzero(inside)
        twice = start[repeats_in_rows(row[start], key[start])]
        for k in range(3):
            hit[twice + k] = 1
    out["n_repeat_words"] = _per_row(hit[:len(code)], offsets)
    first = np.unique(row * (len(coded.dictionary) + 1) + code.astype(np.int64))
    distinct_words = np.bincount(first // (len(coded.dictionary) + 1), minlength=n) if len(code) else np.zeros(n)
    plain = pc.match_substring_regex(coded.dictionary, r"[0-9A-Za-z\x{80}-\x{10FFFF}]").to_numpy(zero_copy_only=False)
    wordless = _per_row(~plain[code.astype(np.int64)], offsets) if len(code) else np.zeros(n)
    letters = _per_row(_LETTER[body], off)
    out |= {
        "mean_word": _ratio(out["word_chars"], words), "symbol_ratio": _ratio(out["n_symbols"], out["word_chars"]),
        "upper_ratio": _ratio(_per_row(_UPPER[body], off), letters),
        "dup_line_ratio": _ratio(out["n_dup_lines"], n_lines), "repeat_ratio": _ratio(out["n_repeat_words"], words),
        "bang_ratio": _ratio(_per_row(body == 0x21, off), words),
        "digit_ratio": _ratio(_per_row(_DIGIT[body], off), out["word_chars"]),
        "distinct_ratio": _ratio(distinct_words, words), "wordless_ratio": _ratio(wordless, words),
        "sentence_ratio": _ratio(_per_row(_END[body], off), words)}
    return out


_STATS_TYPE = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in RATIOS])


def text_stats(docs: DataFrame, text: str = "text", name: str = "stats", drop_text: bool = False) -> DataFrame:
    """Adds a struct column of the statistics of ``text``."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(name, StructType(
        [StructField(c, LongType()) for c in COUNTS] + [StructField(c, DoubleType()) for c in RATIOS]))])

    def run(batches):
        for batch in at.slices(batches, text):
            got = stats_of(at.texts_of(batch.column(text)))
            stats = pa.StructArray.from_arrays(
                [pa.array(got[f.name], f.type) for f in _STATS_TYPE], fields=list(_STATS_TYPE))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), stats], [*kept, name])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float


def _covers(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        out &= (x[t.feature] > t.threshold) if t.above else (x[t.feature] <= t.threshold)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, most_rules: int = 24, most_tests: int = 4,
          precision: float = PRECISION, least_cover: int = 5) -> list[list[Test]]:
    """Ordered rules; each covers rows to reject.  ``prune`` marks the rows
    kept for pruning."""
    left, rules = np.ones(len(bad), bool), []
    for _ in range(most_rules):
        rule = _grow({k: v[left & ~prune] for k, v in x.items()}, bad[left & ~prune], most_tests)
        px, pbad = {k: v[left & prune] for k, v in x.items()}, bad[left & prune]
        while len(rule) > 1 and _worth(rule[:-1], px, pbad) >= _worth(rule, px, pbad):
            rule = rule[:-1]
        if not rule:
            break
        hit = _covers(rule, px)
        if hit.sum() < least_cover or pbad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def _worth(rule, x, bad) -> float:
    hit = _covers(rule, x)
    p = float(bad[hit].sum())
    return (2 * p - hit.sum()) / max(1, hit.sum())


def _grow(x, bad, most_tests) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, choice = 1e-9, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0.005, 0.995, 199)))
            order = np.argsort(v, kind="stable")
            at_ = np.searchsorted(v[order], cuts, "right")
            bad_low = np.concatenate(([0], np.cumsum(b[order])))[at_]
            for above, p, k in ((False, bad_low, at_), (True, p0 - bad_low, len(v) - at_)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / k) - np.log2(p0 / (p0 + n0))), 0)
                j = int(np.argmax(np.nan_to_num(gain)))
                if gain[j] > best:
                    # half way to the next value, for a margin
                    sorted_v, k = v[order], int(at_[j])
                    cut = (sorted_v[k - 1] + sorted_v[k]) / 2 if 0 < k < len(v) else cuts[j]
                    best, choice = gain[j], Test(name, above, float(cut))
        if choice is None:
            break
        rule.append(choice)
        inside &= _covers([choice], x)
    return rule


def as_column(rules: list[list[Test]], stats: str = "stats") -> Column:
    """Number of the first rule that holds (from 1), 0 if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for t in rule:
            c = F.col(f"{stats}.{t.feature}")
            cond = cond & ((c > t.threshold) if t.above else (c <= t.threshold))
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return out.otherwise(0) if out is not None else F.lit(0)


def base_failed(stats: str = "stats") -> Column:
    c = lambda n: F.col(f"{stats}.{n}")
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", name: str = "stats",
        most_rows: int = MAX_LABELLED) -> list[list[Test]]:
    """Learns from at most ``most_rows`` labelled rows that pass the base rules."""
    known = (labels.select(F.col("doc_id").alias("_i"), F.col("quality").alias("_q")).where("_q is not null")
             .groupBy("_i").agg(F.min("_q").alias("_q"), F.max("_q").alias("_r")).where("_q = _r"))
    rows = (stats.select(F.col(doc_id).alias("_i"), name).where(~base_failed(name)).join(known, "_i")
            .select("_q", *[F.col(f"{name}.{c}").cast("double").alias(c) for c in ("n_words", *RATIOS)],
                    F.xxhash64("_i").alias("_h")))
    path = scratch_path(stats.sparkSession, "labelled")  # numbers only, read once a level of the bound
    rows.write.parquet(path)
    rows = smallest(stats.sparkSession.read.parquet(path), most_rows, "_h").orderBy("_h").limit(most_rows).toPandas()
    if not len(rows):
        return []
    x = {c: rows[c].to_numpy(np.float64) for c in ("n_words", *RATIOS)}
    return learn(x, rows["_q"].to_numpy() == 0, rows["_h"].to_numpy() % 3 == 0)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
           drop_text: bool = False, name: str = "stats") -> DataFrame:
    """``docs`` with its statistics, base_failed and rule (0: none holds).
    The statistics are written once, for learning and for applying."""
    path = scratch_path(docs.sparkSession, "quality")
    text_stats(docs, text, name, drop_text).write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    rules = fit(stats, labels, doc_id, name)
    return stats.withColumns({f"{name}_base_failed": base_failed(name), f"{name}_rule": as_column(rules, name)})
