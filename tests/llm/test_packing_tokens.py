import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import corpus, empty, odd, odd_rows
from tokenledger.llm import arrow_text as at
from tokenledger.llm import packing, token_counts
from tokenledger.llm.tokens import Encoded

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(NAME))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    import random
    rng = random.Random(2)
    parts = ["The", "don't", "I'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "x<|startoftext|>y", "é", "H̱", "İ", "ß", "ǅ", "日本語", "ª", "µ",
             " ", "\n", "\t", "\x1c", "\x85", "12", "a1", "##", "!!", "_", "Σ", "ΑΣ", "😀", "​", "\x00", "́", "Å", "''s"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [t for _, t in corpus()] + ["", None]
    e = Encoded(at.texts_of(pa.array(texts)), NAME)
    cut = np.concatenate(([0], np.cumsum(e.counts())))
    ids = e.all_ids()
    for k, text in enumerate(texts):
        assert ids[cut[k]:cut[k + 1]].tolist() == library(text), repr(text)


def test_long_texts_are_cut_at_white_space():
    data = ("ab cde\n" * 100).encode() + b"x" * 500 + b" y"
    parts = token_counts.split_long(data, 64)
    assert b"".join(parts) == data and all(p[-1:] in (b" ", b"\n") for p in parts[:-1])


def test_counts(spark, library):
    got = token_counts.token_counts(odd(spark), tokenizer=NAME).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library(r[1])), len(library(r[1])) > 2048) for r in odd_rows()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_packed_pieces_hold_every_id_once(spark, library, shard):
    rows = corpus(3, 60) + [(1000, None), (1001, "w " * 5000), (1001, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, window=256, shard_tokens=shard).withColumn("crc", F.crc32("ids")).toPandas()
    for i, text in {i: t for i, t in rows}.items():
        ids = library(text) + [1]
        copies = sum(i == j for j, _ in rows)
        own = pieces[pieces.doc_id == i]
        covered = np.zeros(len(ids), int)
        for p in own.itertuples():
            part = ids[p.start:p.start + p.length]
            assert p.doc_tokens == len(ids) and p.length == len(part) > 0
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.crc
            covered[p.start:p.start + p.length] += 1
        assert (covered == copies).all()
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate(([0], np.cumsum(s.length)[:-1]))).all()
        total = s.length.sum()
        assert total <= 256 and total & (total - 1) == 0       # full windows or powers of two: no padding


def test_retrieval_brings_neighbours_together():
    """Of two topics dealt in turn, windows hold one topic."""
    topic = {k: np.array([k * 1000 + j for j in range(40)], np.uint32) for k in (1, 2)}
    rows = [(n, np.ones(50, np.uint16).tobytes(), topic[n % 2 + 1].tobytes(), np.ones(40, np.uint32).tobytes(), 40)
            for n in range(40)]
    shard = packing.Shard(rows, np.full(packing.BUCKETS, 20), 40, 40.0)
    for pieces in list(shard.pack(200, 2))[:-1]:
        assert len({rows[r][0] % 2 for r, _, _ in pieces}) == 1


def test_neighbours_follow_in_bm25_order():
    """Scores of every seed equal plain BM25 over all words, counted by dictionaries."""
    import math
    import random
    rng = random.Random(11)
    docs = [[rng.randrange(1, 400) for _ in range(rng.randint(1, 300))] + [7] * rng.choice([0, 0, 400]) for _ in range(60)]
    bags = [{w: d.count(w) for w in set(d)} for d in docs]
    df = np.zeros(packing.BUCKETS, np.int64)
    for b in bags:
        for w in b:
            df[w] += 1
    mean = sum(map(len, docs)) / len(docs)
    rows = [(k, b"", np.array(sorted(b), np.uint32).tobytes(), np.array([b[w] for w in sorted(b)], np.uint32).tobytes(),
             len(docs[k])) for k, b in enumerate(bags)]
    shard = packing.Shard(rows, df, len(docs), mean)
    for seed, own in enumerate(bags):
        want = np.zeros(len(docs))
        for k, b in enumerate(bags):
            for w in own.keys() & b.keys():
                if df[w] > 1:
                    idf = math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    norm = b[w] + packing.K1 * (1 - packing.B + packing.B * len(docs[k]) / mean)
                    want[k] += idf * b[w] * (packing.K1 + 1) / norm
        got = shard.scores(seed)
        assert np.allclose(got, want, rtol=1e-4)


def test_packing_odd_and_empty(spark):
    pieces = packing.pack(odd(spark), window=2048)
    by = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert by[1] == by[2] == by[3] == 1 and set(by) == {r[0] for r in odd_rows()}
    assert packing.pack(empty(spark)).count() == 0


def test_library_gets_bounded_runs_of_pieces():
    """A slice of many new words is not encoded by one call, whose memory would grow with it."""
    from tokenledger.llm import tokens
    e = tokens.WordEncoder("word_bpe_49k.json")
    texts = [f"ab{k}cd Q{'xyz'[k % 3] * (k % 7)}{'abcdefghij'[k % 10]}{k:x}" for k in range(12_000)]
    whole = [e.whole.encode(t, add_special_tokens=False).ids for t in texts]
    own, given = e.pieces, []

    class Counting:
        def encode(self, text, **options):
            given.append(len(text.split()))
            return own.encode(text, **options)

    e.pieces = Counting()
    distinct = pa.array([f"{a}{b}{c}{d}" for a in "bcdfgh" for b in "aeiouy" for c in "klmnpq" for d in
                         (f"{x}{y}" for x in "rstvwxz" for y in "aeiouybcdfghjklm")], pa.large_string())
    offsets, ids, _ = e.encode_words(distinct)
    assert len(distinct) > 2 * tokens.LEARN and max(given) <= tokens.LEARN and sum(given) >= len(distinct)
    for k in (0, 9_999, 10_000, 19_999, 20_000, len(distinct) - 1):
        assert list(ids[offsets[k]:offsets[k + 1]]) == e.whole.encode(distinct[k].as_py(), add_special_tokens=False).ids
    words = pa.array([w for t in texts for w in t.split()], pa.large_string())
    offsets, ids, _ = e.encode_words(words)
    assert [list(ids[offsets[2 * k]:offsets[2 * k + 2]]) for k in range(len(texts))] == whole
