"""op11 to op13 against the libraries and the contract written out plainly."""

import hashlib
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import corpus, empty, odd, odd_rows
from tokenledger.llm import arrow_text as at
from tokenledger.llm import byte_pair, cross_align, fill_middle, queries

PARTS = ["The", "don't", "I'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y", "é", "H̱", "İ", "ß", "ǅ", "日本語", "ª",
         " ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", " ", "12", "a1", "##", "!!", "_", "Σ", "😀", "​",
         "\x00", "́", "''s", "aaaa", "    ", "the", "ing", "<", "|", "<unk>", "<s>", "\r\n", "<0x0A>", " "]


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


# --- op13 -------------------------------------------------------------------

def test_trie_ids_equal_the_library(library):
    texts = mixed(3, 1500) + [t for _, t in corpus()] + ["", "a" * 30_000, " " * 5000, "ab" * 3000]
    rng = random.Random(8)
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0x3000, 0xD7FF)]))
                      for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    e = byte_pair.encoder("byte_bpe_50k.json")
    u = byte_pair.Units(*at.raw(at.texts_of(pa.array(texts))))
    starts, ids = e.encode_units(u.units)
    for k, text in enumerate(texts):
        own = [i for c in u.code[u.offsets[k]:u.offsets[k + 1]] for i in ids[starts[c]:starts[c + 1]].tolist()]
        assert own == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_walked_alike_in_any_company():
    """Shared prefixes give the same tokens as each word walked alone."""
    e = byte_pair.TrieEncoder("byte_bpe_50k.json")
    rng = random.Random(5)
    words = sorted({bytes(rng.choices(b"abeinrst ", k=rng.randint(1, 9))) for _ in range(3000)})
    assert e.walk(words) == [e.walk([w])[0] for w in words]


def test_encode_and_decode(spark, library):
    rows = [(k, t, "mine", "mine") for k, t in enumerate(mixed(9, 300))] + [(900, None, "", ""), (900, None, "", "")]
    for docs, given in ((as_frame(spark, rows), rows), (odd(spark), odd_rows())):
        got = byte_pair.decode(byte_pair.encode(docs)).collect()
        want = []
        for r in given:
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            want.append((r[0], len(ids), bytes(np.array(ids, "<u4")), library.decode(ids, skip_special_tokens=False)))
        assert by_row((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got) == by_row(want)
    assert byte_pair.decode(byte_pair.encode(empty(spark))).count() == 0


def test_ids_that_are_no_text_decode_as_in_the_library(spark, library):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(50_257) for _ in range(rng.randint(0, 5))]) for k in range(300)]
    ids = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in rows] + [(1000, None)],
                                "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in byte_pair.decode(ids).collect()}
    assert got == {k: library.decode(x, skip_special_tokens=False) for k, x in rows} | {1000: None}


def test_forgotten_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_pair, "REMEMBER_BYTES", 1)
    monkeypatch.setattr(byte_pair, "REMEMBER_PAIRS", 1)
    e = byte_pair.TrieEncoder("byte_bpe_50k.json")
    for text in mixed(4, 60):
        u = byte_pair.Units(*at.raw(at.texts_of(pa.array([text]))))
        starts, ids = e.encode_units(u.units)
        assert [i for c in u.code for i in ids[starts[c]:starts[c + 1]].tolist()] == library.encode(text).ids


# --- op12 -------------------------------------------------------------------

def cut_plainly(doc_id, text, plain_percent=0, spm_percent=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, n, "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm_percent else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < spm_percent else "psm", len(p), len(m), out, text


@pytest.mark.parametrize("plain, spm", [(0, 50), (30, 100), (0, 0)])
def test_fill_in_middle(spark, plain, spm):
    rng = random.Random(7)
    parts = ["a", "é", "\n", "\n", "\r", "<S", ">", "<P>", "x <M> ", "😀", "日本\n", "\x85", " ", "<M"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "f", "o") for k in range(400)]
    rows += [(None, "a\nb\n", "f", "o"), (7, None, None, None), (8, "\n", "", ""), (8, "\n", "", ""), (9, "x" * 500_000 + "\n", "", "")]
    for docs, given in ((as_frame(spark, rows), rows), (odd(spark), odd_rows())):
        made = fill_middle.restore(fill_middle.transform(docs, plain_percent=plain, spm_percent=spm)).collect()
        assert by_row(made) == by_row(cut_plainly(r[0], r[1], plain, spm) for r in given)
    assert fill_middle.restore(fill_middle.transform(empty(spark))).count() == 0


# --- op11 -------------------------------------------------------------------

def align_plainly(rows, a_model, b_model):
    """The contract, text by text, all pairs of tokens tried."""
    from tokenledger.llm.byte_pair import byte_letters
    letters = byte_letters()
    found, times = [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False)
        a_ids, a_bytes = a.ids, [bytes(letters[c] for c in t) for t in a.tokens]
        b_ids = b_model.encode(text or "")
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode()
                   for k, p in zip(b_ids, map(b_model.id_to_piece, b_ids))]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append((doc_id, [], [], [], []))
            continue
        a_end, b_end = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        groups, i, j = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(e) + 1, b_end.index(e) + 1
            groups.append(",".join(map(str, a_ids[i:p])) + "|" + ",".join(map(str, b_ids[j:q])))
            i, j = p, q
        links = [(x, y) for x, s, e in zip(a_ids, [0, *a_end], a_end) for y, u, v in zip(b_ids, [0, *b_end], b_end)
                 if s < v and u < e]
        times.update(links)
        found.append((doc_id, a_ids, b_ids, groups, links))
    most = Counter()
    for (_, y), n in times.items():
        most[y] = max(most[y], n)
    return [(d, len(a), len(b), len(g), len(ln), sum(times[x] == most[x[1]] for x in ln), sum(times[x] for x in ln), ";".join(g))
            for d, a, b, g, ln in found]


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_alignment_equals_all_pairs(spark, plain_library, block):
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(k, t) for k, t in enumerate(mixed(12, 150) + [t for _, t in corpus(5, 40)])]
    rows += [(500, None), (501, ""), (502, "▁a b"), (503, "   "), (504, " x"), (504, " x"), (None, "y z"), (505, "  q")]
    docs = as_frame(spark, [(*r, "f", "o") for r in rows])
    got = cross_align.align(docs, block_bytes=block).collect()
    assert by_row(got) == by_row(align_plainly(rows, plain_library, model))
    digests = cross_align.align(docs, block_bytes=block, digest=True).collect()
    assert sorted(r.groups for r in digests) == sorted(sha(r.groups) if r.n_a else "" for r in got)


def test_alignment_of_odd_and_empty(spark):
    got = cross_align.align(odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].n_a == by[2].n_b == by[10].n_links == 0 and by[1].groups == "" and by[8].n_links >= by[8].n_a
    assert cross_align.align(empty(spark)).count() == 0


def test_links_of_slices():
    """Against all pairs, over random ends."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.append(np.flatnonzero(rng.random(30) < 0.4) + 1, 31) for _ in range(2))
        common, p, q = cross_align.slices(a, b)
        assert common.tolist() == sorted(set(a) & set(b)) and (a[p - 1] == common).all() and (b[q - 1] == common).all()
        _, x, y = cross_align.links(a, b)
        starts = [np.concatenate(([0], e[:-1])) for e in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert sorted(zip(x.tolist(), y.tolist())) == want


# --- the registered queries -------------------------------------------------

def test_queries_return_digests(spark, tmp_path, library):
    rows = [(k, t) for k, t in enumerate(mixed(15, 60))] + [(70, None)]
    (spark.createDataFrame([(k, t, "en", "web", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
     .write.parquet(str(tmp_path / "documents.parquet")))
    cut = {r.doc_id: r for r in queries.op12_fill_middle(spark, str(tmp_path)).collect()}
    bpe = {r.doc_id: r for r in queries.op13_bpe(spark, str(tmp_path)).collect()}
    aligned = {r.doc_id: r for r in queries.op11_cross_align(spark, str(tmp_path)).collect()}
    for k, t in rows:
        want = cut_plainly(k, t)
        assert tuple(cut[k]) == (*want[:5], sha(want[5]), sha(want[6]))
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(bpe[k]) == (k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
        assert len(aligned[k].groups_sha256) in (0, 64)
    assert queries.op13_bpe(spark, str(tmp_path)).where(F.col("n_tokens") == 0).count() >= 1
