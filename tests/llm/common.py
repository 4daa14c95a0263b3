"""Odd rows and brute-force helpers of the corpus tests."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "ka lo mi ten sur va pel dor ni esh un tra gol bi fen ous ar qui zet om".split()

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, stats int, kept int, "
          "_words int, ids string, spans string, score int")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns."""
    rng = random.Random(4)
    plain = " ".join(words(rng, 80))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, plain), (5, plain), (5, plain), (6, "x"), (None, plain),
             (7, " ".join(words(rng, 60_000))), (8, "a" * 300_000), (9, "É ß İ 日本 ́ \x00 <|endoftext|> 😀"), (10, None)]
    return [(i, t, None, None, None, 1, 2, 3, 4, "i", "s", 5) for i, t in texts]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed: int = 1, n: int = 120) -> list[tuple[int, str]]:
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            text = rng.choice(out)[1]
        elif kind < 0.45 and out:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            text = " ".join(w)
        elif kind < 0.6:
            text = " ".join(words(rng, 20)) + ". " + passage + " " + " ".join(words(rng, rng.randint(5, 60)))
        else:
            text = " ".join(words(rng, rng.randint(1, 150))).capitalize() + "."
        out.append((i, text))
    return out


def shingles(text, k: int) -> frozenset:
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[s:s + k]) for s in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def groups(rows: list[tuple[int, str]], k: int, percent: int) -> dict[int, int]:
    """Smallest reachable id of each id, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return {i: root(i) for i in sets}
