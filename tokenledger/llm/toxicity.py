"""Toxicity: a subsequence-string-kernel support vector machine.

Examples are windows of ``WIDTH`` consecutive words of a sentence (a shorter
sentence is one window).  Kernel of two windows: gap-weighted subsequences of
four characters of their words, each word with a mark for its begin and end,
spanning at most ``SPAN`` characters, weighted DECAY ** gaps and scaled by word
length; plus gap-weighted subsequences of one and two words, so that an insult is told from words that
resemble it, and one made of ordinary words is seen across their boundaries.  It sees an insult through
inserted characters ("i.d.i.o.t"), gaps and changed endings.  Words are
white-space separated, lower-cased and trimmed of symbols at both ends; behind
a run of three or more single-character words stands the joined word.

Training (all of it from at most ``MAX_LABELLED`` labelled texts, those with
the smallest id hashes) knows labels of texts only, so it is multi-instance:

1. Distinct sentences of toxic and of other texts are counted for every word
   and pair of neighbours; each toxic text gives the window around its most
   telling one (log-likelihood ratio) as a positive example, each other text
   one window by hash as a negative example.
2. Nystroem: landmarks (the telling words and pairs, background windows, later
   the hardest ones) span the feature space, K(x, landmarks)
   K(landmarks, landmarks)^-1/2; a linear support vector machine is trained there.
3. ``ROUNDS`` times more with the windows that the machine finds strongest in
   each toxic text as positive and in each other text as further negative examples.
4. A logistic curve over the margins of a text's two strongest windows without
   common words, fitted on the labelled texts, gives the score.

The kernel has explicit features (hashed character subsequences, exact word
pairs), so the machine's sum over landmarks is one weight vector of fixed size,
and scoring is a sparse dot product with it: the same number as through the landmarks.

Cases: null, empty and wordless texts score as the curve does without any
evidence; without usable labels of both kinds every score is 0; repeated rows
each get their row; extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.quality_classifier import logistic, sample
from tokenledger.session import scratch_path

DIM = 1 << 18
SPAN, DECAY, WIDTH = 7, 0.6, 3
MAX_LABELLED = 8_000
#: Landmarks: telling words and pairs, background windows, hardest windows of a round.
TELLING, BACKGROUND, HARDEST, ROUNDS = 128, 32, 32, 2
NONE = -4.0  # margin of a text without any word
_STEPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_ONE_SPACE = pa.scalar(" ", pa.large_string())
_BLANK = at.byte_table(False, lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


class Machine(NamedTuple):
    """Weights of hashed character subsequences, of words of ``vocabulary``,
    and of word pairs by key."""
    weights: np.ndarray
    alone: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    vocabulary: pa.Array
    intercept: float


class Units(NamedTuple):
    """Words of texts: row k has codes[offsets[k]:offsets[k + 1]]; ``joined``
    tells that the next word is in the same sentence."""
    offsets: np.ndarray
    codes: np.ndarray
    words: pa.Array
    joined: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        """Whether a window starts: a full one, or that of a short sentence."""
        return self.ahead(2) | ~np.concatenate(([False], self.joined))[:-1]

    def ahead(self, far: int) -> np.ndarray:
        """Whether the word ``far`` places on is in the same sentence."""
        out = np.zeros(len(self.joined), bool)
        if len(out) >= far:
            out[:len(out) - far + 1] = np.lib.stride_tricks.sliding_window_view(self.joined, far).all(axis=1)
        return out


def units(texts: pa.LargeStringArray) -> Units:
    offsets, values = at.words(texts, _BLANK)
    coded = values.dictionary_encode()
    if not len(values):
        return Units(offsets, np.zeros(0, np.int64), coded.dictionary, np.zeros(0, bool))
    clean = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    closes = pc.match_substring_regex(coded.dictionary, "[.!?][\"')\\]]*$").to_numpy(zero_copy_only=False)
    clean = clean.dictionary_encode()
    raw = coded.indices.to_numpy()
    code, words, last = clean.indices.to_numpy().astype(np.int64)[raw], clean.dictionary, closes[raw]
    single = (pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1)[code]
    row = at.row_of(offsets)
    run = single[1:] & single[:-1] & (row[1:] == row[:-1])
    begin = np.concatenate((run, [False])) & ~np.concatenate(([False], run))
    if begin.any():  # rare: the joined word behind its run
        texts_of_words = words.to_pylist()
        behind, extra = [], []
        for s in np.flatnonzero(begin):
            e = s + 1
            while e < len(code) and run[e - 1]:
                e += 1
            if e - s >= 3:
                behind.append(e - 1)
                extra.append("".join(texts_of_words[c] for c in code[s:e]))
        if extra:
            known = {w: k for k, w in enumerate(texts_of_words)}
            for w in extra:
                known.setdefault(w, len(known))
            words = pa.array(list(known), pa.large_string())
            order = np.argsort(np.concatenate([np.arange(len(code)), np.array(behind) + 0.5]), kind="stable")
            row = np.concatenate([row, row[behind]])[order]
            moved = last[behind]
            last[behind] = False
            last = np.concatenate([last, moved])[order]
            code = np.concatenate([code, [known[w] for w in extra]])[order]
            offsets = np.searchsorted(row, np.arange(len(texts) + 1))
    return Units(offsets, code, words, np.append(row[1:] == row[:-1], False) & ~last)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of words with their marks."""
    text = "".join([f"\x02{w}\x03" for w in words.to_pylist()])
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return np.concatenate(([0], np.cumsum(size))), np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def subsequences(words: pa.Array):
    """Yields (word, hashed subsequence, weight) arrays over all spans."""
    off, c = _points(words)
    word = at.row_of(off)
    left = off[1:][word] - np.arange(len(c))
    with np.errstate(over="ignore"):
        one, two, three, four = (c * np.uint64(k) for k in (
            0x9E3779B1, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))
        for i, j, k in _STEPS:
            at_ = np.flatnonzero(left > k)
            h = one[at_] + two[at_ + i] + three[at_ + j] + four[at_ + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield word[at_], (h >> np.uint64(46)).astype(np.int64), DECAY ** (k - 3)


def scale(words: pa.Array) -> np.ndarray:
    """Length scale of each word's kernel; 0 under two characters."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64) + 2
    total = sum(np.maximum(size - k, 0) * DECAY ** (2 * (k - 3)) for _, _, k in _STEPS)
    return np.divide(1, np.sqrt(total), out=np.zeros(len(size)), where=total > 0)


def evidence(words: pa.Array, weights: np.ndarray) -> np.ndarray:
    """What the characters of each word add to a margin."""
    dot = np.zeros(len(words))
    for word, index, weight in subsequences(words):
        dot += weight * np.bincount(word, weights[index], len(words))
    return dot * scale(words)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return at.mix(a * np.uint64(3) + at.mix(b))


def window_margins(u: Units, machine: Machine) -> np.ndarray:
    """The machine's margin of the window that starts at each word; -inf where none does."""
    n = len(u.codes)
    e = evidence(u.words, machine.weights)[u.codes]
    number = pc.fill_null(pc.index_in(u.words, value_set=machine.vocabulary), -1).to_numpy()
    known = number >= 0
    if known.any():
        e += np.where(known, machine.alone[number], 0)[u.codes]
    hashes = np.zeros(len(u.words), np.uint64)
    hashes[known] = at.hash_strings(u.words.filter(pa.array(known)))
    f = machine.intercept + e
    near = np.zeros(n + 1)
    for far in range(1, WIDTH):
        inside = u.ahead(far)[:n - far]
        pair = np.zeros(n)
        here = np.flatnonzero(inside & known[u.codes[:n - far]] & known[u.codes[far:]])
        if len(machine.keys) and len(here):
            key = pair_keys(hashes[u.codes[here]], hashes[u.codes[here + far]])
            place = np.minimum(np.searchsorted(machine.keys, key), len(machine.keys) - 1)
            pair[here] = np.where(machine.keys[place] == key, machine.values[place], 0) * DECAY ** (far - 1)
        f[:n - far] += np.where(inside, e[far:] + pair[:n - far], 0)
        if far == 1:
            near[:n] = pair
        else:  # the pair of the window's second and third word
            f[:n - far] += np.where(inside, near[1:n - far + 1], 0)
    f[~u.starts] = -np.inf
    return f


def _best(f: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the first greatest f of each row that has words."""
    full = np.diff(offsets) > 0
    best = np.maximum.reduceat(f, offsets[:-1][full])
    at_ = np.flatnonzero(f == np.repeat(best, np.diff(offsets)[full]))
    row = np.searchsorted(offsets, at_, "right")
    return at_[np.concatenate(([True], row[1:] != row[:-1]))], best


def two_strongest(u: Units, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2) margins and places of the strongest window and the strongest
    one that shares no word with it; NONE and -1 without one."""
    rows = len(u.offsets) - 1
    out, places = np.full((rows, 2), NONE), np.full((rows, 2), -1)
    full, f = np.diff(u.offsets) > 0, f.copy()
    if full.any():
        for k in range(2):
            place, best = _best(f, u.offsets)
            out[full, k] = np.maximum(best, NONE)
            places[full, k] = np.where(np.isfinite(best), place, -1)
            for near in range(1 - WIDTH, WIDTH):
                at_ = place + near
                f[at_[(at_ >= u.offsets[:-1][full]) & (at_ < u.offsets[1:][full])]] = -np.inf
    return out, places


def strongest(texts: pa.LargeStringArray, machine: Machine) -> np.ndarray:
    u = units(texts)
    return two_strongest(u, window_margins(u, machine) if len(u.codes) else np.zeros(0))[0]


def window_texts(u: Units, places: np.ndarray) -> pa.Array:
    """The windows that start at ``places``, words joined by one space."""
    parts = [u.words.take(pa.array(u.codes[places]))]
    for far in range(1, WIDTH):
        inside = u.ahead(far)[places]
        parts.append(pc.if_else(pa.array(inside), u.words.take(
            pa.array(u.codes[np.minimum(places + far, len(u.codes) - 1)])), pa.scalar(None, pa.large_string())))
    return pc.binary_join_element_wise(*parts, _ONE_SPACE, null_handling="skip")


def _terms(window: list[str]):
    """((word,) or (word, later word), weight) of a window."""
    for k, a in enumerate(window):
        yield (a,), 1.0
        for far, b in enumerate(window[k + 1:]):
            yield (a, b), DECAY ** far


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed subsequence, value) of distinct words."""
    array = pa.array(words, pa.large_string())
    word, index, value = zip(*[(w, i, np.full(len(w), x)) for w, i, x in subsequences(array)])
    word = np.concatenate(word)
    return word, np.concatenate(index), np.concatenate(value) * scale(array)[word]


def _landmark_features(landmarks: list[str]) -> tuple[list[np.ndarray], list[dict]]:
    """Character weights (places, values) and words and pairs of each landmark."""
    words = sorted({w for m in landmarks for w in m.split(" ")})
    word, index, value = _word_features(words)
    order = np.argsort(word, kind="stable")
    cut = np.searchsorted(word[order], np.arange(len(words) + 1))
    index, value, number = index[order], value[order], {w: k for k, w in enumerate(words)}
    chars, terms = [], []
    for m in landmarks:
        at_ = np.concatenate([np.arange(cut[k], cut[k + 1]) for k in (number[w] for w in m.split(" "))])
        chars.append((index[at_], value[at_]))
        found: dict = {}
        for term, weight in _terms(m.split(" ")):
            found[term] = found.get(term, 0.0) + weight
        terms.append(found)
    return chars, terms


def _kernel(windows: list[str], landmarks: list[str]) -> np.ndarray:
    """(windows, landmarks) kernel values."""
    chars, terms = _landmark_features(landmarks)
    split = [w.split(" ") for w in windows]
    words = sorted({w for s in split for w in s})
    number = {w: k for k, w in enumerate(words)}
    by_word = np.zeros((len(words) + 1, len(landmarks)))
    full = np.zeros(DIM)
    for s in range(0, len(words), 4_096):
        word, index, value = _word_features(words[s:s + 4_096])
        size = len(words[s:s + 4_096])
        for k, (i, v) in enumerate(chars):
            np.add.at(full, i, v)
            by_word[s:s + size, k] = np.bincount(word, value * full[index], size)
            full[i] = 0
    out = np.zeros((len(windows), len(landmarks)))
    for far in range(max(map(len, split), default=0)):
        out += by_word[[number[s[far]] if far < len(s) else -1 for s in split]]
    holders: dict = {}
    for k, found in enumerate(terms):
        for term, weight in found.items():
            holders.setdefault(term, []).append((k, weight))
    for n, s in enumerate(split):
        for term, weight in _terms(s):
            for k, other in holders.get(term, ()):
                out[n, k] += weight * other
    return out


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights with the least |w|^2 / 2 + sum of cost * max(0, 1 - y x.w)^2, by Newton steps."""
    w = np.zeros(x.shape[1])

    def loss(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2

    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xa, ca = x[inside], cost[inside]
        step = np.linalg.solve(np.eye(len(w)) + 2 * (xa * ca[:, None]).T @ xa, 2 * xa.T @ (ca * y[inside])) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w, before, now = w + size * step, now, loss(w + size * step)
        if before - now <= 1e-10 * before:
            break
    return w


def machine(positive: list[str], negative: list[str], landmarks: list[str], strength: float = 0.2) -> Machine:
    """The machine trained on windows, through landmarks."""
    base = _kernel(landmarks, landmarks)
    value, vector = np.linalg.eigh((base + base.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = _kernel(positive + negative, landmarks) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = strength * np.where(y > 0, len(y) / (2 * len(positive)), len(y) / (2 * len(negative)))
    w = solve(x, y, cost)
    weights, terms = np.zeros(DIM), {}
    for a, (i, v), found in zip(root @ w[:-1], *_landmark_features(landmarks)):
        np.add.at(weights, i, a * v)
        for term, weight in found.items():
            terms[term] = terms.get(term, 0.0) + a * weight
    words, pairs = sorted(t for t in terms if len(t) == 1), [t for t in terms if len(t) == 2]
    keys = pair_keys(at.hash_strings([a for a, _ in pairs]), at.hash_strings([b for _, b in pairs]))
    order = np.argsort(keys)
    return Machine(weights.astype(np.float32), np.array([terms[t] for t in words]), keys[order],
                   np.array([terms[t] for t in pairs])[order], pa.array([t for t, in words], pa.large_string()), float(w[-1]))


def _elements(u: Units) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of words and of pairs of neighbours."""
    h = at.hash_strings(u.words)[u.codes]
    two = np.flatnonzero(u.joined)
    return [(np.arange(len(h)), h), (two, pair_keys(h[two], h[two + 1]))]


def _sentences(u: Units) -> np.ndarray:
    """A hash of the sentence of each word; copies of a sentence share it."""
    first = np.flatnonzero(~np.concatenate(([False], u.joined))[:-1])
    number = np.cumsum(np.concatenate(([True], ~u.joined[:-1]))) - 1
    with np.errstate(over="ignore"):
        h = at.mix(at.hash_strings(u.words)[u.codes] + (np.arange(len(u.codes)) - first[number]).astype(np.uint64))
        return np.add.reduceat(h, first)[number]


def element_counts(rows: DataFrame) -> DataFrame:
    """(h, toxic, other): distinct sentences of toxic and of other texts with
    each word or pair of neighbours; h 0 counts all.  ``rows`` has t and y."""
    def run(batches):
        for batch in at.slices(batches, "t"):
            u = units(at.texts_of(batch.column("t")))
            if len(u.codes):
                label = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int32)[at.row_of(u.offsets)]
                sentence = _sentences(u)
                first = np.flatnonzero(~np.concatenate(([False], u.joined))[:-1])
                for place, h in [(first, np.zeros(len(first), np.uint64)), *_elements(u)]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(sentence[place].view(np.int64)), pa.array(label[place])],
                        ["h", "s", "y"])

    return (rows.mapInArrow(run, "h long, s long, y int").distinct()
            .groupBy("h").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")))


def significance(a, b, total_a: int, total_b: int):
    """Log-likelihood ratio of an element's share in toxic sentences, as columns."""
    n = a + b
    rate = total_a / max(total_a + total_b, 1)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return F.when(a > n * rate, 2 * (part(a, n * rate) + part(b, n * (1 - rate)))).otherwise(0.0)


def telling(rows: DataFrame, counts: DataFrame, total_a: int, total_b: int) -> DataFrame:
    """(w, u, g) of each toxic text: the window with its most telling word or
    pair u, and that one's significance g.  ``rows`` has id, t and y."""
    def run(batches):
        for batch in at.slices(batches, "t"):
            u = units(at.texts_of(batch.column("t")))
            if not len(u.codes):
                continue
            owner = batch.column("id").take(pa.array(at.row_of(u.offsets)))
            # the window that holds the element: not past the last full one of its sentence
            begin = np.arange(len(u.codes))
            for _ in range(WIDTH - 1):
                begin = np.where(u.starts[begin], begin, begin - 1)
            for size, (place, h) in enumerate(_elements(u), 1):
                start = begin[place]
                name = u.words.take(pa.array(u.codes[place]))
                if size == 2:
                    name = pc.binary_join_element_wise(name, u.words.take(pa.array(u.codes[place + 1])), _ONE_SPACE)
                yield pa.RecordBatch.from_arrays(
                    [owner.take(pa.array(place)), pa.array(h.view(np.int64)), name.cast(pa.string()),
                     window_texts(u, start).cast(pa.string())], ["id", "h", "u", "w"])

    g = significance(F.col("toxic"), F.col("other"), total_a, total_b)
    known = counts.where("toxic > 0 and h <> 0").select("h", g.alias("g"))
    found = rows.where("y = 1").select("id", "t").mapInArrow(run, "id long, h long, u string, w string").join(known, "h")
    return (found.groupBy("id").agg(F.max(F.struct("g", "u", "w")).alias("m")).select("m.w", "m.u", "m.g"))


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_LABELLED):
    """(machine, slopes, shift); None without both kinds of labels and words."""
    spark = docs.sparkSession
    path, counts_path = scratch_path(spark, "toxicity"), scratch_path(spark, "elements")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(
        F.broadcast(sample(labelled, most)), "doc_id").select(F.xxhash64("doc_id", "t").alias("id"), "t", "y")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    element_counts(rows).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    total = counts.where("h = 0").first()
    if not total or not total.toxic or not total.other:
        return None
    first = sorted(telling(rows, counts, total.toxic, total.other).collect(), key=lambda r: (-r.g, r.u, r.w))
    positive = sorted({r.w for r in first})
    negative = sorted({r.w for r in _windows(rows.where("y = 0"), None).collect()})
    landmarks = list(dict.fromkeys(r.u for r in first))[:TELLING]
    landmarks = list(dict.fromkeys(landmarks + negative[::max(1, len(negative) // BACKGROUND)][:BACKGROUND]))
    found = machine(positive, negative, landmarks)
    for _ in range(ROUNDS):
        hard = _windows(rows, found).collect()
        positive = sorted({r.w for r in hard if r.y == 1})
        against = sorted(((-r.f, r.w) for r in hard if r.y == 0))
        negative = sorted({*negative, *(w for _, w in against)})
        landmarks = list(dict.fromkeys(landmarks + [w for _, w in against[:HARDEST]]))
        found = machine(positive, negative, landmarks)
    margins = _margins(rows, found).collect()
    return found, *curve(np.array([(r.m, r.m2) for r in margins]), np.array([r.y for r in margins], float))


def _windows(rows: DataFrame, found: Machine | None) -> DataFrame:
    """(y, w, f): the strongest window of each text, and of toxic texts the
    second one too if the machine accepts it; without a machine the window with the least hash."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        found = shared.value
        for batch in at.slices(batches, "t"):
            u = units(at.texts_of(batch.column("t")))
            if not len(u.codes):
                continue
            if found is None:
                f = (at.mix(_sentences(u) + np.arange(len(u.codes)).astype(np.uint64)) >> np.uint64(11)).astype(np.float64)
                f[~u.starts] = -np.inf
            else:
                f = window_margins(u, found)
            margin, place = two_strongest(u, f)
            label = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
            take = place >= 0
            take[:, 1] &= (label == 1) & (margin[:, 1] > 0) & (found is not None)
            row, which = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[row]), window_texts(u, place[row, which]).cast(pa.string()),
                 pa.array(margin[row, which])], ["y", "w", "f"])

    return rows.select("t", "y").mapInArrow(run, "y int, w string, f double")


def _margins(rows: DataFrame, found: Machine) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in at.slices(batches, "t"):
            m = strongest(at.texts_of(batch.column("t")), shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[:, 0]), pa.array(m[:, 1]), batch.column("y").cast(pa.int32())], ["m", "m2", "y"])

    return rows.select("t", "y").mapInArrow(run, "m double, m2 double, y int")


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the logistic curve over both margins that fits the
    labels best, with the usual smoothed targets."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 1.0, 0.0])
    for _ in range(200):
        p = logistic(x @ w)
        s = p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (p - target))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:2], float(w[2])


def scored(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in at.slices(batches, text):
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                found, slopes, shift = model
                score = logistic(strongest(at.texts_of(batch.column(text)), found) @ slopes + shift)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")
