"""Exact token ids and counts of whole texts, by way of distinct words.

The vocabulary file's own rules make white space a boundary: texts are split
there, each distinct word of a batch is encoded once by the library, and
counts or ids are put together by array lookups.

* ASCII white space never lies inside a token: the normaliser turns any run of
  white space into one space, the splitting expression drops it, no special
  token holds any, and no character composes with one.  So words between ASCII
  white space are encoded independently of each other.
* Words made only of ASCII and of Latin-1 letters are lower-cased and cut into
  letter runs, digits, contractions and symbol runs here (the file's splitting
  rule restricted to these characters, each of which is its own composed
  form); each distinct piece is encoded by the library.  Any other word, and
  any word that holds a special token's string, goes to the library whole.

Distinct pieces are remembered by a worker process, up to about ``REMEMBER``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenledger.llm import arrow_text as at

#: pieces remembered by a worker process, also between tasks (about 150 MB)
REMEMBER = 600_000
#: text bytes encoded at once
RUN_BYTES = 8 << 20
#: pieces given to the library at once; it takes a kilobyte for each
LEARN = 10_000
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: fixed values: the splitting rule of the vocabulary file, for plain words
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_LETTERS_THEN_SYMBOLS = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<b>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Ids of words, by the tokenizer file ``name``."""

    def __init__(self, name: str) -> None:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import public_tokenizers
        from tokenizers import Tokenizer
        path = public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the same model for pieces that need no normalising or splitting
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                          "use_regex": False}]}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        size = self.whole.get_vocab_size(True)
        suffix = spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(size, bool)
        for token, k in spec["model"]["vocab"].items():
            self.closes[k] = token.endswith(suffix)
        self.id_type = np.uint16 if size <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.piece: dict[str, int] = {"": 0}
        self.term = np.zeros(1, np.uint32)  # hash of each piece, 0 for none
        self.ids = np.zeros(0, self.id_type)
        self.starts = np.zeros(2, np.int64)  # piece k is ids[starts[k]:starts[k + 1]]

    def _learn(self, new: list[str]) -> None:
        ids = np.concatenate([
            np.array(self.pieces.encode(" ".join(new[k:k + LEARN]), add_special_tokens=False).ids, self.id_type)
            for k in range(0, len(new), LEARN)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("pieces and tokens do not match")
        base, first = int(self.starts[-1]), len(self.starts) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, ends + base])
        self.term = np.concatenate([self.term, at.hash_strings(new).astype(np.uint32)])
        self.piece.update(zip(new, range(first, first + len(new))))

    def _learn_whole(self, word: str) -> int:
        key = "\0" + word
        if key not in self.piece:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, self.id_type)
            self.piece[key] = len(self.starts) - 1
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.append(self.starts, self.starts[-1] + len(ids))
            self.term = np.append(self.term, at.hash_strings([word]).astype(np.uint32))
        return self.piece[key]

    def _index(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        distinct = at.strings(coded.dictionary)
        found = list(map(self.piece.get, distinct))
        new = [p for p, k in zip(distinct, found) if k is None]
        if new:
            fresh = iter(range(len(self.starts) - 1, len(self.starts) - 1 + len(new)))  # numbered in turn
            self._learn(new)
            found = [next(fresh) if k is None else k for k in found]
        found = np.array(found, np.int64)
        return found[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, hash of the first piece) of distinct words."""
        if len(self.piece) > REMEMBER:
            self.forget()
        n = len(words)
        parts = pc.extract_regex(words, _LETTERS_THEN_SYMBOLS)
        simple = pc.is_valid(parts).to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        # most words: a run of letters (or none), then a run of symbols (or none)
        first = self._index(pc.utf8_lower(pc.struct_field(parts, "a").filter(pa.array(simple))))
        second = self._index(pc.struct_field(parts, "b").filter(pa.array(simple)))
        rest = [self._cut(w) for w in at.strings(words.filter(pa.array(~simple)))]
        count = np.full(n, 2, np.int64)
        count[~simple] = [len(r) for r in rest]
        begin = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int64)
        flat[begin[simple]], flat[begin[simple] + 1] = first, second
        other = np.fromiter((p for own in rest for p in own), np.int64)
        flat[gather(begin[~simple], count[~simple], np.arange(len(flat)))] = other
        size = self.starts[flat + 1] - self.starts[flat]
        total = np.concatenate(([0], np.cumsum(size)))
        terms = self.term[flat[begin]] if n else np.zeros(0, np.uint32)
        return np.append(total[begin], total[-1]), gather(self.starts[flat], size, self.ids), terms

    def _cut(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word) or ("<" in word and any(s in word for s in self.special)):
            return [self._learn_whole(word)]
        parts = _PIECE.findall(word.lower())
        new = [p for p in dict.fromkeys(parts) if p not in self.piece]
        if new:
            self._learn(new)
        return [self.piece[p] for p in parts]


def gather(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start:start + size] of every pair, joined."""
    total = int(size.sum())
    if not total:
        return values[:0]
    # half the memory where places fit 32 bits
    at_ = np.ones(total, np.int32 if len(values) < 1 << 31 else np.int64)
    on = size > 0
    start, size = start[on], size[on]
    at_[0] = start[0]
    at_[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return values[np.cumsum(at_, dtype=at_.dtype, out=at_)]


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """The worker process's encoder for a tokenizer file."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def forget_words() -> None:
    """At the end of a task: pieces stay for the next one, up to ``REMEMBER``."""
    for e in _encoders.values():
        if len(e.piece) > REMEMBER:
            e.forget()
    at.release()


class Encoded:
    """Words of a slice of texts with the ids of each distinct word."""

    def __init__(self, texts: pa.LargeStringArray, name: str) -> None:
        self.offsets, values = at.words(texts, _ASCII_SPACE)
        coded = values.dictionary_encode()
        self.dictionary = coded.dictionary
        self.code = coded.indices.to_numpy() if len(values) else np.zeros(0, np.int32)
        self.id_starts, self.ids, self.terms = encoder(name).encode_words(coded.dictionary)
        self.size = np.diff(self.id_starts)

    def counts(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.size[self.code])))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def all_ids(self) -> np.ndarray:
        """Ids of all texts, joined."""
        return gather(self.id_starts[self.code], self.size[self.code], self.ids)


#: ASCII white space as the library's \\s has it
_ASCII_SPACE = at.byte_table(False, lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
