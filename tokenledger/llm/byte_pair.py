"""Byte-pair encoding and decoding by a trie of distinct words.

Texts are cut into units before every space that follows a character other
than white space.  The file's splitting rule always ends a word there, so units
are encoded independently, each distinct one of a run of rows once.  A unit's
words (by the splitting rule) that are not yet known are put into a trie, held
as sorted words and the length of the prefix each shares with the word before:
the order of the trie's nodes, depth first.  The walk carries one state per
depth, the last token of the prefix's encoding, so shared prefixes are
encoded once:

* an automaton over all tokens gives the longest token that ends a prefix,
  and from each token the next shorter one;
* the first of them that may follow the last token of what lies before it is
  the last token of this prefix.  Two tokens may stand side by side when no merge
  crosses their border, which the edges of their merge trees tell; a sequence is
  the library's encoding exactly when all its neighbours may stand so.

Reading the states backwards from a word's end gives its tokens.

Cases: a null text is empty and has no tokens; special strings inside a text
become their ids unless ``specials`` is false; repeated rows each get their row;
a very long text or word is worked through in time linear in its bytes; extra
columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenledger.llm import arrow_text as at
from tokenledger.llm.tokens import gather

#: bytes of remembered words in a worker process; beyond them all are dropped
REMEMBER_BYTES = 64 << 20
#: text bytes worked on at once
RUN_BYTES = 8 << 20
#: remembered verdicts on neighbouring tokens
REMEMBER_PAIRS = 1_000_000
_NEVER = 1 << 60
#: fixed value: the splitting rule of byte-level files, for ASCII units
_ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: printable
    Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """The bytes of each id of a vocabulary file."""

    def __init__(self, name: str) -> None:
        import json

        import public_tokenizers
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            self.read(json.load(f))
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.token_at = np.cumsum(self.lengths) - self.lengths
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def read(self, spec: dict) -> None:
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * self.size
        for text, k in vocab.items():
            self.token[k] = bytes(map(letters.__getitem__, text))
        for content, k in self.special.items():
            self.token[k] = content.encode()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        return gather(self.token_at[ids], self.lengths[ids], self.token_bytes)


class Vocabulary(Tokens):
    """Tokens with their merge trees and the automaton over all of them."""

    def read(self, spec: dict) -> None:
        super().read(spec)
        vocab = spec["model"]["vocab"]
        self.length = [len(t) for t in self.token]
        # the rank at which two neighbours merge, by left * size + right
        self.rank: dict[int, int] = {}
        # edges: the tokens that lie at a token's border while it grows, each
        # with the rank of the merge that takes it up
        self.left_edge: list[tuple] = [((k, _NEVER),) for k in range(self.size)]
        self.right_edge: list[tuple] = list(self.left_edge)
        # encoded as itself, if nothing else is known
        self.whole = [len(t) == 1 for t in self.token]
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            if len(self.left_edge[t]) > 1:
                raise ValueError("a token with two merges")
            self.rank[a * self.size + b] = r
            self.left_edge[t] = (*self.left_edge[a][:-1], (a, r), (t, _NEVER))
            self.right_edge[t] = (*self.right_edge[b][:-1], (b, r), (t, _NEVER))
            self.whole[t] = self.whole[a] and self.whole[b] and self.apart(a, b, inside=True)
        for k in self.special.values():
            self.whole[k] = False
        self._automaton()

    def apart(self, a: int, b: int, inside: bool = False) -> bool:
        """No merge crosses the border of neighbours ``a`` and ``b``; with
        ``inside`` up to the merge of the two themselves."""
        left, right = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            if x_until == y_until == _NEVER and inside:
                return True
            r = self.rank.get(x * self.size + y)
            # equal ranks are merged from the left
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _automaton(self) -> None:
        self.kids: list[dict[int, int]] = [{}]
        own = [-1]
        node_of = {}
        for k in range(self.size):
            if not self.whole[k] or not self.length[k]:
                continue
            node = 0
            for byte in self.token[k]:
                to = self.kids[node].get(byte)
                if to is None:
                    to = self.kids[node][byte] = len(self.kids)
                    self.kids.append({})
                    own.append(-1)
                node = to
            own[node] = k
            node_of[k] = node
        if len(self.kids[0]) != 256:
            raise ValueError("a byte without a token")
        self.fall = [0] * len(self.kids)
        self.longest = own  # the longest token that ends a node's prefix
        queue = list(self.kids[0].values())
        for node in queue:
            for byte, to in self.kids[node].items():
                back = self.fall[node]
                while byte not in self.kids[back]:
                    back = self.fall[back]
                self.fall[to] = self.kids[back][byte]
                if own[to] < 0:
                    own[to] = own[self.fall[to]]
                queue.append(to)
        self.shorter = [own[self.fall[node_of[k]]] if k in node_of else -1 for k in range(self.size)]


class TrieEncoder:
    """Tokens of words, units and texts by one vocabulary file."""

    def __init__(self, name: str, specials: bool = True) -> None:
        from tokenizers import pre_tokenizers
        self.vocabulary = v = Vocabulary(name)
        self.letters = byte_letters()
        # units with other than ASCII characters: the library's own rule
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.special = {c.encode(): k for c, k in v.special.items()} if specials else {}
        self.special_at = (re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
                           if self.special else None)
        self.id_type = np.uint16 if v.size <= 1 << 16 else np.uint32
        self.fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.held = 0
        self.ids = [np.zeros(0, self.id_type)]
        self.starts = [np.zeros(1, np.int64)]

    def walk(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each of the sorted distinct words."""
        v = self.vocabulary
        kids, fall, longest, shorter, length, size = v.kids, v.fall, v.longest, v.shorter, v.length, v.size
        fits, apart = self.fits, v.apart
        if len(fits) > REMEMBER_PAIRS:
            fits.clear()
        last, node = [-1], [0]  # by depth: last token of the prefix, automaton state
        before, out = b"", []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1:], node[shared + 1:]
            state, depth = node[-1], shared
            for byte in word[shared:]:
                while byte not in kids[state]:
                    state = fall[state]
                state = kids[state][byte]
                depth += 1
                token = longest[state]
                while True:
                    rest = depth - length[token]
                    if not rest:
                        break
                    key = last[rest] * size + token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = apart(last[rest], token)
                    if fit:
                        break
                    token = shorter[token]
                last.append(token)
                node.append(state)
            before, tokens = word, []
            while depth:
                tokens.append(last[depth])
                depth -= length[last[depth]]
            tokens.reverse()
            out.append(tokens)
        return out

    def words_of(self, unit: bytes) -> list:
        """Words of a unit (bytes) by the splitting rule; special strings are
        given as text."""
        if self.special_at is not None and b"<" in unit and len(parts := self.special_at.split(unit)) > 1:
            return [w for k, p in enumerate(parts) for w in ([p.decode()] if k % 2 else self._plain(p))]
        return self._plain(unit)

    def _plain(self, unit: bytes) -> list[bytes]:
        if unit.isascii():
            return _ASCII_WORD.findall(unit)
        letters = self.letters
        return [bytes([letters[c] for c in w]) for w, _ in self.split(unit.decode())]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the units."""
        if self.held > REMEMBER_BYTES:
            self.forget()
        number = self.number
        words = list(map(self.words_of, units))
        new = [w for w in set(chain.from_iterable(words)) if w not in number]
        if new:
            special = [w for w in new if isinstance(w, str)]
            plain = sorted(w for w in new if isinstance(w, bytes))
            found = self.walk(plain) + [[self.special[w.encode()]] for w in special]
            base, first = int(self.starts[-1][-1]), sum(len(s) for s in self.starts) - 1
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.starts.append(base + np.cumsum(size))
            self.ids.append(np.fromiter(chain.from_iterable(found), self.id_type, int(size.sum())))
            number.update(zip(chain(plain, special), range(first, first + len(new))))
            self.held += sum(map(len, new)) + 150 * len(new)
            self.starts, self.ids = [np.concatenate(self.starts)], [np.concatenate(self.ids)]
        starts, ids = self.starts[0], self.ids[0]
        count = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        size = starts[flat + 1] - starts[flat] if len(flat) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        return total[np.concatenate(([0], np.cumsum(count)))], gather(starts[flat], size, ids)


_encoders: dict[tuple, TrieEncoder] = {}


def encoder(name: str, specials: bool = True) -> TrieEncoder:
    """The worker process's encoder; its remembered words outlive a task and
    are bounded by ``REMEMBER_BYTES``."""
    if (name, specials) not in _encoders:
        _encoders[name, specials] = TrieEncoder(name, specials)
    return _encoders[name, specials]


_tokens: dict[str, Tokens] = {}


def decoder(name: str) -> Tokens:
    """The worker process's table of token bytes."""
    if name not in _tokens:
        _tokens[name] = Tokens(name)
    return _tokens[name]


def _after_blank(body: np.ndarray, at_: np.ndarray) -> np.ndarray:
    """Whether the character before each (positive) position is white space,
    control characters counted as such."""
    last = body[at_ - 1]
    blank = last <= 0x20
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        c = last[wide]
        b = body[np.maximum(at_[wide] - 2, 0)]
        a = body[np.maximum(at_[wide] - 3, 0)]
        blank[wide] = (
            ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)))
            | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    return blank


class Units:
    """Units of the rows of one run: ``code`` of every unit, distinct
    ``units``, and ``offsets`` by row."""

    def __init__(self, off: np.ndarray, body: np.ndarray) -> None:
        spaces = np.flatnonzero(body == 0x20)
        spaces = spaces[spaces > 0]
        cut = spaces[~_after_blank(body, spaces)] if len(spaces) else spaces
        first = np.zeros(len(body), bool)
        first[off[:-1][np.diff(off) > 0]] = first[cut] = True
        begin = np.flatnonzero(first)
        self.offsets = np.searchsorted(begin, off)
        ends = np.append(begin, len(body)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [
            None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        self.units = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy() if len(begin) else np.zeros(0, np.int32)


def byte_rows(values: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Rows of a byte array, by offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           tokenizer: str = "byte_bpe_50k.json", specials: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every text."""
    def run(batches):
        e = encoder(tokenizer, specials)
        for batch in at.slices(batches, text, RUN_BYTES):
            u = Units(*at.raw(at.texts_of(batch.column(text))))
            unit_at, unit_ids = e.encode_units(u.units)
            size = np.diff(unit_at)[u.code]
            total = np.concatenate(([0], np.cumsum(size)))[u.offsets]
            ids = gather(unit_at[u.code], size, unit_ids).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pa.array(np.diff(total), pa.int64()),
                 byte_rows(ids.view(np.uint8), 4 * total).cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The rows of ``encode`` with ``text``, the text of their ids.  Bytes that
    are no UTF-8 become U+FFFD as in the library; null ids give null."""
    def run(batches):
        e = decoder(tokenizer)
        for batch in at.slices(batches, "ids"):
            column = batch.column(batch.schema.get_field_index("ids"))
            off, body = at.raw(column.fill_null(b"").cast(pa.large_binary()))
            ids = body.view("<u4") if len(body) else np.zeros(0, "<u4")
            size = np.concatenate(([0], np.cumsum(e.lengths[ids])))
            rows = byte_rows(e.decode(ids), size[off // 4])
            try:
                texts = rows.cast(pa.large_string())
            except pa.ArrowInvalid:
                texts = pa.array([r.decode("utf-8", "replace") for r in rows.to_pylist()], pa.large_string())
            if column.null_count:
                import pyarrow.compute as pc
                texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.large_string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")
