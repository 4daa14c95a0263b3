"""Alignment of the tokens of two tokenizers over the bytes of each text.

A is a byte-level file of the tokenizers library, encoding space + text, B a
sentencepiece model that adds the space itself.

1. Texts are cut into units that both tokenizers encode independently (before
   a space behind other than white space; no piece of B crosses such a place).
   The distinct units of a block of rows are laid end to end: the cumulative byte
   ends of A's and of B's tokens become dictionaries from end to index; the sorted
   keys that both hold slice the two id lists into groups, and each slice is
   expanded into links, the pairs of tokens whose byte ranges overlap.  A unit's
   end is a common end, so a text's groups are those of its units in order.
2. A block writes its rows (counts, groups, unit numbers) and its distinct
   id pairs with their counts.  Pair counts are summed over the corpus, the
   highest of each B id is found, and both return to the blocks by a join on
   the pair: a hot pair has one row per block.
3. Each block, a bounded group, adds up its rows' links.

Cases: texts that are null or empty, or whose joined B bytes differ from space +
text (the sign U+2581 in a text, say), have no tokens: zeros and empty groups,
and add to no count; special strings are plain text; repeated rows each count;
a text longer than a block is a block of its own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.byte_pair import Units, byte_rows, encoder
from tokenledger.llm.tokens import gather
from tokenledger.session import scratch_path

#: text bytes of a block
BLOCK_BYTES = 12 << 20
#: distinct units aligned at once
CHUNK_UNITS = 50_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Tokens:
    """Byte lengths of a tokenizer's ids, and their decimal texts before each
    of the two signs that may follow them."""

    def __init__(self, lengths: list[int], last: str) -> None:
        self.size = len(lengths)
        self.length = np.array(lengths, np.int64)
        texts = [f"{k}{sign}".encode() for sign in (",", last) for k in range(self.size)]
        self.shown_length = np.array([len(t) for t in texts], np.int64)
        self.shown_at = np.cumsum(self.shown_length) - self.shown_length
        self.shown = b"".join(texts)


class Trie(Tokens):
    """A: ids by the trie encoder."""

    def __init__(self, name: str) -> None:
        self.encoder = encoder(name, specials=False)
        super().__init__(self.encoder.vocabulary.length, "|")

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        offsets, ids = self.encoder.encode_units(units)
        return np.diff(offsets), ids


class Pieces(Tokens):
    """B: a sentencepiece model and the bytes of its pieces."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece crosses the border of a unit")
        own = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode()
               for k, p in enumerate(pieces)]
        super().__init__([len(b) for b in own], ";")
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.space = self.model.piece_to_id("▁")

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units; the model puts back the space each begins with, but
        not before an empty text."""
        found = self.model.encode([u[1:].decode() for u in units], num_threads=1) if units else []
        found = [ids or [self.space] for ids in found]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return count, np.fromiter(chain.from_iterable(found), np.int64, int(count.sum()))


_tries: dict[str, Trie] = {}
_pieces: dict[str, Pieces] = {}


def trie(name: str) -> Trie:
    """The worker process's A."""
    if name not in _tries:
        _tries[name] = Trie(name)
    return _tries[name]


def pieces(name: str) -> Pieces:
    """The worker process's B."""
    if name not in _pieces:
        _pieces[name] = Pieces(name)
    return _pieces[name]


def slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common cumulative ends, and where each slice ends in A's and B's ids."""
    a_index = dict(zip(a_ends.tolist(), count(1)))
    b_index = dict(zip(b_ends.tolist(), count(1)))
    common = sorted(a_index.keys() & b_index.keys())
    n = len(common)
    return (np.array(common, np.int64), np.fromiter(map(a_index.__getitem__, common), np.int64, n),
            np.fromiter(map(b_index.__getitem__, common), np.int64, n))


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the overlaps, and the tokens of A and B that overlap there.
    Inside a slice no ends are equal, so between two neighbouring ends of
    either kind lies the overlap of one pair, and every overlap is such a
    stretch; slices border on common ends, so none is crossed."""
    both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def shown(a: Tokens, a_ids: np.ndarray, a_to: np.ndarray, b: Tokens, b_ids: np.ndarray,
          b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all groups, ``a1,a2|b1;``, and the place of each group's end."""
    total = len(a_ids) + len(b_ids)
    where, size = np.zeros(total, np.int64), np.zeros(total, np.int64)
    a_size, b_size = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
    a_place = np.arange(len(a_ids)) + np.repeat(b_to - b_size, a_size)
    b_place = np.arange(len(b_ids)) + np.repeat(a_to, b_size)
    a_key, b_key = a_ids.copy(), b_ids.copy()
    a_key[a_to - 1] += a.size  # the form before the next sign
    b_key[b_to - 1] += b.size
    where[a_place], size[a_place] = a.shown_at[a_key], a.shown_length[a_key]
    where[b_place], size[b_place] = b.shown_at[b_key] + len(a.shown), b.shown_length[b_key]
    text = gather(where, size, np.frombuffer(a.shown + b.shown, np.uint8))
    return text, np.cumsum(size)[a_to + b_to - 1]


class Block:
    """The distinct units of a block: counts, group texts and id pairs."""

    def __init__(self, units: list[bytes], a: Trie, b: Pieces) -> None:
        self.sound = np.ones(len(units), bool)
        self.count = np.zeros((4, len(units)), np.int64)
        self.text: list[bytes] = []
        pairs = [np.zeros(0, np.int64)]
        a_count, a_ids = a.encode(units)
        a_at = np.concatenate(([0], np.cumsum(a_count)))
        for at_ in range(0, len(units), CHUNK_UNITS):
            to = min(at_ + CHUNK_UNITS, len(units))
            pairs.append(self._add(at_, units[at_:to], a_count[at_:to], a_ids[a_at[at_]:a_at[to]].astype(np.int64), a, b))
        self.pairs = np.concatenate(pairs)
        self.pair_at = np.concatenate(([0], np.cumsum(self.count[3])))

    def _add(self, at_: int, units: list[bytes], a_count: np.ndarray, a_ids: np.ndarray, a: Trie,
             b: Pieces) -> np.ndarray:
        """Adds a run of units; their id pairs in order."""
        b_count, b_ids = b.encode(units)
        b_length = b.length[b_ids]
        ends = np.concatenate(([0], np.cumsum(b_length)))[np.concatenate(([0], np.cumsum(b_count)))]
        same = pc.equal(byte_rows(gather(b.at[b_ids], b_length, b.bytes), ends), pa.array(units, pa.large_binary()))
        sound = same.to_numpy(zero_copy_only=False)
        if not sound.all():
            a_ids, b_ids = a_ids[np.repeat(sound, a_count)], b_ids[np.repeat(sound, b_count)]
            a_count, b_count = a_count * sound, b_count * sound
        a_ends, b_ends = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
        unit_ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) * sound)
        common, a_to, b_to = slices(a_ends, b_ends)
        overlap, x, y = links(a_ends, b_ends)
        text, text_ends = shown(a, a_ids, a_to, b, b_ids, b_to)
        groups = np.searchsorted(common, unit_ends, "right")
        here = slice(at_, at_ + len(units))
        self.sound[here] = sound
        self.count[:, here] = (a_count, b_count, np.diff(groups, prepend=0),
                               np.diff(np.searchsorted(overlap, unit_ends, "right"), prepend=0))
        self.text += byte_rows(text, np.concatenate(([0], np.concatenate(([0], text_ends))[groups]))).to_pylist()
        return a_ids[x] * b.size + b_ids[y]


def with_space(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a space and the text, for texts that are not empty."""
    off, body = at.raw(texts)
    some = np.diff(off) > 0
    shift = np.concatenate(([0], np.cumsum(some)))
    out = np.full(len(body) + int(shift[-1]), 0x20, np.uint8)
    if len(body):
        out[np.arange(len(body)) + np.repeat(shift[1:], np.diff(off))] = body
    return off + shift, out


def _blocks(docs: DataFrame, text: str, doc_id: str, a_name: str, b_name: str, block_bytes: int, digest: bool) -> DataFrame:
    """Rows of documents, and one row per block with its units and pairs."""
    names = ["block", "doc_id", *COUNTS, "groups", "codes", "pair_at", "pair_index", "pairs", "counts"]
    kind = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow = to_arrow_type(kind)

    def run(batches):
        from pyspark import TaskContext
        a, b = trie(a_name), pieces(b_name)
        number = TaskContext.get().partitionId() << 32
        for batch in at.slices(batches, text, block_bytes):
            rows = batch.num_rows
            u = Units(*with_space(at.texts_of(batch.column(text))))
            block = Block(u.units, a, b)
            row = at.row_of(u.offsets)
            good = np.diff(u.offsets) > 0
            good[row[~block.sound[u.code]]] = False
            total = [np.concatenate(([0], np.cumsum(c[u.code])))[u.offsets] for c in block.count]
            columns = [pa.array(np.where(good, np.diff(t), 0), pa.int64()) for t in total]
            groups, codes = [], []
            for k in range(rows):
                own = u.code[u.offsets[k]:u.offsets[k + 1]] if good[k] else u.code[:0]
                codes.append(own.astype("<u4").tobytes())
                whole = b"".join(map(block.text.__getitem__, own.tolist()))[:-1]
                groups.append(whole.decode() if not digest or not good[k] else hashlib.sha256(whole).hexdigest())
            used = np.bincount(u.code[good[row]], minlength=len(u.units))
            distinct, index = np.unique(block.pairs, return_inverse=True)
            times = np.repeat(used, np.diff(block.pair_at))
            held = np.bincount(index, times, len(distinct)).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, number), pa.int64()), batch.column(doc_id), *columns, pa.array(groups, pa.string()),
                pa.array(codes, pa.binary()), *[pa.nulls(rows, pa.binary())] * 2,
                *[pa.nulls(rows, pa.list_(pa.int64()))] * 2], names)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.nulls(1, id_arrow), *[pa.nulls(1, pa.int64())] * 4,
                pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                pa.array([block.pair_at.astype("<u8").tobytes()], pa.binary()),
                pa.array([index.astype("<u4").tobytes()], pa.binary()),
                pa.array([distinct], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))], names)
            number += 1
            block = u = None
        at.release()

    return docs.select(doc_id, text).mapInArrow(
        run, f"block long, doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", groups string, codes binary, pair_at binary, pair_index binary, pairs array<long>, counts array<long>")


def _added(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's rows with the sums of their links' verdicts."""
    left = left.combine_chunks()
    is_row = left.column("codes").is_valid()
    block = left.filter(left.column("pair_at").is_valid())
    rows = left.filter(is_row)
    pair_at = np.frombuffer(block.column("pair_at")[0].as_py(), "<u8").astype(np.int64)
    index = np.frombuffer(block.column("pair_index")[0].as_py(), "<u4")
    size = int(index.max()) + 1 if len(index) else 0
    sums = []
    k = right.column("k").to_numpy()
    for name in ("best", "count"):
        of_pair = np.zeros(size, np.int64)
        of_pair[k] = right.column(name).to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(of_pair[index])))
        sums.append(total[pair_at[1:]] - total[pair_at[:-1]])
    off, codes = at.raw(rows.column("codes").combine_chunks().cast(pa.large_binary())) if rows.num_rows else (np.zeros(1, int), b"")
    codes = np.frombuffer(codes, "<u4")
    row_sums = [np.concatenate(([0], np.cumsum(s[codes])))[off // 4] for s in sums]
    return pa.table([rows.column("doc_id"), *[rows.column(c) for c in COUNTS],
                     *[pa.array(np.diff(s), pa.int64()) for s in row_sums], rows.column("groups")],
                    ["doc_id", *COUNTS, "n_best", "count_sum", "groups"])


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a: str = "byte_bpe_50k.json",
          b: str = "piece_bpe_32k.model", b_size: int = 32_000, block_bytes: int = BLOCK_BYTES,
          digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most
    frequent of its B id), count_sum (corpus-wide counts over links) and
    groups, as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` their SHA-256 (empty
    for a text without tokens)."""
    spark = docs.sparkSession
    if pieces(b).size != b_size:
        raise ValueError(f"{b} has {pieces(b).size} pieces")
    path = scratch_path(spark, "aligned")
    (_blocks(docs, text, doc_id, a, b, block_bytes, digest).write
     .option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path))
    stored = spark.read.parquet(path)
    held = (stored.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "p"))
            .select("block", "k", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")).where("n > 0"))
    counted = scratch_path(spark, "pair-counts")
    held.groupBy("pair").agg(F.sum("n").alias("count")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    own = (F.col("pair") % b_size).alias("piece")
    most = counts.groupBy(own).agg(F.max("count").alias("most"))  # a row per piece of B at most
    judged = (counts.select("*", own).join(F.broadcast(most), "piece")
              .select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    verdicts = held.join(judged, "pair").select(F.col("block").alias("of_block"), "k", "count", "best")
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("block", "doc_id", *COUNTS, "groups", "codes", "pair_at", "pair_index")
    return rows.groupBy("block").cogroup(verdicts.groupBy("of_block")).applyInArrow(
        _added, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups string")
