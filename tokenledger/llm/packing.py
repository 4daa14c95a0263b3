"""Lexical retrieval packing: BM25 neighbours share a training sequence.

1. Every whole text is tokenised once; its ids and its distinct words (hashes
   with counts) are written to the shared folder, and with them, per task,
   document frequencies by hashed word.
2. The frequencies of all documents are summed (``BUCKETS`` numbers, whatever
   the corpus size) and sent to the tasks with the number and mean length of
   all documents.
3. Each task cuts its rows into shards of about ``SHARD_TOKENS`` tokens and
   builds an inverted index with BM25 weights per shard.  A window begins with
   a seed document; the unused documents that share words with it follow, those
   of the highest score over all shared words first, until the window is full.  A document
   that does not fit is cut, and its rest is the next seed; when nothing is
   retrieved, the next unused document follows.  So every window is full but a
   shard's last, which is cut into sequences of powers of two: no padding.

Cases: a null or empty text is the end id alone; repeated rows are packed one
by one; an empty table gives no rows; a document longer than a window is cut
into several; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.tokens import Encoded, forget_words
from tokenledger.session import scratch_path

SHARD_TOKENS = 2 << 20
#: text bytes tokenised at once; words, ids and their places take many times as much
RUN_BYTES = 4 << 20
BUCKETS = 1 << 16
K1, B = 1.2, 0.75


def _tokenised(docs: DataFrame, text: str, doc_id: str, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of documents (ids, terms, counts) and one row per task with the
    document frequencies of its rows (df, n_docs, n_words)."""
    names = ["doc_id", "ids", "terms", "counts", "n_words", "n_docs", "df"]

    def run(batches):
        df = np.zeros(BUCKETS, np.int32)
        n_docs = n_words = 0
        for batch in at.slices(batches, text, RUN_BYTES):
            at.release()
            e = Encoded(at.texts_of(batch.column(text)), tokenizer)
            rows = batch.num_rows
            size = e.counts()
            ids = e.all_ids()
            cut = np.concatenate(([0], np.cumsum(size)))
            row, term = at.row_of(e.offsets), e.terms[e.code]
            row, term = row[term != 0], term[term != 0]
            pairs, count = np.unique(row.astype(np.uint64) << np.uint64(32) | term, return_counts=True)
            terms, owner = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int64)
            count = count.astype(np.uint32)
            own = np.searchsorted(owner, np.arange(rows + 1))
            df += np.bincount(terms & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32)
            end = np.array([end_id], ids.dtype).tobytes()
            n_docs += rows
            n_words += int(e.offsets[-1])
            yield pa.RecordBatch.from_arrays([
                batch.column(doc_id),
                pa.array([ids[cut[k]:cut[k + 1]].tobytes() + end for k in range(rows)], pa.binary()),
                pa.array([terms[own[k]:own[k + 1]].tobytes() for k in range(rows)], pa.binary()),
                pa.array([count[own[k]:own[k + 1]].tobytes() for k in range(rows)], pa.binary()),
                pa.array(np.diff(e.offsets), pa.int64()), pa.nulls(rows, pa.int64()),
                pa.nulls(rows, pa.list_(pa.int32()))], names)
        forget_words()
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_arrow), *[pa.nulls(1, pa.binary())] * 3, pa.array([n_words], pa.int64()),
                 pa.array([n_docs], pa.int64()), pa.array([df], pa.list_(pa.int32()))], names)

    kind = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow = to_arrow_type(kind)
    return docs.select(doc_id, text).mapInArrow(
        run, f"doc_id {kind.simpleString()}, ids binary, terms binary, counts binary, n_words long, n_docs long, df array<int>")


class Shard:
    """An inverted index over the rows of one shard, and the packing of it."""

    def __init__(self, rows: list[tuple], df: np.ndarray, n_docs: int, mean_words: float) -> None:
        self.rows = rows
        n = len(rows)
        terms = [np.frombuffer(r[2], np.uint32) for r in rows]
        term = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        tf = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]).astype(np.float32)
        own = np.array([len(t) for t in terms])
        self.own = np.concatenate(([0], np.cumsum(own)))
        doc = np.repeat(np.arange(n), own)
        seen = df[term & np.uint32(BUCKETS - 1)]
        idf = np.log1p((np.maximum(n_docs - seen, 0) + 0.5) / (seen + 0.5)).astype(np.float32)
        length = np.array([r[4] for r in rows], np.float32)[doc] / max(mean_words, 1e-9)
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        # by word, then place: a sort of numbers, several times faster than an argsort
        placed = np.sort(term.astype(np.uint64) << np.uint64(32) | np.arange(len(term), dtype=np.uint64))
        order, ordered = (placed & np.uint64(0xFFFFFFFF)).astype(np.int64), placed >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(term) else np.zeros(0, int)
        self.post_at = np.append(first, len(term))
        self.post_doc, self.post_weight = doc[order], weight[order].astype(np.float64)
        number = np.empty(len(term), np.int64)  # posting list of each of a document's words
        number[order] = np.repeat(np.arange(len(first)), np.diff(self.post_at))
        self.number = number
        # words that only one document holds retrieve nothing
        self.weight = np.where(np.diff(self.post_at)[number] > 1, weight, 0) if len(term) else weight

    def scores(self, seed: int) -> np.ndarray:
        lo, hi = self.own[seed], self.own[seed + 1]
        w = self.weight[lo:hi]
        lists = self.number[lo:hi][w > 0]
        if not len(lists):
            return np.zeros(0, np.float32)
        begin = self.post_at[lists]
        size = self.post_at[lists + 1] - begin
        at_ = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.post_doc[at_], self.post_weight[at_], len(self.rows))

    def pack(self, window: int, width: int):
        """Yields sequences: lists of (row, start, length)."""
        n = len(self.rows)
        size = np.array([len(r[1]) // width for r in self.rows], np.int64)
        unused = np.ones(n, bool)
        nxt = 0
        rest: tuple[int, int] | None = None
        while True:
            pieces, room, scores = [], window, None
            while room:
                if rest is None:
                    row = -1
                    if pieces:
                        if scores is None:
                            scores = self.scores(pieces[0][0])
                            scores = scores * unused if len(scores) else scores
                        if len(scores):
                            best = int(scores.argmax())
                            row = best if scores[best] > 0 else -1
                    if row < 0:
                        while nxt < n and not unused[nxt]:
                            nxt += 1
                        if nxt == n:
                            break
                        row = nxt
                    unused[row] = False
                    if scores is not None and len(scores):
                        scores[row] = 0
                    rest = (row, 0)
                row, start = rest
                take = min(room, int(size[row]) - start)
                pieces.append((row, start, take))
                room -= take
                rest = (row, start + take) if start + take < size[row] else None
            if not pieces:
                return
            if room:
                yield from in_powers(pieces)
                return
            yield pieces


def in_powers(pieces: list[tuple[int, int, int]]):
    """The pieces as sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    queue = list(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            row, start, length = queue.pop(0)
            take = min(room, length)
            out.append((row, start, take))
            room -= take
            if take < length:
                queue.insert(0, (row, start + take, length - take))
        yield out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "word_bpe_49k.json",
         end_id: int = 1, window: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset and ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "packing")
    (_tokenised(docs, text, doc_id, tokenizer, end_id).write
     .option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path))
    stored = spark.read.parquet(path)
    df = np.zeros(BUCKETS, np.int64)
    for r in (stored.where("df is not null").select(F.posexplode("df").alias("k", "n")).where("n > 0")
              .groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator()):
        df[r.k] = r.n
    whole = stored.where("df is not null").agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean = whole[0] or 0, (whole[1] or 0) / max(whole[0] or 1, 1)
    shared = spark.sparkContext.broadcast(df)

    def run(batches):
        from pyspark import TaskContext

        from tokenledger.llm.tokens import encoder
        width = np.dtype(encoder(tokenizer).id_type).itemsize
        sequence = TaskContext.get().partitionId() << 32
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                ids = columns[1][k].as_py()
                rows.append((columns[0][k].as_py(), ids, columns[2][k].as_py(), columns[3][k].as_py(),
                             columns[4][k].as_py()))
                held += len(ids) // width
                if held >= shard_tokens:
                    shard = Shard(rows, shared.value, n_docs, mean)
                    for out, sequence in _emit(shard, window, width, sequence):
                        yield out
                    rows, held = [], 0
        if rows:
            for out, sequence in _emit(Shard(rows, shared.value, n_docs, mean), window, width, sequence):
                yield out
        rows = None
        at.release()

    kind = stored.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow = to_arrow_type(stored.schema["doc_id"].dataType)

    def _emit(shard: Shard, window: int, width: int, sequence: int):
        """Record batches of about a thousand sequences, with the next number."""
        source = f"<u{width}"
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_arrow), *[pa.array(c, pa.int64()) for c in cols[1:6]],
                 pa.array(cols[6], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for k, pieces in enumerate(shard.pack(window, width)):
            offset = 0
            for row, start, length in pieces:
                own = shard.rows[row]
                ids = np.frombuffer(own[1], source, length, start * width).astype("<u4").tobytes()
                out.append((own[0], start, length, len(own[1]) // width, sequence, offset, ids))
                offset += length
            sequence += 1
            if k % 1000 == 999:
                yield batch(), sequence
                out.clear()
        if out:
            yield batch(), sequence

    return (stored.where("df is null").select("doc_id", "ids", "terms", "counts", "n_words").mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))
