"""Arrow and numpy helpers shared by the text operators (run inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once inside a task; one longer text is taken alone.
SLICE_BYTES = 4 << 20

SPACE = 0x20


def byte_table(lower: bool, is_word) -> np.ndarray:
    """256-entry table: word bytes (A-Z lowered if asked) stay, others become
    a space.  Bytes from 0x80 up are always word bytes, so texts stay UTF-8."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    for b in range(0x80):
        if not is_word(table[b]):
            table[b] = SPACE
    return table


#: words [^\x20\x09-\x0D]+, A-Z lower-cased
LOWER_SPACED = byte_table(True, lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: words [^\x20\x09-\x0D]+ as they stand
SPACED = byte_table(False, lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
LOWER_ALNUM = byte_table(True, lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def texts_of(column) -> pa.LargeStringArray:
    """A column as large strings; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large-string array."""
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    base = int(off[0]) if len(off) else 0
    end = int(off[-1]) if len(off) else 0
    body = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return (off - base if len(off) else np.zeros(1, np.int64)), body


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of at most ``limit`` text bytes (a longer
    text comes alone), so what a task holds at once is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Gives memory that a finished task no longer needs back to the machine:
    worker processes are used again by tasks of other stages."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(texts: pa.LargeStringArray, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row offsets, words): row k has words[offsets[k]:offsets[k + 1]]."""
    off, body = raw(texts)
    n = len(texts)
    if not len(body):
        return np.zeros(n + 1, np.int64), pa.array([], pa.large_string())
    mapped = pa.Array.from_buffers(
        pa.large_string(), n,
        [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(table[body])])
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(mapped))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words gives one empty string
        gone = np.concatenate(([0], np.cumsum(empty)))
        values = values.filter(pa.array(~empty))
        offsets = offsets - gone[offsets]
    return offsets, values


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls, several times faster than by ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def hash_strings(values) -> np.ndarray:
    """64-bit hash of each string of a list or Arrow array."""
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    rows = values.to_pylist() if isinstance(values, pa.Array) else values
    return np.fromiter((digest(v) for v in rows), np.uint64, len(rows))


def word_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each word; every distinct word is hashed once."""
    if not len(values):
        return np.zeros(0, np.uint64)
    coded = values.dictionary_encode()
    return hash_strings(coded.dictionary)[coded.indices.to_numpy()]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each element under row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
