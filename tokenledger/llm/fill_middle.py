"""Fill-in-the-middle transformation of whole texts, by Arrow kernels.

A text's units are its lines, line ends included.  For every run of rows:
split the texts into lists of units, flatten them with the row of each, compute
each unit's ordinal in its row, filter the units of each role (prefix, middle,
suffix) by ordinal, rebuild lists, and join every list with ``binary_join``.

Where a text is cut, and in which form it is written, follows from the SHA-256
of ``seed:doc_id`` alone, so a retried task gives the same rows.

Cases: a null text is empty; an empty text, and one that holds a marker, stays
plain (prefix_chars and middle_chars null); repeated rows are cut alike, as
the cut depends on doc_id and text; a null doc_id counts as an empty string;
a very long text is taken alone; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at

#: fixed values: the markers before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers: the first four groups of eight hex digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def units(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, units) of texts: lines with their line ends."""
    lists = pc.split_pattern(texts, "\n")
    lines, ends = pc.list_flatten(lists), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    last = np.zeros(len(lines), bool)
    last[ends[1:] - 1] = True  # what follows a text's last line end
    lines = pc.binary_join_element_wise(lines, pc.if_else(pa.array(last), _text(""), _text("\n")), _text(""))
    kept = pc.or_(pa.array(~last), pc.not_equal(lines, _text("")))
    gone = np.concatenate(([0], np.cumsum(~kept.to_numpy(zero_copy_only=False))))
    return ends - gone[ends], lines.filter(kept)


def _joined(rows: int, parents: np.ndarray, lines: pa.Array, role: np.ndarray) -> pa.Array:
    """For each row, its units that have the role, joined."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(parents[role], minlength=rows)))).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), lines.filter(pa.array(role))), _text(""))


def transformed(texts: pa.LargeStringArray, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> list[pa.Array]:
    """Units, form, prefix and middle length and output of a run of texts."""
    rows = len(texts)
    offsets, lines = units(texts)
    n = np.diff(offsets)
    parents = at.row_of(offsets)
    ordinal = np.arange(len(lines)) - offsets[parents]
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(first, second)[parents], np.maximum(first, second)[parents]
    prefix = _joined(rows, parents, lines, ordinal < low)
    middle = _joined(rows, parents, lines, (ordinal >= low) & (ordinal < high))
    suffix = _joined(rows, parents, lines, ordinal >= high)
    plain = pc.or_(pc.equal(texts, _text("")), pa.array(h[2] % 100 >= 100 - plain_percent))
    for marker in MARKERS:
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    spm = pa.array(h[3] % 100 < spm_percent)

    def written(*parts) -> pa.Array:
        return pc.binary_join_element_wise(*[_text(p) if isinstance(p, str) else p for p in parts], _text(""))

    output = pc.case_when(pc.make_struct(plain, spm), texts, written(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
                          written(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    form = pc.case_when(pc.make_struct(plain, spm), *[pa.scalar(f) for f in ("plain", "spm", "psm")])
    none = pa.scalar(None, pa.int64())
    return [pa.array(n, pa.int64()), form, *[pc.if_else(plain, none, pc.utf8_length(p).cast(pa.int64()))
                                             for p in (prefix, middle)], output]


def restored(outputs: pa.LargeStringArray, forms: pa.Array) -> pa.LargeStringArray:
    """The texts from outputs and forms.  Markers never stand in the parts of
    a text that is not plain, so the output is split at them."""
    plain = pc.equal(forms, "plain")
    cut = pc.split_pattern_regex(pc.if_else(plain, _text("".join(MARKERS)), outputs), "<[PSM]>")
    one, two, three = (pc.list_element(cut, k) for k in (1, 2, 3))  # what follows each marker, as written
    return pc.case_when(pc.make_struct(plain, pc.equal(forms, "spm")), outputs,
                        pc.binary_join_element_wise(two, three, one, _text("")),
                        pc.binary_join_element_wise(one, three, two, _text("")))


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7, plain_percent: int = 0,
              spm_percent: int = 50) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars
    (code points) and output of every text."""
    def run(batches):
        for batch in at.slices(batches, "text"):
            if not batch.num_rows:
                continue
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            found = transformed(at.texts_of(batch.column(1)), h, plain_percent, spm_percent)
            found[-1] = found[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *found],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(doc_id), seed))])
    return given.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed_rows: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``text``, rebuilt from output and form."""
    def run(batches):
        for batch in at.slices(batches, "output"):
            names = batch.schema.names
            texts = restored(at.texts_of(batch.column(names.index("output"))), batch.column(names.index("form")))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed_rows.schema.fields)
    return transformed_rows.mapInArrow(run, f"{fields}, text string")
