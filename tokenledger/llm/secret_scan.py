"""Secret scan: all rules in one pass of one minimal automaton.

The rules are joined in one deterministic automaton over bytes
(``automaton``).  One pass over the text gives the ends of matches of every
rule; a reversed automaton of the rule finds the leftmost start that does not
overlap the match before; the span is then checked by the rule's own
expression and its least length.  Matches of one rule are leftmost and do not
overlap; rules may overlap each other.

Cases: a null or empty text has no spans; positions are code points, end
exclusive; any number of spans is kept; repeated rows each get their row;
extra columns are not read (``find_secrets``) or passed on (``redacted``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.automaton import Automaton


@dataclass(frozen=True)
class Rule:
    """``scan`` is what the joined automaton looks for when it may be more
    selective than ``pattern``; both must end at the same places."""
    kind: str
    pattern: str
    group: int
    least: int
    scan: str = ""


#: The three base rules, then formats of published key kinds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, scan=r"[0-9a-f]{6}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")


def compiled(rules: tuple[Rule, ...] = RULES):
    """(joined automaton, reversed automaton and expression of each rule).
    Built once on the driver and broadcast; its size depends on the rules only."""
    joined = Automaton([r.scan or r.pattern for r in rules], anchored=False)
    back = [Automaton([r.pattern], anchored=True, reverse=True) for r in rules]
    return joined, back, [re.compile(r.pattern.encode()) for r in rules]


def spans_of(texts: pa.LargeStringArray, rules: tuple[Rule, ...], built) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end) in code points, sorted."""
    joined, back, exact = built
    off, body = at.raw(texts)
    n = len(texts)
    sep = np.full(len(body) + n, 0x0A, np.uint8)  # a newline between texts ends every match
    sep[np.arange(len(body)) + at.row_of(off)] = body
    begin = off[:-1] + np.arange(n)
    where, which = joined.ends(sep)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not len(where):
        return out
    row_at = np.searchsorted(begin, where - 1, "right") - 1
    data = sep.tobytes()
    # code points before each byte, only of texts with a match
    for k, rule in enumerate(rules):
        has = (which >> k) & 1 == 1
        end, row = where[has], row_at[has]
        last = np.ones(len(end), bool)
        last[:-1] = (np.diff(end) != 1) | (row[1:] != row[:-1])
        done, done_row = 0, -1
        for e, r in zip(end[last].tolist(), row[last].tolist()):
            if r != done_row:
                done, done_row = int(begin[r]), r
            s = back[k].longest_back(data, e, done)
            if s < 0:
                continue
            done = e
            m = exact[k].fullmatch(data, s, e)
            if m and m.end(rule.group) - m.start(rule.group) >= rule.least:
                out[r].append((s, k, e))
    for r, own in enumerate(out):
        if own:
            base, stop = int(begin[r]), int(begin[r] + off[r + 1] - off[r])
            points = np.concatenate(([0], np.cumsum((sep[base:stop] & 0xC0) != 0x80)))
            out[r] = sorted((int(points[s - base]), k, int(points[e - base])) for s, k, e in own)
    return out


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end), by start, then rule order."""
    id_type = docs.schema[doc_id].dataType
    built = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches):
        for batch in at.slices(batches, text):
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in own]
                     for own in spans_of(at.texts_of(batch.column(text)), rules, built.value)]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type.simpleString()}, spans {SPAN}")


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined, as a column."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; every span (spans that overlap are merged)
    is replaced by ``mark``.  Texts without spans, null too, stay as they are."""
    names, schema = docs.columns, docs.schema
    built = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches):
        for batch in at.slices(batches, text):
            column = batch.column(text)
            found = spans_of(at.texts_of(column), rules, built.value)
            if any(found):
                values = column.to_pylist()
                for r, own in enumerate(found):
                    if own:
                        values[r] = cut(values[r], own, mark)
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if c == text else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, schema)


def cut(value: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, done = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        parts += [value[done:s], mark]
        done = e
    return "".join(parts) + value[done:]
