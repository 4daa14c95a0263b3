"""Token counts: lengths only, from Arrow functions.

Each task works through its Arrow batches in runs of rows of equal bytes
(``RUN_BYTES``), encodes the distinct words of a run and returns numbers; no
ids leave the task.  A text longer than ``LONG_BYTES`` is cut behind ASCII white
space, which is a safe boundary (see ``tokens``), so one long text is counted in
bounded memory too; a stretch without white space stays whole.

Cases: null counts as empty (0 bytes, 0 tokens); repeated rows each get their
row; special strings inside a text are handled as the library's default does;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.llm.tokens import RUN_BYTES, Encoded, forget_words

LONG_BYTES = 4 << 20
_BLANK = b" \t\n\v\f\r"


def split_long(data: bytes, most: int = LONG_BYTES) -> list[bytes]:
    """Parts of about ``most`` bytes that end behind ASCII white space."""
    parts, at_ = [], 0
    while len(data) - at_ > most:
        cut = max(data.rfind(bytes([c]), at_, at_ + most) for c in _BLANK)
        if cut < 0:  # no blank within reach: the next one, or all
            later = [p for c in _BLANK if (p := data.find(bytes([c]), at_ + most)) >= 0]
            if not later:
                break
            cut = min(later)
        parts.append(data[at_:cut + 1])
        at_ = cut + 1
    return [*parts, data[at_:]]


def counts_of(texts: pa.LargeStringArray, name: str) -> np.ndarray:
    if len(texts) == 1 and len(at.raw(texts)[1]) > LONG_BYTES:
        return np.array([sum(int(Encoded(pa.array([p.decode()], pa.large_string()), name).counts()[0])
                             for p in split_long(at.raw(texts)[1].tobytes()))])
    return Encoded(texts, name).counts()


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    def run(batches):
        for batch in at.slices(batches, text, RUN_BYTES):
            texts = at.texts_of(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pc.binary_length(texts).cast(pa.int64()),
                 pa.array(counts_of(texts, tokenizer), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        forget_words()

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
