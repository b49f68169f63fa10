"""Operator 9: token counts per document without ids of documents.

Each distinct pre-token of a slice of documents is taken through the merges once and only the
number of its pieces is kept, in a bounded table of the worker. A document is the codes of its
chunks; they are joined to the counts and summed.

Dealing all (document, pre-token, frequency) rows to one count per pre-token of the whole corpus
was tried first: it moves several times the bytes of the texts to save merges that cost less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretoken import Known, encoder, slices
from graphloom.llm.workers import task

KNOWN_BYTES = 48_000_000


class PieceCounts:
    """Numbers of pieces of chunks."""

    def __init__(self, path: str):
        self.e = encoder(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.pieces = Known(), np.zeros(0, np.int32)

    def learn(self, chunks: pa.Array) -> None:
        words, code, per_chunk = self.e.pre.flat(chunks)
        pieces = self.e.words(words)[1]
        total = np.concatenate([[0], np.cumsum(pieces[code])])[np.cumsum(per_chunk)]
        self.pieces = np.concatenate([self.pieces, np.diff(total, prepend=0).astype(np.int32)])

    def of(self, texts: pa.Array) -> np.ndarray:
        code, chunks, offsets = self.e.split(texts)
        if not len(chunks):
            return np.zeros(len(texts), np.int64)
        if self.known.size() + self.pieces.nbytes > KNOWN_BYTES:
            self.forget()
        at, missing = self.known.numbers(chunks)
        if len(missing):
            self.learn(missing)
        sums = np.concatenate([[0], np.cumsum(self.pieces[at][code], dtype=np.int64)])
        return np.diff(sums[offsets])


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens): one row per input row.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept; other
    columns are not looked at.
    """

    @task(encoder, piece_counts)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(piece_counts(path).of(b.column("text")))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
