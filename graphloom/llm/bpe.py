"""Operator 1: BPE encoding and decoding of whole texts (merges by segment tree, see segtree_bpe)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.pretoken import binary_rows, encoder, rows_of, slices
from graphloom.llm.workers import task


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per input row, ids as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; a null id is kept; repeated rows give repeated rows;
    other columns are not looked at. Added tokens' strings in a text become their ids.
    """

    @task(encoder)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([b.column(id_col), binary_rows(*e.encode(b.column(text_col))).cast(pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids binary")


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the decoded text of each row of ids; null or empty ids: the empty text.

    An id outside the vocabulary is an error, as there is no text for it.
    """

    @task(encoder)
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, ids_col):
            ids = b.column(ids_col)
            yield pa.RecordBatch.from_arrays([b.column(id_col), ids, e.decode(*rows_of(ids)).cast(pa.string())], [id_col, ids_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(decode, f"`{id_col}` {kind}, `{ids_col}` binary, text string")
