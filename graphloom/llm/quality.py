"""Operator 4: quality by logistic regression over hashed word n-grams, trained by FTRL.

A word is a run of letters, of digits, or of one other character. Its n-grams are the word, the
word's form (letter case, length, the symbol itself) in runs of one to three, and whether a word
or pair of words came before in the text. Each n-gram is hashed to a slot; its value is its
share of the text's words. A score is the sparse dot product with the slots' weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretoken import listed, ragged, slices
from graphloom.llm.simhash import split_words
from graphloom.llm.workers import task

SLOTS_LOG2 = 18
MAX_LABELLED = 12_000
EPOCHS = 4
SCALE = 8.0
KNOWN_BYTES = 40_000_000
_words = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.DOTALL)
_PAIR, _TRIPLE, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def form(word: str) -> str:
    if word.isdigit():
        return "0"
    if not word[0].isalpha():
        return word[:4]
    case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    return case + str(min(len(word) // 4, 5))


class Words:
    """Chunks to hashes of their words and forms; the table is bounded."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.size = 0

    def learn(self, chunk: str) -> None:
        words = [m.group() for m in _words.finditer(chunk)]
        own = np.array([zlib.crc32(w.lower().encode()) for w in words], "<u4").tobytes()
        forms = np.array([zlib.crc32(b"form " + form(w).encode()) for w in words], "<u4").tobytes()
        self.known[chunk] = own, forms
        self.size += len(chunk) + 2 * len(own) + 280

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of words, of forms, and offsets of texts into them."""
        chunks, offsets = split_words(texts)
        coded = chunks.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), listed(coded.dictionary)
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        for c in distinct:
            if c not in self.known:
                self.learn(c)
        got = [self.known[c] for c in distinct]
        n = np.fromiter((len(g[0]) for g in got), np.int64, len(got)) // 4
        at = ragged((np.cumsum(n) - n)[code], n[code])
        own, forms = (np.frombuffer(b"".join([g[i] for g in got]), "<u4")[at].astype(np.uint64) for i in (0, 1))
        return own, forms, np.concatenate([[0], np.cumsum(n[code])])[offsets]


@lru_cache(maxsize=1)
def words_table() -> Words:
    return Words()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots (not summed) and the text of each; words per text; share of words in repeated pairs."""
    own, forms, offsets = words_table().of(texts)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    shift = np.uint64(64 - SLOTS_LOG2)
    same2 = doc[1:] == doc[:-1]
    pair = (forms[:-1] * _PAIR) ^ forms[1:]
    same3 = same2[1:] & same2[:-1]
    triple = (pair[:-1] * _TRIPLE) ^ forms[2:]
    words = (own[:-1] * _PAIR) ^ own[1:]
    twin = own[1:] == own[:-1]
    # a pair of words seen before in the text
    key = (doc[1:].astype(np.uint64) * _REPEAT) ^ (words * _TRIPLE)
    key = key[same2]
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    repeats = np.bincount(doc[1:][same2][again], minlength=len(n))
    hashes = [own, forms + np.uint64(1 << 33), pair[same2], triple[same3], words[same2], np.full(int((twin & same2).sum()), 7, np.uint64)]
    docs = [doc, doc, doc[1:][same2], doc[2:][same3], doc[1:][same2], doc[1:][twin & same2]]
    slots = [((h * _REPEAT) >> shift).astype(np.int64) for h in hashes]
    return np.concatenate(slots), np.concatenate(docs), n, repeats / np.maximum(n, 1)


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots and values of each text; the last slot holds the share of repeated pairs."""
    slots, doc, n, repeats = features(texts)
    key, count = np.unique((doc << SLOTS_LOG2) | slots, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(n) + 1) << SLOTS_LOG2)
    out = []
    for i in range(len(n)):
        a, b = cut[i], cut[i + 1]
        index = np.append(key[a:b] & ((1 << SLOTS_LOG2) - 1), 1 << SLOTS_LOG2)
        out.append((index, np.append(count[a:b] * (SCALE / max(1, n[i])), SCALE * repeats[i])))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights of all slots, of the repeated share, and the bias, by follow-the-regularised-leader updates."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for b in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])], "t", 6_000_000):
        rows += vectors(b.column("t"))
    size = (1 << SLOTS_LOG2) + 2
    z, squares = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(squares[i])) / alpha + l2))

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = np.append(rows[k][0], size - 1), np.append(rows[k][1], 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[k]) * x
            before = squares[i]
            squares[i] = before + g * g
            z[i] += g - (np.sqrt(squares[i]) - np.sqrt(before)) / alpha * w
    return weights(np.arange(size))


def score(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    slots, doc, n, repeats = features(texts)
    sums = np.bincount(doc, w[slots], len(n)) if len(slots) else np.zeros(len(n))
    logit = SCALE * (sums / np.maximum(n, 1) + w[-2] * repeats) + w[-1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` documents with a label outside the held-out fifth: those of least hash of the id, then of the text.

    An id that is labelled both ways has no label; rows that repeat an id are documents of their own, and count to the limit.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    chosen = rows.where("label = other").select("doc_id", "label").orderBy(F.xxhash64("doc_id")).limit(limit)  # bounded, so it can be broadcast
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return both.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(limit).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> np.ndarray:
    """Weights learnt in one task from the bounded sample. No labelled rows: all weights 0, every score 0.5."""

    @task(words_table)
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        for b in batches:
            texts += pc.fill_null(b.column("text"), "").to_pylist()
            marks += b.column("label").to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), marks[i]))
            w = train([texts[i] for i in order], np.array([marks[i] for i in order], float))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()])], ["w"])

    got = labelled_sample(docs, labels, label, limit).repartition(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0].w, "<f4").astype(float) if got else np.zeros((1 << SLOTS_LOG2) + 2)


def quality_scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, keep): one row per input row. Null and empty texts have no n-grams: they get the bias alone.

    Null ids and repeated rows are kept; the columns ``keep`` go through as they are, others are not looked at.
    """
    blob = weights.astype("<f4").tobytes()  # 1 MB, whatever the input
    names = [f"__{i}" for i in range(len(keep))]

    @task(words_table)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(blob, "<f4").astype(float)
        for b in slices(batches, "__text", 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(score(b.column("__text"), w)), *(b.column(c) for c in names)], ["__id", "score", *names])

    fields = ", ".join([f"__id {docs.schema[id_col].dataType.simpleString()}", "score double", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))])
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *(F.col(c).alias(n) for n, c in zip(names, keep, strict=True))).mapInArrow(apply, fields)
    return rows.select(F.col("__id").alias(id_col), "score", *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)))
