"""Operator 5: toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel compares words by the letter subsequences they share: three letters in a span of up
to five, four in up to six, each weighted by ``DECAY`` to the letters left out. So an insult with
gaps or inserted characters still shares most of its weight with the plain one; punctuation
inside words and spaces between single letters are taken out before.

Landmarks are words of the labelled texts. The Nyström map is the kernel to the landmarks times
the inverse root of their own kernel matrix; a linear SVM is trained on it over sentences, each
standing for its most suspicious word, with the sentences of toxic texts chosen anew in each
round. The machine is linear in the subsequences, so a word's score is one sparse dot product.
A text is judged by how many of its words lie beyond the margin, and how far.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretoken import listed, slices
from graphloom.llm.quality import labelled_sample
from graphloom.llm.simhash import split_words
from graphloom.llm.workers import task

SLOTS_LOG2 = 18
DECAY = 0.65
LANDMARKS = 192
ROUNDS = 5
MAX_LABELLED = 8_000
KNOWN = 400_000
PATTERNS = [(0, *mid, last) for size, span in ((3, 5), (4, 6)) for last in range(size - 1, span) for mid in combinations(range(1, last), size - 2)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def canonical(chunk: str) -> str:
    """Letters and digits of a chunk in lower case, between marks."""
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk)
    chunk = chunk.lower()
    if not chunk.isalnum():
        chunk = "".join(filter(str.isalnum, chunk))
    return f"^{chunk}$"


def _classes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words, and their letters, in groups of similar length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    low, width = 0, 8
    while low < (lens.max() if len(lens) else 0):
        which = np.flatnonzero((lens > low) & (lens <= width))
        for some in np.array_split(which, max(1, len(which) * width // 1_000_000)):
            if len(some):
                letters = np.array([words[i] for i in some.tolist()], f"U{width}")
                yield some, np.frombuffer(letters.tobytes(), np.uint32).reshape(len(some), width)
        low, width = width, width * 2


def subsequences(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Slots of one gap pattern at all places of all words, where the words reach so far, and the weight."""
    wide = letters.astype(np.uint64)
    for p in PATTERNS:
        n = letters.shape[1] - p[-1]
        if n > 0:
            h = sum((wide[:, o : o + n] + np.uint64(1)) * _MIX[i] for i, o in enumerate(p))
            h = (h ^ (h >> np.uint64(31))) * _MIX[0] >> np.uint64(64 - SLOTS_LOG2)
            yield h.astype(np.int64), letters[:, p[-1] :] > 0, DECAY ** (p[-1] + 1 - len(p))


def word_scores(words: list[str], v: np.ndarray) -> np.ndarray:
    """Of canonical words: the dot product of their unit vectors with v."""
    out = np.zeros(len(words))
    for which, letters in _classes(words):
        dot, norm = np.zeros(len(which)), np.full(len(which), 1e-9)
        for slots, there, weight in subsequences(letters):
            dot += weight * (v[slots] * there).sum(axis=1)
            norm += weight * weight * there.sum(axis=1)
        out[which] = dot / np.sqrt(norm)
    return out


def unit_vectors(words: list[str], columns: np.ndarray | None = None) -> np.ndarray:
    """Dense unit vectors of a few words; with columns, only these slots of them."""
    size = 1 << SLOTS_LOG2
    place = np.arange(size)
    if columns is not None:
        size = len(columns)
        place = np.full(1 << SLOTS_LOG2, size)  # a last column takes all other slots
        place[columns] = np.arange(size)
    out = np.zeros((len(words), size + 1), np.float32)
    for which, letters in _classes(words):
        norm = np.full(len(which), 1e-9)
        rows = np.repeat(which[:, None], letters.shape[1], axis=1)
        for slots, there, weight in subsequences(letters):
            np.add.at(out, (rows[:, : slots.shape[1]], place[slots]), weight * there)
            norm += weight * weight * there.sum(axis=1)
        out[which] /= np.sqrt(norm)[:, None]
    return out[:, :size]


def canonical_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of each word of all texts, the distinct chunks, offsets of texts. Runs of three or more single letters add a word."""
    chunks, offsets = split_words(texts)
    coded = chunks.dictionary_encode()
    code, distinct = coded.indices.to_numpy().astype(np.int64), listed(coded.dictionary)
    single = np.fromiter((len(c) < 4 and sum(map(str.isalnum, c)) == 1 for c in distinct), bool, len(distinct))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    s = single[code]
    if len(s) > 2 and (runs := s[2:] & s[1:-1] & s[:-2] & (doc[2:] == doc[:-2])).any():
        add: list[tuple[int, str]] = []
        at = np.flatnonzero(runs)
        for start in at[np.concatenate([[True], np.diff(at) > 1])].tolist():
            end = start
            while end < len(s) and s[end] and doc[end] == doc[start]:
                end += 1
            add.append((int(doc[start]), "".join(distinct[c] for c in code[start:end])))
        code = np.insert(code, offsets[[d + 1 for d, _ in add]], len(distinct) + np.arange(len(add)))
        distinct = distinct + [w for _, w in add]
        offsets = offsets + np.concatenate([[0], np.cumsum(np.bincount([d for d, _ in add], minlength=len(texts)))])
    return code, distinct, offsets


def text_features(scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: words beyond the margin, beyond half, their share, the highest score and its margin, length."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    count = lambda mask: np.bincount(doc[mask], minlength=len(n))
    high = np.full(len(n), -2.0)
    np.maximum.at(high, doc, scores)
    high = np.clip(high, -2, 2)
    beyond, half = count(scores > 0.5), count(scores > 0)
    per = 100 / np.maximum(n, 1)
    return np.stack([np.log1p(beyond), np.log1p(half), np.minimum(beyond * per, 10), np.minimum(half * per, 10), high, np.maximum(high, 0), np.log1p(n), np.ones(len(n))], axis=1)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 2.0, steps: int = 60) -> np.ndarray:
    """Primal linear SVM of squared hinge loss by Newton steps, halved while they don't help; the last column is the constant."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    ridge = np.eye(x.shape[1])
    loss = lambda w: w @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        step = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * (wa * y[active])[:, None]).sum(axis=0)) - w
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-8:
            step = step / 2
        if now - then < 1e-6 * now:
            break
        w, now = w + step, then
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, text weights): the machine as a vector over subsequences, its offset last; and the text-level weights."""
    code, chunks, offsets = canonical_words(pa.array(texts, pa.large_string()))
    words = list(dict.fromkeys(map(canonical, chunks)))
    at = {w: i for i, w in enumerate(words)}
    word = np.array([at[canonical(c)] for c in chunks], np.int64)[code] if len(chunks) else code
    toxic = labels > 0
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    zero = np.zeros((1 << SLOTS_LOG2) + 1)
    if not len(words) or toxic.all() or not toxic.any():
        bias = np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
        return zero, np.array([0, 0, 0, 0, 0, 0, 0, bias])
    seen = np.unique(doc * len(words) + word)
    in_doc, in_word = seen // len(words), seen % len(words)
    bad = np.bincount(in_word[toxic[in_doc]], minlength=len(words))
    good = np.bincount(in_word[~toxic[in_doc]], minlength=len(words))
    odds = np.log((bad + 0.2) / (toxic.sum() + 1)) - np.log((good + 0.2) / ((~toxic).sum() + 1))
    # first guess: subsequences by how much oftener they stand in words of toxic texts
    v = np.zeros(1 << SLOTS_LOG2)
    for which, letters in _classes(words):
        pull = np.minimum(bad[which], 50) * (odds[which] > 1.0) * odds[which] - 0.3 * np.minimum(good[which], 50) * (odds[which] < 0.5)
        for slots, there, weight in subsequences(letters):
            np.add.at(v, slots.reshape(-1), (weight * there * pull[:, None]).reshape(-1))
    v = np.sign(v) * np.log1p(np.abs(v))
    f = word_scores(words, v)
    f = (f - f.mean()) / (f.std() + 1e-9)
    strong = np.argsort(-(odds * np.log1p(bad) + 0.3 * f))[: LANDMARKS // 2]
    hard = np.flatnonzero((good > 0) & (odds < 0.3))
    hard = hard[np.argsort(-f[hard])]
    rng = np.random.default_rng(3)
    plain = rng.permutation(np.flatnonzero(good > 0))[: LANDMARKS // 4]
    landmarks = [words[i] for i in dict.fromkeys([*strong.tolist(), *hard[: LANDMARKS // 4].tolist(), *plain.tolist()])]
    basis = unit_vectors(landmarks)
    used = np.flatnonzero(basis.any(axis=0))
    basis = np.ascontiguousarray(basis[:, used])
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def kernel(some: list[str]) -> np.ndarray:
        rows = np.zeros((len(some), len(landmarks)))
        for a in range(0, len(some), 256):
            rows[a : a + 256] = unit_vectors(some[a : a + 256], used) @ basis.T
        return np.hstack([rows @ root, np.ones((len(some), 1))])

    def stretched(word: str) -> list[str]:
        """A toxic word with a letter put in, as it may be hidden."""
        at = rng.integers(2, len(word) - 1, 2)
        return [word[:i] + chr(rng.integers(97, 123)) + word[i:] for i in at.tolist()]

    f = f + odds * np.log1p(bad)
    offset = 0.0
    for _ in range(ROUNDS):
        # sentences stand for their highest word: of a toxic text the two highest, of clean ones all high, all
        # frequent and some other words
        order = np.lexsort((-f[in_word], in_doc))
        place = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.bincount(in_doc, minlength=len(texts)))])[in_doc[order]]
        top = order[place < 2]
        positive = np.unique(in_word[top[toxic[in_doc[top]]]])
        positive = positive[odds[positive] > 1.0]
        clean = np.flatnonzero(good > 0)
        negative = np.concatenate([clean[np.argsort(-f[clean])][:3000], clean[np.argsort(-good[clean])][:2000], rng.permutation(clean)[:2000]])
        negative = np.setdiff1d(negative, positive[odds[positive] > 2.5])
        if not len(positive) or not len(negative):
            break
        plainly = [words[i] for i in positive.tolist()]
        hidden = [h for w in plainly if len(w) > 6 for h in stretched(w)]
        a = _svm(kernel(plainly + hidden + [words[i] for i in negative.tolist()]), np.concatenate([np.ones(len(plainly) + len(hidden)), -np.ones(len(negative))]))
        v = np.zeros(1 << SLOTS_LOG2)
        v[used] = (root @ a[:-1]) @ basis
        offset = a[-1]
        f = word_scores(words, v) + offset
    out = np.append(v, offset).astype("<f4").astype(float)
    scores = (word_scores(words, out[:-1]) + out[-1])[word]
    return out, _logistic(text_features(scores, offsets), toxic.astype(float))


class Scorer:
    def __init__(self, machine: bytes):
        v = np.frombuffer(machine, "<f4").astype(float)
        self.v, self.offset, self.text = v[:-9], v[-9], v[-8:]
        self.known: dict[str, float] = {}

    def score(self, texts: pa.Array) -> np.ndarray:
        code, chunks, offsets = canonical_words(texts)
        if len(self.known) > KNOWN:
            self.known.clear()
        if missing := [c for c in dict.fromkeys(chunks) if c not in self.known]:
            self.known.update(zip(missing, (word_scores([canonical(c) for c in missing], self.v) + self.offset).tolist(), strict=True))
        f = np.fromiter(map(self.known.__getitem__, chunks), float, len(chunks))[code] if len(chunks) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(text_features(f, offsets) @ self.text, -30, 30)))


@lru_cache(maxsize=2)
def scorer(machine: bytes) -> Scorer:
    return Scorer(machine)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> bytes:
    """The machine, about 1 MB, learnt in one task from at most ``limit`` labelled rows; no rows: every score 0.5."""

    @task()
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        for b in batches:
            texts += pc.fill_null(b.column("text"), "").to_pylist()
            marks += b.column("label").to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), marks[i]))
            v, w = train([texts[i] for i in order], np.array([marks[i] for i in order]))
            yield pa.RecordBatch.from_arrays([pa.array([np.append(v, w).astype("<f4").tobytes()])], ["m"])

    got = labelled_sample(docs, labels, label, limit).repartition(1).mapInArrow(learn, "m binary").collect()
    return bytes(got[0].m) if got else np.zeros((1 << SLOTS_LOG2) + 9, "<f4").tobytes()


def toxicity_scores(docs: DataFrame, machine: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row. Null and empty texts have no words: they score as such.

    Null ids and repeated rows are kept; other columns are not looked at.
    """

    @task(scorer)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(machine)
        for b in slices(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s.score(b.column("text")))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, f"id {kind}, score double")
    return rows.withColumnRenamed("id", id_col)
