"""The learnt operators against plain versions of their arithmetic."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from graphloom.llm import quality, toxicity


def texts(n):
    rng = random.Random(12)
    return [" ".join(rng.choices(["the", "stone", "Ab", "12", "#!", "river", "of", "x"], k=rng.randint(0, 30))) for _ in range(n)]


def test_ftrl_as_written_out():
    some = texts(40)
    labels = np.array([float("stone" in t) for t in some])
    got = quality.train(some, labels, epochs=2)
    rows = quality.vectors(pa.array(some))
    bias = len(got) - 1
    z, squares = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.02:
            return 0.0
        return -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(squares[i])) / 0.3 + 0.5)

    rng = np.random.default_rng(5)
    for _ in range(2):
        for k in rng.permutation(len(some)):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = (p - labels[k]) * v, squares.get(i, 0.0)
                squares[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(squares[i]) - math.sqrt(before)) / 0.3 * w[i]
    want = np.zeros(len(got))
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-9) and np.abs(want).max() > 0.1


def test_scores_are_sparse_dot_products():
    some = [*texts(20), None, "", "   "]
    w = np.random.default_rng(2).normal(size=(1 << quality.SLOTS_LOG2) + 2)
    got = quality.score(pa.array(some), w)
    for (slots, values), s in zip(quality.vectors(pa.array(some)), got, strict=True):
        assert math.isclose(s, 1 / (1 + math.exp(-(w[slots] @ values + w[-1]))), rel_tol=1e-9)


def subsequences(word):
    """(slot, weight) of three letters in a span of up to five and four in up to six."""
    for size, span in ((3, 5), (4, 6)):
        for places in itertools.combinations(range(len(word)), size):
            reach = places[-1] - places[0]
            if reach < span:
                h = sum((ord(word[p]) + 1) * int(toxicity._MIX[i]) for i, p in enumerate(places)) % (1 << 64)
                h = ((h ^ h >> 31) * int(toxicity._MIX[0])) % (1 << 64)
                yield h >> (64 - toxicity.SLOTS_LOG2), toxicity.DECAY ** (reach + 1 - size)


def test_kernel_counts_all_gapped_subsequences():
    words = ["^idiot$", "^a$", "^$", "^banana$", "^süßstoff$", "^abcdefghijklmnop$", "^iidxiot$"]
    v = np.random.default_rng(8).normal(size=1 << toxicity.SLOTS_LOG2)
    got = toxicity.word_scores(words, v)
    dense = toxicity.unit_vectors(words)
    for i, word in enumerate(words):
        parts = list(subsequences(word))
        norm = math.sqrt(sum(w * w for _, w in parts) + 1e-9)  # each occurrence by itself
        assert math.isclose(got[i], sum(v[s] * w for s, w in parts) / norm, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(dense[i] @ v, got[i], rel_tol=1e-3, abs_tol=1e-3)
