import random

import pytest

from graphloom import cli
from graphloom.functions import align
from graphloom.plans import pipeline
from graphloom.plans.pipeline import Params, correct, correct_once


def drawn(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def tiled(spark, genomes, n=100, step=10):
    rows = [(f"{j}-{i}", g[i : i + n]) for j, g in enumerate(genomes) for i in range(0, len(g) - n + 1, step)]
    return spark.createDataFrame(rows, "name string, seq string")


def test_lengths_of_both_passes():
    assert Params(k=15, k2=31).k2 == 31
    for bad in ({"k": 71, "k2": 63}, {"k": 51, "k2": 51}, {"insert": 0}, {"rounds": 0}, {"color_confidence": 1.5}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert cli.parser().parse_args(["correct", "-s", "x", "-o", "y", "-W", "6000"]).max_len_weak2 == 6000


def test_rounds_grow_to_the_limits():
    assert pipeline.round_limits(Params()) == [(0.25, 1000)]
    assert [(round(a, 3), b) for a, b in pipeline.round_limits(Params(rounds=4))] == [(0.1, 250), (0.15, 500), (0.2, 750), (0.25, 1000)]


def test_both_passes_with_any_second_length(spark):
    genome = drawn(700, 3)
    rng = random.Random(4)
    noisy = "".join(rng.choice("ACGT".replace(c, "")) if rng.random() < 0.06 else c for c in genome)
    long = spark.createDataFrame([(1, "r", noisy), (2, "none", drawn(60, 9)), (3, "empty", "")], "read_id long, name string, seq string")
    got = {r.read_id: r for r in correct(tiled(spark, [genome]), long, Params(k=15, k2=21, insert=100, least_length2=300)).collect()}
    edits = lambda s: int(align.last_row(s, genome)[-1])
    assert edits(noisy) > 30 and edits(got[1].seq) <= 3 and len(got[1].seq) == len(got[1].qual)
    assert got[2].seq == drawn(60, 9) and set(got[2].qual) == {"!"} and got[3].seq == ""


def test_heads_middles_and_tails(spark):
    genome = drawn(300, 5)
    noisy = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in (3, 150, 290) else c for i, c in enumerate(genome))
    long = spark.createDataFrame([(1, "r", noisy), (2, "none", "ACGT" * 20), (3, "empty", "")], "read_id long, name string, seq string")
    short = tiled(spark, [genome + drawn(20, 6)], step=4).union(tiled(spark, [drawn(20, 7) + genome], step=4).selectExpr("name || 'x'", "seq"))
    got = {r.read_id: r for r in correct_once(short, long, Params(k=15, collapse=False)).collect()}
    assert got[1].seq == genome and len(got[1].qual) == 300
    assert got[1].qual[0] < "I" and got[1].qual[299] < "I" and got[1].qual[60] == "I"
    assert got[2].seq == "ACGT" * 20 and got[3].seq == ""
