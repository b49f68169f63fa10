import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import phasing, regions


def test_weak_hits_that_contradict(spark):
    rows = [
        (1, 10, "ACGTA", "ACCTA", "substitution", 1), (1, 12, "GTACC", "GTTCC", "substitution", 2),  # no unitig in common
        (1, 40, "ACGTA", "ACCTA", "substitution", 1), (1, 42, "GTACC", "GTTCC", "substitution", 1),
        (1, 60, "ACGTA", "CCGTA", "substitution", 1),  # varies at its first base
        (2, 11, "ACGTA", "ACTTA", "substitution", 9),
    ]
    hits = spark.createDataFrame(rows, "read long, pos int, kmer string, near string, kind string, unitig_id long")
    assert sorted((r.read, r.pos) for r in regions.non_overlapping_weak(hits, "read", 5).collect()) == [(1, 40), (1, 42), (2, 11)]


def test_steps_need_links_and_colors(spark):
    hits = spark.createDataFrame([(1, p, u) for p, u in enumerate([7, 7, 8, 8, 9, 9])] + [(2, 0, 7), (2, 5, 9)], "read long, pos int, unitig_id long")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (8, 1), (8, 2), (9, 1)], "v long, color long")
    links = spark.createDataFrame([(7, 8), (8, 9)], "u long, v long")
    got = sorted((r.read, r.pos) for r in regions.color_consistent(hits, pairs, links, "read").collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 5)]


def test_one_unitig_bridges_both_anchors(spark):
    tig = "ACGTTGCAAGGCTA"
    tigs = spark.createDataFrame([(1, tig, 10)], "unitig_id long, seq string, n_kmers int")
    rows = [("f", 1, 2, True, 1, 8, True, "GTTGCAAGGCT"), ("b", 1, 8, False, 1, 2, False, "AGCCTTGCAAC"), ("x", 1, 8, True, 1, 2, True, "GTTGC"), ("y", 1, 2, True, 2, 8, True, "GTTGC")]
    df = spark.createDataFrame(rows, "name string, left_id long, left_dist int, left_strand boolean, right_id long, right_dist int, right_strand boolean, raw string")
    assert {r.name: r.path for r in regions.same_unitig(df, tigs, 5).collect()} == {"f": "GTTGCAAGGCT", "b": "AGCCTTGCAAC"}


def test_colors_of_three_sides_first(spark):
    rows = [(1, v, s, False, c) for v, s in ((1, "left"), (2, "right"), (3, "inner")) for c in (5, 6)] + [(1, 4, "left", True, c) for c in range(100, 140)]
    df = spark.createDataFrame(rows, "region long, vertex long, side string, branching boolean, color long")
    got = regions.choose_colors(df, ["region"]).first()
    assert got.weighted == [5, 6] and len(got.colors) == 32 and got.weight == 30.0


def flags(text):
    return np.array([c == "x" for c in text])


def test_consensus_takes_the_longer_run():
    raw = "ACGTTGCAAGGCTAATCGCA"
    none = flags("." * 20)
    f, b = ("AAGTTGCAAGGCTAATCGCA", "f" * 20, flags("xxxxxxxx............")), ("ACGTTGCAAGGCTAATCGTT", "b" * 20, flags("............xxxxxxxx"))
    assert regions.consensus(f, b, raw) == ("AAGTTGCAAGGCTAATCGTT", "f" * 8 + "b" * 12)  # good at its start one way, at its end the other
    assert regions.consensus((*f[:2], none), b, raw) == b[:2] and regions.consensus(f, (*b[:2], none), raw) == f[:2]
    assert regions.consensus((*f[:2], none), (*b[:2], none), raw) is None
    far = ("T" * 20, "t" * 20, flags("x" * 20))
    assert regions.consensus(far, b, raw) == b[:2] and regions.consensus(far, far, raw) is None
    longer = ("ACGTTGCAAGGCTAATCGCA", "l" * 20, flags("xxxxxxxxxxxx........"))
    assert regions.consensus(f, longer, raw)[1] == "l" * 20  # that of more replaced letters where neither has a run
    assert regions._run_lengths(flags("xx.x..")).tolist() == [2, 1, -1, 1, -2, -1]


def test_scores():
    assert regions.score_path("ACGT", "ACGT", True) == 1 and 0 <= regions.score_path("ACG", "ACGTACGT", False) <= 1


def test_overlaps_go_by_place_alone(spark):
    rows = [(1, p, 7) for p in range(5)] + [(1, 5, 8), (1, 6, 8), (1, 9, 9)] + [(2, 0, 1), (2, 1, 1), (2, 12, 1)]
    hits = spark.createDataFrame(rows, "read long, pos int, unitig_id long")
    assert sorted((r.read, r.pos) for r in regions.without_overlaps(hits, "read", 10).collect()) == [(1, 9), (2, 0), (2, 1), (2, 12)]


def test_phases_that_fit_nowhere(spark):
    a, b, c = [1, 2, 3], [7, 8, 9], [4, 5]
    rows = [(1, 0, a), (1, 500, b), (1, 501, b), (1, 900, a)]  # b has no place over 500 off but the void ones
    rows += [(2, 0, a), (2, 501, b)] + [(3, 0, a), (3, 500, b)] + [(4, 0, a), (4, 600, a), (4, 601, c), (4, 1200, list(range(2000)))]
    hits = spark.createDataFrame(rows, "read long, pos int, colors array<long>")
    got = sorted((r.read, r.pos) for r in phasing.incompatible(hits, "read", 500).collect())
    assert got == [(1, 501), (2, 0), (4, 601)]


def test_ambiguity_takes_the_reads_base(spark):
    df = spark.createDataFrame([("ARCN", "AGCT"), ("ARC", "ATC"), (None, "A")], "s string, r string")
    assert [r[0] for r in df.select(regions.resolve_ambiguity(F.col("s"), F.col("r"))).collect()] == ["AGCT", "ARC", None]


def test_cycles_are_put_in_while_edits_fall():
    assert regions.insert_cycles("XABY", ["ABA"], "XABABABY".replace("X", "X")) == "XABABABY"
    assert regions.insert_cycles("XABY", ["ACA"], "XABY") == "XABY"


def test_incompatible_deals_hits_once(spark):
    hits = spark.range(100).selectExpr("id % 7 AS read", "id AS pos", "array(id % 3, id % 2 + 5) AS colors")
    plan = phasing.incompatible(hits, "read", 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
