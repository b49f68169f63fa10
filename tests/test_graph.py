import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import colors, correction, graph, kmers, ordering, phasing, walks
from graphloom.plans.pipeline import Params, correct_once
from graphloom.sources import fastx


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome(n, seed=42):
    rng = random.Random(seed)
    return "".join(rng.choices("ACGT", k=n))


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")


def test_canonical_counts(spark):
    df = reads(spark, ["ACGTTGCAAG", "CTTGCAACGT", "ACGTTNCAAG"])
    got = {r.rep: r.n for r in kmers.counts(kmers.kmers(df, 5, ["id"], strict=True)).collect()}
    assert {k: got[k] for k in ("AACGT", "CAACG", "CTTGC", "GCAAC", "TGCAA")} == {"AACGT": 3, "CAACG": 2, "CTTGC": 2, "GCAAC": 2, "TGCAA": 4}


def test_long_strings_in_chunks(spark):
    g = genome(1000)
    got = sorted((r.pos, r.kmer) for r in kmers.kmers(reads(spark, [g, "ACG"]), 21, ["id"]).collect())
    assert got == [(i, g[i : i + 21]) for i in range(980)]


def tigs_of(spark, seqs, k):
    solid = kmers.counts(kmers.kmers(reads(spark, seqs), k, ["id"]))
    return graph.unitigs(solid, k)


def test_a_line_is_one_unitig(spark):
    g = genome(300)
    tigs, index = tigs_of(spark, [g], 21)
    assert [min(g, rc(g))] == [r.seq for r in tigs.collect()]
    assert index.count() == 2 * 280


def test_a_bubble_has_four_unitigs(spark):
    g = genome(200)
    other = g[:100] + ("A" if g[100] != "A" else "C") + g[101:]
    tigs, index = tigs_of(spark, [g, other], 21)
    assert sorted(r.n_kmers for r in tigs.collect()) == [21, 21, 79, 80]
    links = graph.edges(graph.oriented(kmers.counts(kmers.kmers(reads(spark, [g, other]), 21, ["id"]))), 21)
    assert links.groupBy("u").count().where("count = 2").count() == 2
    assert graph.unitig_edges(tigs, 21).count() == 8


def test_a_ring_is_cut_once(spark):
    g = genome(60)
    tigs, _ = tigs_of(spark, [g + g[:20]], 21)
    assert [r.n_kmers for r in tigs.collect()] == [60]


def test_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "u string, v string")
    assert sorted(r.start for r in graph.short_cycles(links, 4).collect()) == ["a", "b", "c"]


def test_inexact_neighbours(spark):
    one = kmers.neighbourhood(kmers.kmers(reads(spark, ["ACGTACG"]), 7, ["id"]), 7, ["id"])
    near = {r.near for r in one.collect()}
    assert {"ACGAACG", "ACGTTAC", "AGTACGT"} <= near and "ACGTACG" not in near


def test_trim(spark):
    row = lambda qual: spark.createDataFrame([(1, "r1", "ACGTACGTACGT", qual)], "id long, name string, seq string, qual string")
    cut = lambda qual: sorted((r.name, r.seq) for r in correction.trimmed(row(qual), ["id"], 10, 4).collect())
    assert cut("IIII!!IIIIII") == [("r1/1", "ACGT"), ("r1/2", "GTACGT")]
    assert cut("III!IIIIII!I") == [("r1/1", "ACGTAC")]


def test_reads_are_corrected(spark):
    g = genome(1500)
    short = [g[i : i + 100] for i in range(0, 1401, 20)]
    rng = random.Random(1)
    noisy = list(g)
    for i in range(60, 1440, 40):
        noisy[i] = rng.choice([b for b in "ACGT" if b != g[i]])
    gone = next(i for i in range(805, 815) if g[i - 1] != g[i] != g[i + 1])  # in a run of one base the anchors would overlap
    del noisy[gone]
    noisy = "".join(noisy)
    long = spark.createDataFrame([(1, "a", noisy), (2, "b", genome(200, 9)), (3, "c", g[100:400])], "read_id long, name string, seq string")
    got = {r.read_id: r for r in correct_once(reads(spark, short), long, Params(k=15)).collect()}
    assert all(len(r.seq) == len(r.qual) for r in got.values())
    assert got[1].seq == g
    assert got[2].seq == genome(200, 9) and set(got[2].qual) == {"!"}
    assert got[3].seq == g[100:400] and set(got[3].qual) == {"I"}
    again = correct_once(reads(spark, short).repartition(7), long.repartition(3), Params(k=15)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_parameters():
    for bad in ({"k": 30}, {"k": 31, "k2": 29}, {"trim": 41}, {"window": 0.0}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_phasing(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 1), ("t", 1), ("t", 2), ("u", 2)], "name string, hap int")
    assert {r.name: r.phased for r in phasing.assignments(rows, "name", "hap", False).collect()} == {"s": True, "t": False, "u": True}
    assert {r.name: r.phased for r in phasing.assignments(rows, "name", "hap", True).collect()} == {"s": False, "t": False, "u": True}
    three = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "block int, type string")
    with pytest.raises(ValueError):
        phasing.dictionary(three)


def test_colors(spark):
    pairs = spark.createDataFrame([(v, c) for v in range(40) for c in range(v % 30 + 1)], "v long, color long")
    stats = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("cov")).withColumn("branching", F.col("v") < 0)
    kept = colors.subsample(pairs, stats, 50.0)
    assert 0 < kept.count() < pairs.count() and kept.exceptAll(pairs).count() == 0
    assert colors.subsample(pairs, stats, 5.0).count() == pairs.count()
    assert kept.groupBy("v").count().count() == 40
    assert colors.sampled(pairs, "color", 0.0).count() == 0 and colors.sampled(pairs, "color", 1.0).count() == pairs.count()


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(300)], "x long, y long")
    got = {(r.x, r.y): r["rank"] for r in ordering.global_rank(df, "x", ["y"], ranges=8).collect()}
    assert got == {p: i + 1 for i, p in enumerate(sorted((i * 7 % 101, i) for i in range(300)))}
    assert ordering.global_rank(df.limit(0), "x", ["y"]).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x\nACGT\nAC\n>r2\nGG\n")
    (tmp_path / "b.fastq").write_text("@q1\nacgt\n+\n@III\n@q2/1\nAC\n+\nII\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fasta\n{tmp_path}/b.fastq\n")
    df = fastx.read_fastx(spark, [f"{tmp_path}/list"])
    assert sorted((r.name, r.seq, r.qual) for r in df.collect()) == [("q1", "ACGT", "@III"), ("q2/1", "AC", "II"), ("r1", "ACGTAC", None), ("r2", "GG", None)]
    assert [r.name for r in fastx.suffixed_names(df).collect()] == ["q2/1"]
    fastx.write_fastq(df.where("qual is not null"), f"{tmp_path}/out.fastq")
    assert "@q1\nACGT\n+\n@III" in "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/out.fastq").collect())
    (tmp_path / "p.tsv").write_text("#c\nr1\tH1\tb1\nr2\tnone\tb1\nbad\n")
    assert [(r.name, r.type) for r in fastx.read_phasing(spark, f"{tmp_path}/p.tsv").collect()] == [("r1", "H1")]


def test_places_and_colours_of_broadcast_sides_are_not_shuffled(spark):
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    steps = spark.range(50).selectExpr("id % 9 AS path", "id % 4 AS v", "int(id) AS offset", "60 AS length")
    snps = spark.range(40).selectExpr("id % 4 AS v", "int(id) AS pos", "1 AS bases")
    assert shuffles(graph.path_ambiguity(steps, F.broadcast(snps), "path", "v", "length")) == 1
    chosen = spark.range(50).selectExpr("id % 9 AS gap", "id AS color")
    pairs = spark.range(400).selectExpr("id % 8 AS unitig_id", "id % 50 AS color")
    both = spark.range(8).selectExpr("id AS unitig_id", "id AS v")
    found = walks.allowed(chosen, F.broadcast(both), F.broadcast(pairs))
    assert shuffles(found) == 1 and found.columns == ["gap", "v", "n"]


def test_rounds_leave_only_their_last_table(spark, monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    made, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: made.append(kept(df)) or made[-1])
    tigs, _ = graph.unitigs_of(spark.createDataFrame([(text,), (text,)], "seq string"), 21)
    assert [r.n_kmers for r in tigs.collect()] == [280]
    states = [t for t in made if "hops" in t.columns]
    assert len(states) > 8 and sum(os.path.exists(t.stored_at.removeprefix("file:")) for t in states) == 1
