import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, junctions, kmers, packed

K = 31
_RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_RC)[::-1]


def kmers_of(seq, k=K):
    return [(i, seq[i : i + k]) for i in range(len(seq or "") - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


def rep(x):
    return min(x, rc(x))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    core = dna(400)
    out = [core, core[50:300], rc(core[100:350]), "A" * 200, "AC" * 100, "", None, dna(30), dna(31), dna(120) + "N" + dna(90) + "RN" + core[:80], "N" * 40]
    for _ in range(30):  # copies with a letter changed: bubbles, both strands
        a = rng.randrange(300)
        piece = list(core[a : a + 100])
        piece[50] = rng.choice("ACGT")
        out += ["".join(piece), rc("".join(piece))]
    out += 2 * [core[:50] + ("A" if core[50] != "A" else "C")]  # ends one letter off the way
    keys = [*range(len(out))]
    keys[1] = keys[2] = 7  # repeated
    keys[3] = None
    return list(zip(keys, out, strict=True))


@pytest.fixture(scope="module")
def reads(spark, rows):
    return spark.createDataFrame(rows, "id long, seq string").repartition(3)


def test_counts_of_odd_reads(reads, rows):
    n, docs = Counter(), {}
    for key, seq in rows:
        for _, x in kmers_of(seq):
            n[rep(x)] += 1
            docs.setdefault(rep(x), set()).update(() if key is None else [key])
    got = packed.counts(reads, K).select(packed.letters(F.col("rep"), K), "n").collect()
    assert len(got) == len(n) and dict(map(tuple, got)) == n
    got = packed.counts_by_reads(reads, K, "id").select(packed.letters(F.col("rep"), K), "n", "d").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {x: (n[x], len(docs[x])) for x in n}
    assert dict(map(tuple, packed.spectrum(reads, K).collect())) == Counter(n.values())
    want = {}
    for key, seq in rows:
        for _, x in kmers_of(seq):
            if n[rep(x)] > 1:
                c, t = want.get(key, (0, 0))
                want[key] = (c + 1, t + n[rep(x)])
    assert {r[0]: (r[1], r[2]) for r in packed.coverage(reads, K, "id").where("n_solid > 0").collect()} == want


def test_shuffles_no_row_per_kmer(reads, rows):
    n = sum(len(kmers_of(seq)) for _, seq in rows)
    pieces = packed.super_kmers(reads, K)
    assert pieces.count() < n / 4
    assert pieces.agg(F.sum(F.col("n").bitwiseAND(F.lit(127)))).first()[0] == n


def test_a_read_longer_than_a_slice(spark):
    seq = "".join(random.Random(3).choices("ACGT", k=packed.SLICE + 500))
    one = spark.createDataFrame([(1, seq)], "id long, seq string")
    got = packed.counts(one, K).agg(F.count("*"), F.sum("n")).first()
    assert tuple(got) == (len({rep(x) for _, x in kmers_of(seq)}), len(seq) - K + 1)
    assert junctions.links(junctions.junctions(one, K, 1), K).count() == 2 * (len(seq) - K)


@pytest.mark.parametrize("k", [9, 31])
def test_links_and_degrees(spark, reads, k):
    nodes = graph.oriented(kmers.solid(kmers.kmers(reads.na.fill("").select("seq"), k, [], strict=True)))
    want = graph.edges(nodes, k)
    found = junctions.junctions(reads, k)
    got = junctions.links(found, k).select(packed.letters(F.col("u"), k).alias("u"), packed.letters(F.col("v"), k).alias("v"))
    assert Counter(got.collect()) == Counter(want.collect())
    deg = {r.v: (r.n_in, r.n_out) for r in graph.degrees(nodes, want).collect()}
    got = junctions.degrees(found, k).select(packed.letters(F.col("rep"), k).alias("v"), "n_in", "n_out").collect()
    assert {r.v: (r.n_in, r.n_out) for r in got} == {v: d for v, d in deg.items() if v <= rc(v)}


def test_snps_and_bubbles(reads):
    texts = reads.na.fill("").select("seq")
    solid = kmers.solid(kmers.kmers(texts, K, [], strict=True))
    nodes = graph.oriented(solid)
    want = {tuple(r) for r in graph.snp_candidates(nodes, K).collect()}
    got = junctions.snp_candidates(packed.counts(reads, K, 2), K).select(packed.letters(F.col("v"), K), "pos", "bases").collect()
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want
    links = graph.edges(nodes, K)
    cov = solid.select(F.explode(F.array("rep", F.reverse(F.translate("rep", "ACGT", "TGCA")))).alias("v"), "n").distinct()
    stats = graph.degrees(nodes, links).join(cov, "v").select("v", F.col("n").alias("cov"), F.lit(1).alias("len"), "branching")
    assert junctions.bubble_coverage(junctions.junctions(reads, K), K).first()[0] == graph.bubble_coverage(links, stats).first()[0] > 0


def test_places_and_rescue(spark, reads, rows):
    core = rows[0][1]
    other = spark.createDataFrame([(0, core[80:160]), (1, core[80:120]), (2, None)], "id long, seq string")
    held = Counter(rep(x) for s in (core[80:160], core[80:120]) for _, x in kmers_of(s))
    n = Counter(rep(x) for _, s in rows for _, x in kmers_of(s))
    assert {tuple(r) for r in packed.shared(reads, other, K).select(packed.letters(F.col("rep"), K), "n", "m").collect()} == {(x, n[x], m) for x, m in held.items()}
    want = Counter((rep(x), key, i, x == rep(x)) for key, s in rows for i, x in kmers_of(s) if rep(x) in held)
    got = packed.places(reads, other, K, "id").select(packed.letters(F.col("rep"), K), "key", "pos", "fwd").collect()
    assert Counter(map(tuple, got)) == want
    some = packed.rescued(reads, spark.createDataFrame([(core,)], "seq string"), other, K, "id", 5)
    mine = {rep(x) for _, x in kmers_of(core)} - {x for x, m in held.items() if m > 1}
    per = Counter(key for key, s in rows for _, x in kmers_of(s) if rep(x) in mine)
    assert {r.key: r.n for r in some.collect()} == {key: c for key, c in per.items() if c >= 5}


def test_near_hits(spark, reads, rows):
    has = {rep(x) for _, s in rows for _, x in kmers_of(s)}
    weak = [(i, (lambda s: s[:10] + ("A" if s[10] != "A" else "C") + s[11:])(rows[0][1][a : a + K])) for i, a in enumerate(range(0, 300, 20))]
    want = {}
    for key, x in weak:
        near = {x[:i] + b + x[i + 1 :] for i in range(K) for b in "ACGT"} | {(x[: i + 1] + b + x[i + 1 :])[:K] for i in range(K - 1) for b in "ACGT"} | {x[:i] + x[i + 1 :] + b for i in range(K) for b in "ACGT"}
        n = sum(rep(y) in has for y in near - {x})
        if n:
            want[key] = n
    got = packed.near_hits(spark.createDataFrame(weak, "key long, kmer string"), reads, K).collect()
    assert want and {r.key: r.n for r in got} == want


def test_least_kmers_of_odd_reads(spark, reads, rows):
    want = sorted((str(key), min(rep(x) for _, x in kmers_of(seq))) for key, seq in rows if kmers_of(seq))
    got = packed.least_kmers(reads, K, ["id"])
    assert sorted((str(r.id), r.head) for r in got.select("id", packed.letters(F.col("head"), K).alias("head")).collect()) == want
    assert "Exchange" not in packed.least_kmers(spark.range(9).selectExpr("id", "'ACGT' AS seq"), K, ["id"])._jdf.queryExecution().toString()
    rng = random.Random(8)
    long = "".join(rng.choices("ACGT", k=2 * packed.SLICE + 500))  # more than two stretches
    df = spark.createDataFrame([(1, "ACGT" * 20), (2, long), (3, long[::-1])], "id int, seq string").coalesce(1)
    got = {r.id: r.head for r in packed.least_kmers(df, K, ["id"]).select("id", packed.letters(F.col("head"), K).alias("head")).collect()}
    assert got == {1: min(rep(x) for _, x in kmers_of("ACGT" * 20)), 2: min(rep(x) for _, x in kmers_of(long)), 3: min(rep(x) for _, x in kmers_of(long[::-1]))}


def test_unitigs_of_packed_kmers_as_of_text(reads, rows):
    ring = "".join(random.Random(3).choices("ACGT", k=90))
    spark = reads.sparkSession
    more = reads.select("seq").union(spark.createDataFrame([(2 * ring + ring[:40],), (rc(3 * ring),)], "seq string")).repartition(3)
    want, index = graph.unitigs(kmers.solid(kmers.kmers(more, K, [], strict=True)), K)
    got, packed_index = graph.unitigs_of(more, K)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, packed_index.collect())) == sorted(map(tuple, index.collect()))


@pytest.mark.parametrize("k, lot", [(31, packed.LOT), (31, 0), (9, 0)])
def test_unitigs_by_slots_as_of_text(spark, reads, monkeypatch, k, lot):
    rng = random.Random(3)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    rings = [s for n in (1, 2, 3, 7, 90, 400, 500) for x in [dna(n)] for s in ((x * 100)[: n + 60], rc((x * 100)[: 2 * n + 70]))]
    long, loop = dna(900), dna(60)
    more = [*rings, long, long, loop + rc(loop), rc(loop) + loop[:50], loop + dna(5) + rc(loop), 2 * (loop[:20] + dna(300) + rc(loop[:20]))]
    texts = reads.select("seq").union(spark.createDataFrame([(s,) for s in more], "seq string")).repartition(3)
    made, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: made.append(kept(df)) or made[-1])
    want, index = graph.unitigs(kmers.solid(kmers.kmers(texts, k, [], strict=True)), k)
    del made[:]
    monkeypatch.setattr(packed, "LOT", lot)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "10000" if lot else "3")  # small lots: paths are cut wherever the minimizer changes
    try:
        got, packed_index = graph.unitigs_by_slots(texts, k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, packed_index.collect())) == sorted(map(tuple, index.collect()))
    finally:
        spark.conf.set(batch, before)
    states = [t for t in made if "hops" in t.columns]
    assert sum(os.path.exists(t.stored_at.removeprefix("file:")) for t in states) == 1 and (lot or len(states) > 2)
    assert states[-1].count() < index.count() / 3  # rounds don't go over k-mers


def test_colours_and_places_of_unitigs_as_of_text(spark, reads, rows):
    tigs, index = graph.unitigs(kmers.solid(kmers.kmers(reads.na.fill("").select("seq"), K, [], strict=True)), K)
    tigs, index = graph.kept(tigs), graph.kept(index)
    each = kmers.kmers(reads.na.fill(""), K, ["id"]).join(index, "kmer")
    want = each.groupBy("unitig_id", F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    got = packed.colored(reads, tigs, K, "id")
    assert Counter(map(tuple, got.select("unitig_id", "key", "n").collect())) == Counter(map(tuple, want.collect())) and want.count() > 50
    mine = kmers.kmers(reads.na.fill(""), K, []).select("kmer").distinct()
    want = mine.join(index, "kmer").select("kmer", "unitig_id", "dist", "strand").collect()
    assert Counter(map(tuple, packed.located(mine, tigs, K).collect())) == Counter(map(tuple, want)) and want


def test_correction_makes_no_table_of_all_kmers(spark, monkeypatch):
    from graphloom.plans import pipeline

    genome = "".join(random.Random(9).choices("ACGT", k=1500))
    short = spark.createDataFrame([(genome[a : a + 100],) for a in range(0, 1400, 9)], "seq string")
    worn = "".join("ACGT"["ACGT".index(c) - 1] if i % 61 == 30 else c for i, c in enumerate(genome[200:900]))
    made, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: made.append(kept(df)) or made[-1])
    got = pipeline.correct_once(short, spark.createDataFrame([(1, "r", worn)], "read_id long, name string, seq string"), pipeline.Params(insert=100)).first()
    assert sum(a != b for a, b in zip(got.seq, genome[200:900], strict=True)) < 5
    assert not [t for t in made if {"kmer", "dist", "strand"} == set(t.columns) - {"unitig_id"}]


def test_links_that_reads_share_come_as_text(spark, reads, rows):
    long = "".join(random.Random(4).choices("ACGT", k=packed.SLICE + 700))  # a lot of more than one stretch
    more = [*rows, (100, long), (101, rc(long[5000:])), (102, long[:400])]
    df = spark.createDataFrame(more, "id long, seq string").coalesce(1)
    n, docs, after = Counter(), {}, {}
    for key, seq in more:
        for _, x in kmers_of(seq):
            n[rep(x)] += 1
            docs.setdefault(rep(x), set()).update(() if key is None else [key])
    for x in {y for z, c in n.items() if c > 1 for y in (z, rc(z))}:
        after.setdefault(x[:-1], []).append(x)
    want = {u + v: len(docs[rep(u)] & docs[rep(v)]) for us in after.values() for u in us for v in after.get(u[1:], [])}
    got = junctions.supported_links(df, K, "id")
    kept = got.withColumn("named", F.concat(packed.letters(F.col("u"), K), packed.letters(F.col("v"), K))).collect()
    assert len(kept) == len(want) and {r.both: r.shared for r in kept} == want and all(r.named == r.both for r in kept)
