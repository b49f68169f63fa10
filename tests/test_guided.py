"""The correction's steps between anchors, on small graphs whose results can be told by hand or by trying all."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import align
from graphloom.operators import graph, guided, kmers, regions, walks

K = 15


def drawn(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def worn(s, places):
    return "".join("ACGT".replace(c, "")[i % 3] if i in places else c for i, c in enumerate(s))


def graph_of(spark, seqs, k=K):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    tigs, index = graph.unitigs(kmers.solid(kmers.kmers(df, k, []), 1), k)
    both = graph.kept(walks.sides(tigs))
    return both, graph.kept(walks.steps(both, k, 2000)), {r.kmer: r for r in walks.placed(index, tigs).collect()}


GAP = "hop string, gap string, raw string, u long, off int, w long, w_off int"


def test_walk_finds_the_closest_of_all_paths(spark):
    k, rng = 7, random.Random(2)
    base = drawn(90, 4)
    seqs = [base] + [worn(base, rng.sample(range(90), 4)) for _ in range(4)]
    both, links, at = graph_of(spark, seqs, k)
    after = {}
    for km in at:
        after.setdefault(km[: k - 1], []).append(km)
    gaps, want = [], {}
    for n, (s, a) in enumerate(itertools.product(seqs, (0, 20, 40))):
        raw = worn(s[a : a + 34], {10, 17, 25})
        raw = raw[:k] + raw[k:-k] + s[a + 34 - k : a + 34]
        first, last = raw[:k], raw[-k:] if n % 2 else None
        least, most = k + int((34 - k) * 0.75), k + int((34 - k) * 1.25)
        paths, best = {first}, []
        while paths:
            best += [(-1 + int(align.last_row(p, raw)[-1]) / max(len(p), 34), len(p), p) for p in paths if len(p) >= least and (last is None or p.endswith(last))]
            paths = {p + x[-1] for p in paths if len(p) < most for x in after.get(p[1 - k :], [])}
        u, w = at[first], at[last] if last else None
        gaps.append((str(n), str(n), raw, u.v, u.off, w and w.v, w and w.off))
        if best and -min(best)[0] >= 0.75:
            want[str(n)] = (min(best)[2], round(-min(best)[0], 9))
    got = walks.walk(spark.createDataFrame(gaps, GAP), both, links, k, beam=10_000).where("score >= 0.75").collect()
    assert {r.hop: (r.path, round(r.score, 9)) for r in got} == want and len(want) > 10


def test_no_number_of_open_paths_takes_the_closest_from_a_gap(spark):
    start, rest = drawn(20, 31), drawn(40, 32)
    raw, way = start + "AAAAA" + rest, start + "TTTTT" + rest
    closer = [start + "".join(x) + rest[:8] for x in itertools.product("ACGT", repeat=5)]  # 1023 others, which lead nowhere
    fork = way[:34] + ("A" if way[34] != "A" else "C")
    both, links, at = graph_of(spark, [way, fork, *closer])
    u, w = at[start[:K]], at[rest[-K:]]
    gaps = spark.createDataFrame([("0", "0", raw, u.v, u.off, w.v, w.off)], GAP)
    score = 1 - int(align.last_row(way, raw)[-1]) / len(raw)
    assert [(r.path, round(r.score, 9), r.other) for r in walks.walk(gaps, both, links, K).collect()] == [(way, round(score, 9), None)]
    assert walks.walk(gaps, both, links, K, beam=512).isEmpty()


def test_paths_that_cannot_be_closest_end(spark):
    rng = random.Random(5)
    rows = []
    for v, n in itertools.product(range(3), (30, 31)):
        rows += [("h", v, "".join(rng.choices("ACGT", k=n)), [rng.randrange(9) for _ in range(6)]) for _ in range(60)]
    table = [(h, v, p, bytearray(b"".join(x.to_bytes(4, "little") for x in r)), i % 60 < 58) for i, (h, v, p, r) in enumerate(rows)]
    df = spark.createDataFrame(table, "hop string, v long, path string, row binary, goes_on boolean").repartition(5)
    got = walks.leading(df).collect()
    assert sorted(r.path for r in got) == sorted(r[2] for r in rows)
    on = {}
    for h, v, p, r in (x for i, x in enumerate(rows) if i % 60 < 58):
        on.setdefault((v, len(p)), []).append((r, p))
    want = {p for own in on.values() for x in range(6) for _, p in sorted((r[x], p) for r, p in own)[:2]}
    assert {r.path for r in got if r.goes_on} == want


def test_long_gap_on_a_branching_graph(spark):
    g = drawn(1000, 6)
    other = worn(g, set(range(44, 800, 90)))
    both, links, at = graph_of(spark, [g, other])
    raw = g[:K] + worn(g[K : 900 - K], set(range(3, 870, 11))) + g[900 - K : 900]
    a, b = at[raw[:K]], at[raw[-K:]]
    got = walks.walk(spark.createDataFrame([("x", "x", raw, a.v, a.off, b.v, b.off)], GAP), both, links, K).first()
    assert got.path == g[:900] and got.second < got.score


def test_colors_close_the_other_way(spark):
    g = drawn(200, 6)
    other = worn(g, {100})
    both, links, at = graph_of(spark, [g, other])
    raw = other[50:150]
    a, b = at[raw[:K]], at[raw[-K:]]
    gap = spark.createDataFrame([("x", "x", raw, a.v, a.off, b.v, b.off)], GAP)
    assert walks.walk(gap, both, links, K).first().path == raw
    own = {at[g[i : i + K]].unitig_id for i in range(186)}
    pairs = spark.createDataFrame([(u, c) for u in own for c in (1, 2)] + [(at[other[90 : 90 + K]].unitig_id, 2)], "unitig_id long, color long").distinct()
    chosen = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "gap string, color long")
    assert walks.walk(gap, both, links, K, (chosen, pairs, 2)).first().path == g[50:150]
    assert walks.walk(gap, both, links, K, (chosen, pairs, 1)).first().path == raw
    assert walks.walk(gap, both, links, K, (chosen.where("color = 1"), pairs, 2)).count() == 0


def parts(spark, g, raw, start, stop, weak, at):
    """A gap of raw from start to stop, and weak anchors at places of g."""
    a, b = at[g[start : start + K]], at[g[stop : stop + K]]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    ra, rb = at[rc(g[start : start + K])], at[rc(g[stop : stop + K])]
    row = ("x", raw[start : stop + K], None, a.v, a.off, b.v, b.off, g[start : start + K], rb.v, rb.off, ra.v, ra.off, rc(g[stop : stop + K]))
    gaps = spark.createDataFrame([row], "gap string, raw string, raw_qual string, u long, off int, w long, w_off int, kmer string, r_u long, r_off int, r_w long, r_w_off int, r_kmer string")
    rows = []
    for p in weak:
        x, y = at[g[p : p + K]], at[rc(g[p : p + K])]
        rows.append(("x", p - start, g[p : p + K], x.v, x.off, y.v, y.off))
    return gaps, spark.createDataFrame(rows, "gap string, at int, kmer string, v long, off int, rv long, roff int")


def test_a_gap_without_whole_path_is_corrected_in_part(spark):
    g = drawn(600, 3)
    both, links, at = graph_of(spark, [g[:270], g[290:]])  # nothing leads from 270 to 290
    raw = g[:40] + worn(g[40:500], set(range(5, 450, 13))) + g[500:]
    gaps, weak = parts(spark, g, raw, 20, 500, [25, 100, 110, 200, 250, 330, 420, 480], at)
    one = guided.attempt(gaps, weak, both, links, None, K, 1000).first()
    # hops 20, 100, 200, 250, 330: the last has no path; 330 is also the first anchor beyond what the chain reached
    want = g[20:265] + raw[265:330] + g[330:515]
    assert one.seq == want and [tuple(r) for r in one.runs] == [(0, 245), (310, 495)] and not one.complete and len(one.qual) == len(one.seq)
    assert set(one.qual[245:310]) == {"!"} and one.qual[:K] == "I" * K
    # the other way 480, 420 and 330 are reached, and 250 is the first one beyond
    assert guided.corrected_gaps(gaps, weak, both, links, None, K, 1000).first().seq == want
    far = guided.attempt(gaps, weak, both, links, None, K, 60).first()  # no hop is so short: the anchor alone stands
    assert far.seq == raw[20:515] and [tuple(r) for r in far.runs] == [(0, K)]


def test_a_whole_path_is_complete(spark):
    g = drawn(300, 3)
    both, links, at = graph_of(spark, [g])
    raw = g[:40] + worn(g[40:200], set(range(3, 160, 9))) + g[200:]
    gaps, weak = parts(spark, g, raw, 20, 220, [100], at)
    one = guided.attempt(gaps, weak, both, links, None, K, 1000).first()
    assert one.complete and one.seq == g[20:235] and [tuple(r) for r in one.runs] == [(0, 215)]
    assert guided.attempt(gaps.limit(0), weak, both, links, None, K, 1000).count() == 0
    open_end = gaps.withColumns({"w": F.lit(None).cast("long"), "w_off": F.lit(None).cast("int")})
    tail = guided.attempt(open_end, weak.limit(0), both, links, None, K, 1000).first()
    assert tail.complete and tail.seq[:200] == g[20:220]


def plain_choice(rows, most, least):
    sets, sides, plain = {}, {}, set()
    for v, side, branching, c in rows:
        sets.setdefault(v, set()).add(c)
        sides.setdefault(c, set()).add(side)
        if not branching:
            plain.add(c)
    order = sorted((v for v in sets if len(sets[v]) >= least), key=lambda v: (len(sets[v]), v))
    chosen, left = set(), {v: min(most, len(sets[v])) for v in order}
    for tier in range(6):
        now = {c for c in sides if (c in plain) == (tier < 3) and len(sides[c]) == 3 - tier % 3}
        for v in order:
            if left[v] and sets[v] & now:
                cap = min(most, len(sets[v]))
                left[v] = cap - min(cap, len(sets[v] & chosen))
                take = set(sorted(sets[v] & now)[: left[v]])
                chosen |= take
                now -= take
                left[v] -= min(left[v], len(take))
        if not any(left.values()):
            break
    return sorted(chosen), sorted(chosen & plain)


@pytest.mark.parametrize("most", [3, 30])
def test_chosen_colors_against_plain_version(spark, most):
    rng = random.Random(most)
    rows = [(g, v, rng.choice(["left", "right", "inner"]), v % 3 == 0, c) for g in range(12) for v in range(8) for c in rng.sample(range(25), rng.choice([1, 2, 6, 12]))]
    df = spark.createDataFrame(rows, "gap long, vertex long, side string, branching boolean, color long")
    got = {r.gap: (r.colors, r.weighted) for r in regions.choose_colors(df, ["gap"], most).collect()}
    assert got == {g: plain_choice([r[1:] for r in rows if r[0] == g], most, 2) for g in range(12)}


@pytest.mark.parametrize("most", [2, 5, 30])
def test_colors_of_crowded_vertices_against_plain_version(spark, most):
    rng = random.Random(most)
    pairs = sorted({(rng.randrange(7), c) for c in range(300) for _ in range(rng.choice([1, 1, 2, 3, 5]))} | {(7, 5), (8, 900)})
    marks = sorted({(g, rng.randrange(9), rng.choice(["left", "right", "inner"])) for g in range(40) for _ in range(rng.choice([1, 2, 4, 8]))} | {(40, 11, "left")})
    found = spark.createDataFrame([(*m, m[1] % 3 == 0) for m in marks], "gap long, vertex long, side string, branching boolean")
    got = {r.gap: (r.colors, r.weighted, r.weight) for r in regions.choose_colors_of(found, spark.createDataFrame(pairs, "vertex long, color long"), "gap", most).collect()}
    each = found.join(spark.createDataFrame(pairs, "vertex long, color long"), "vertex")
    want = {r.gap: (r.colors, r.weighted, r.weight) for r in regions.choose_colors(each, ["gap"], most).collect()}
    assert got == want and 40 not in got
    rows = [(g, v, side, v % 3 == 0, c) for g, v, side in marks for w, c in pairs if w == v]
    assert all(got[g][:2] == plain_choice([r[1:] for r in rows if r[0] == g], most, 2) for g in got)


def test_settled_letters_in_rounds(spark):
    g = drawn(80, 7)
    df = spark.createDataFrame([(1, g)], "id long, seq string")
    nodes = graph.oriented(kmers.solid(kmers.kmers(df, 9, []), 1)).withColumnRenamed("v", "kmer")
    mixed = g[:20] + "N" + g[21:40] + "NN" + g[42:60] + "N" * 9 + g[69:]
    reads = spark.createDataFrame([(1, mixed, "x"), (2, None, "y"), (3, "NNN", "z"), (4, g[:30], "w")], "id long, seq string, other string")
    got = {r.id: (r.seq, r.other) for r in graph.settled(reads, nodes, 9, "id").collect()}
    assert got == {1: (g[:60] + "N" * 9 + g[69:], "x"), 2: (None, "y"), 3: ("NNN", "z"), 4: (g[:30], "w")}


def test_valid_candidates_need_both_ways(spark):
    readings = spark.createDataFrame([(t * 2 + f, t, bool(f)) for t in range(5) for f in (0, 1)], "v long, unitig_id long, fwd boolean")
    # 1 and 2 both lie between 0 and 3; 4 is reached one way only
    ahead = [(0, 1), (0, 2), (1, 3), (2, 3), (1, 4)]
    links = spark.createDataFrame([(a * 2 + 1, b * 2 + 1) for a, b in ahead] + [(b * 2, a * 2) for a, b in ahead], "u long, v long")
    pairs = spark.createDataFrame([(t, c) for t, cs in {0: [1, 2, 3, 4], 3: [1, 2, 3, 4], 1: [1, 2], 2: [3, 4], 4: [1, 2, 8]}.items() for c in cs], "unitig_id long, color long")
    candidates = spark.createDataFrame([(1, 2), (1, 4), (2, 1)], "a long, b long")
    got = sorted(tuple(r) for r in graph.valid_candidates(candidates, links, readings, pairs).collect())
    assert got == [(1, 2), (1, 4), (2, 1)]
    assert graph.valid_candidates(candidates, links.where("u != 0 and v != 0"), readings, pairs).count() == 0
    assert graph.valid_candidates(candidates.limit(0), links, readings, pairs).count() == 0
