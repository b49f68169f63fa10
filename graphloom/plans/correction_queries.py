"""Registered queries of the correction's steps: unitigs and walks on the graph of the benchmark items, seeds, hops and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, guided, kmers, regions, seeding, walks
from graphloom.plans.queries import ENC, RC, query, reads, table
from graphloom.plans.step_queries import _PLACED, _placed

KG = 11  # the graph of the benchmark items
WIDTH, STEP = 55, 40  # gaps in them
TILE, TILE_STEP = 60, 20  # and short reads

_TIGS = f"""s AS (SELECT item_id, {ENC.format('text')} AS seq FROM benchmark),
km AS (SELECT item_id, i - 1 AS pos, substr(seq, i, {KG}) AS kmer FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq) - {KG - 1})) AS i FROM s WHERE length(seq) >= {KG})),
n AS (SELECT kmer AS v FROM km UNION SELECT {RC.format('kmer')} FROM km),
l AS MATERIALIZED (SELECT a.v AS u, b.v FROM n a JOIN n b ON substr(a.v, 2) = substr(b.v, 1, {KG - 1})),
pl AS MATERIALIZED (SELECT u, v FROM (SELECT *, count(*) OVER (PARTITION BY u) AS o, count(*) OVER (PARTITION BY v) AS i FROM l) WHERE o = 1 AND i = 1 AND u != v AND v != {RC.format('u')}),
ch(start, v, i) AS (SELECT v, v, 0 FROM n WHERE v NOT IN (SELECT v FROM pl) UNION ALL SELECT start, pl.v, i + 1 FROM ch JOIN pl ON pl.u = ch.v),
en AS (SELECT start, arg_max(v, i) AS last, count(*) AS n_kmers, string_agg(CASE WHEN i = 0 THEN v ELSE right(v, 1) END, '' ORDER BY i) AS seq FROM ch GROUP BY start)"""


def _benchmark(spark, sf) -> DataFrame:
    return reads(spark, sf, "benchmark", "item_id")


def _tigs(spark, sf, k: int = KG):
    return graph.unitigs(kmers.solid(kmers.kmers(_benchmark(spark, sf), k, []), 1), k)


@query(f"WITH RECURSIVE {_TIGS} SELECT seq, CAST(n_kmers AS INT) AS n_kmers FROM en WHERE seq <= {RC.format('seq')}")
def benchmark_unitigs(spark, sf):
    """Unitigs of all k-mers of the benchmark items."""
    return _tigs(spark, sf)[0].select("seq", "n_kmers")


@query(f"WITH RECURSIVE {_TIGS} SELECT v AS kmer, least(seq, {RC.format('seq')}) AS seq, CAST(CASE WHEN seq <= {RC.format('seq')} THEN i ELSE n_kmers - 1 - i END AS INT) AS dist, seq <= {RC.format('seq')} AS strand FROM ch JOIN en USING (start)")
def kmer_places(spark, sf):
    """Each k-mer of the benchmark items, on both strands, with its unitig, place and strand."""
    tigs, index = _tigs(spark, sf)
    return index.join(tigs.select("unitig_id", "seq"), "unitig_id").select("kmer", "seq", F.col("dist").cast("int").alias("dist"), "strand")


@query(f"""WITH RECURSIVE {_TIGS}, k2 AS (SELECT DISTINCT v FROM (SELECT unnest([substr(seq, i, 9), {RC.format('substr(seq, i, 9)')}]) AS v FROM (SELECT seq, unnest(generate_series(1, length(seq) - 8)) AS i FROM en))),
l2 AS (SELECT a.v AS u, count(b.v) AS n FROM k2 a LEFT JOIN k2 b ON substr(a.v, 2) = substr(b.v, 1, 8) GROUP BY a.v)
SELECT n AS n_next, count(*) AS n_nodes, bit_xor(CAST(('0x' || substr(md5(u), 1, 15)) AS BIGINT)) AS all_nodes FROM l2 GROUP BY n""")
def inner_graph(spark, sf):
    """The graph of a lesser length made of the unitigs of a greater one: nodes by their next ones."""
    inner = kmers.solid(kmers.kmers(_tigs(spark, sf)[0].select("seq"), 9, []), 1)
    nodes = graph.kept(graph.oriented(inner))
    per = nodes.join(graph.edges(nodes, 9).groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "v"), "v", "left").na.fill(0, ["n"])
    return per.groupBy(F.col("n").alias("n_next")).agg(F.count(F.lit(1)).alias("n_nodes"), F.bit_xor(F.conv(F.substring(F.md5("v"), 1, 15), 16, 10).cast("long")).alias("all_nodes"))


_GAPS = f"""g AS MATERIALIZED (SELECT item_id || ':' || a AS gap, item_id, a, least_, most_, substr(raw, 1, {KG}) AS head, CASE WHEN a % 80 = 0 THEN right(raw, {KG}) END AS tail, substr(raw, 1, {WIDTH // 2}) || translate(substr(raw, {WIDTH // 2 + 1}, 1), 'ACGT', 'CGTA') || substr(raw, {WIDTH // 2 + 2}) AS raw
  FROM (SELECT item_id, a, substr(seq, a + 1, {WIDTH}) AS raw, {int((WIDTH - KG) * 0.75) + KG} AS least_, {int((WIDTH - KG) * 1.25) + KG} AS most_ FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - {WIDTH - 1}, 0), {STEP})) AS a FROM s)))"""
_BEST_PATH = """d AS (SELECT gap, path, 1 - levenshtein(path, raw) * 1.0 / greatest(length(path), length(raw)) AS score FROM w JOIN g USING (gap) WHERE length(path) >= least_ AND (tail IS NULL OR right(path, length(tail)) = tail)),
b AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY score DESC, length(path), path) AS k FROM d WHERE score >= 0.75)
SELECT gap, path, round(score, 6) AS score FROM b WHERE k = 1"""


def _gaps(spark, sf, index, tigs) -> DataFrame:
    """Stretches of the items, one base changed in the middle of each, between their first and last k-mers; every other one is open."""
    each = _benchmark(spark, sf).where(F.length("seq") >= WIDTH).select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - WIDTH, F.lit(STEP))).alias("a"))
    cut = each.select("item_id", "a", F.concat_ws(":", "item_id", "a").alias("gap"), F.expr(f"substring(seq, a + 1, {WIDTH})").alias("own"))
    half = WIDTH // 2
    raw = cut.withColumn("raw", F.concat(F.substring("own", 1, half), F.translate(F.substring("own", half + 1, 1), "ACGT", "CGTA"), F.substring("own", half + 2, WIDTH)))
    at = walks.placed(index, tigs).select("kmer", "v", "off")
    first = raw.withColumn("kmer", F.substring("raw", 1, KG)).join(at, "kmer").withColumnsRenamed({"v": "u", "kmer": "first"})
    tail = F.when(F.col("a") % 80 == 0, F.expr(f"right(raw, {KG})"))
    return first.withColumn("kmer", tail).join(at.withColumnsRenamed({"v": "w", "off": "w_off"}), "kmer", "left").withColumn("hop", F.col("gap"))


def _closest(found: DataFrame) -> DataFrame:
    return found.where("score >= 0.75").select(F.col("hop").alias("gap"), "path", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_TIGS}, {_GAPS},
w(gap, path) AS (SELECT gap, head FROM g UNION ALL SELECT w.gap, w.path || right(l.v, 1) FROM w JOIN g USING (gap) JOIN l ON l.u = right(w.path, {KG}) WHERE length(w.path) < most_),
{_BEST_PATH}""")
def graph_paths(spark, sf):
    """The path of the graph that is closest to each stretch of the items, to its right anchor or open."""
    tigs, index = _tigs(spark, sf)
    both = graph.kept(walks.sides(tigs))
    gaps = graph.kept(_gaps(spark, sf, index, tigs))
    return _closest(walks.walk(gaps, both, graph.kept(walks.steps(both, KG, 1000)), KG))


_GUIDED = f"""tile AS (SELECT item_id * 1000 + a AS color, substr(seq, a + 1, {TILE}) AS seq, item_id, a FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - {KG}, 1), {TILE_STEP})) AS a FROM s)),
name AS MATERIALIZED (SELECT start, v, i, least(start, {RC.format('last')}) AS tig FROM ch JOIN en USING (start)),
pair AS MATERIALIZED (SELECT DISTINCT tig, color FROM (SELECT color, substr(seq, i, {KG}) AS v FROM (SELECT color, seq, unnest(generate_series(1, length(seq) - {KG - 1})) AS i FROM tile WHERE length(seq) >= {KG})) JOIN name USING (v)),
sup AS (SELECT x.tig AS a, y.tig AS b FROM pair x JOIN pair y USING (color) GROUP BY x.tig, y.tig HAVING count(*) >= 2),
chosen AS (SELECT gap, color FROM g JOIN tile ON tile.item_id = g.item_id AND tile.a < g.a + {WIDTH} AND g.a < tile.a + {TILE}),
may AS MATERIALIZED (SELECT gap, tig FROM chosen JOIN pair USING (color) GROUP BY gap, tig HAVING count(*) >= 2),
lk AS MATERIALIZED (SELECT l.u, l.v, x.start = y.start AND y.i = x.i + 1 AS inside, y.tig AS tig FROM l JOIN name x ON x.v = l.u JOIN name y ON y.v = l.v LEFT JOIN sup ON sup.a = x.tig AND sup.b = y.tig WHERE (x.start = y.start AND y.i = x.i + 1) OR sup.a IS NOT NULL)"""


def _tiles(spark, sf) -> DataFrame:
    each = _benchmark(spark, sf).select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - KG, F.lit(1)) - 1, F.lit(TILE_STEP))).alias("a"))
    return each.select((F.col("item_id") * 1000 + F.col("a")).alias("color"), F.expr(f"substring(seq, a + 1, {TILE})").alias("seq"), "item_id", F.col("a").alias("tile"))


@query(f"""WITH RECURSIVE {_TIGS}, {_GAPS}, {_GUIDED},
w(gap, path) AS (SELECT gap, head FROM g UNION ALL SELECT w.gap, w.path || right(lk.v, 1) FROM w JOIN g USING (gap) JOIN lk ON lk.u = right(w.path, {KG}) LEFT JOIN may ON may.gap = w.gap AND may.tig = lk.tig WHERE length(w.path) < most_ AND (lk.inside OR may.gap IS NOT NULL)),
{_BEST_PATH}""")
def guided_paths(spark, sf):
    """The same along supported links and unitigs that carry two of a stretch's colours: those of the tiles that it meets."""
    tigs, index = _tigs(spark, sf)
    both, gaps, tiles = graph.kept(walks.sides(tigs)), graph.kept(_gaps(spark, sf, index, tigs)), graph.kept(_tiles(spark, sf))
    pairs = graph.kept(kmers.kmers(tiles, KG, ["color"]).join(index, "kmer").select("unitig_id", "color").distinct())
    links = graph.kept(walks.supported_steps(walks.steps(both, KG, 1000), both, pairs))
    chosen = gaps.select("gap", "item_id", "a").join(tiles, "item_id").where(f"tile < a + {WIDTH} and a < tile + {TILE}").select("gap", "color")
    return _closest(walks.walk(gaps, both, links, KG, (graph.kept(chosen), pairs, 2)))


@query("""WITH RECURSIVE g AS (SELECT o_custkey AS gap, max(200 + o_orderkey % 400) AS n FROM orders GROUP BY 1), w AS (SELECT DISTINCT o_custkey AS gap, o_orderkey * 7 % 400 AS p FROM orders),
nx AS (SELECT w.gap, w.p, min(v.p) AS q FROM (SELECT gap, p FROM w UNION SELECT gap, 0 FROM g) w JOIN w v ON v.gap = w.gap AND v.p >= w.p + 31 GROUP BY 1, 2),
h(gap, i, p) AS (SELECT gap, 0, CAST(0 AS BIGINT) FROM g UNION ALL SELECT h.gap, h.i + 1, q FROM h JOIN g ON g.gap = h.gap JOIN nx ON nx.gap = h.gap AND nx.p = h.p WHERE q < g.n - 62)
SELECT gap, i, CAST(p AS INT) AS "at", CAST(coalesce(lead(p) OVER (PARTITION BY gap ORDER BY i), n - 31) AS INT) AS "to" FROM h JOIN g USING (gap)""")
def anchor_hops(spark, sf):
    """Hops from weak anchor to weak anchor, at least k apart, to the end of each gap."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("gap"), "o_orderkey")
    none = F.lit(None).cast("long")
    gaps = o.groupBy("gap").agg(F.max(200 + F.col("o_orderkey") % 400).alias("n")).select("gap", F.expr("repeat('A', int(n))").alias("raw"), none.alias("w"), F.lit(None).cast("int").alias("w_off"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("off"), F.lit("A").alias("kmer"))
    weak = o.select("gap", (F.col("o_orderkey") * 7 % 400).cast("int").alias("at"), F.lit("A").alias("kmer"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("off")).distinct()
    return guided.chains(gaps, weak, 31).select("gap", "i", "at", "to")


_STANDS = f"""{_PLACED.format(n=9, step=2)} so AS (SELECT * FROM h WHERE (pos * 3 + read) % 5 < 3), we AS (SELECT * FROM h WHERE (pos * 3 + read) % 5 >= 3),
nx AS (SELECT read, pos, lead(pos) OVER w AS n, lag(pos) OVER w AS b, max(pos) OVER (PARTITION BY read) AS m FROM so WINDOW w AS (PARTITION BY read ORDER BY pos)),
g AS (SELECT read, 'middle' AS kind, pos AS start, n AS stop FROM nx WHERE n > pos + 1 UNION ALL SELECT read, 'tail', pos, m + 5 FROM nx WHERE n IS NULL UNION ALL SELECT read, 'head', 0, pos FROM nx WHERE b IS NULL AND pos > 0),
st AS (SELECT v, (v * 5) % 7 AS cov, v % 2 = 0 AS branching FROM (SELECT unnest(range(9)) AS v)),
c AS (SELECT read || ':' || kind || ':' || start AS gap, side, unitig_id, min(r) AS r FROM (
  SELECT g.*, 'left' AS side, unitig_id, (NOT solid)::INT * 1000 + start - pos AS r FROM g JOIN x USING (read) WHERE kind != 'head' AND pos > start - 6 AND pos <= start
  UNION ALL SELECT g.*, 'right', unitig_id, (NOT solid)::INT * 1000 + pos - stop FROM g JOIN x USING (read) WHERE kind != 'tail' AND pos >= stop AND pos < stop + 6
  UNION ALL SELECT g.*, 'inner', unitig_id, 0 FROM g JOIN x USING (read) WHERE NOT solid AND pos >= start AND (pos < stop OR (kind = 'tail' AND pos <= stop))) GROUP BY 1, 2, 3),
ca AS (SELECT gap, side, unitig_id, branching FROM (SELECT *, row_number() OVER (PARTITION BY gap, side, branching ORDER BY r, unitig_id) AS k FROM c JOIN st ON v = unitig_id WHERE cov < 6) WHERE NOT branching OR side = 'inner' OR k <= 2)""".replace("c AS (SELECT read ||", "x AS (SELECT *, true AS solid FROM so UNION ALL SELECT *, false FROM we), c AS (SELECT read ||")


def _stands(spark, sf):
    """Places of customers as solid and weak anchors, the gaps between the solid ones, and vertices' coverage."""
    all_ = _placed(spark, sf, 9, 2).withColumnRenamed("read", "read_id")
    solid, weak = all_.where("(pos * 3 + read_id) % 5 < 3"), all_.where("(pos * 3 + read_id) % 5 >= 3")
    from pyspark.sql import Window

    order = Window.partitionBy("read_id").orderBy("pos")
    near = solid.select("read_id", "pos", F.lead("pos").over(order).alias("n"), F.lag("pos").over(order).alias("b"))
    gaps = near.where("n > pos + 1").selectExpr("read_id", "'middle' AS kind", "pos AS start", "n AS stop").union(near.where("n is null").selectExpr("read_id", "'tail'", "pos", "pos + 5")).union(near.where("b is null and pos > 0").selectExpr("read_id", "'head'", "0", "pos"))
    stats = spark.range(9).select(F.col("id").alias("unitig_id"), (F.col("id") * 5 % 7).alias("cov"), (F.col("id") % 2 == 0).alias("branching"))
    return gaps.withColumn("gap", F.concat_ws(":", "read_id", "kind", "start")), solid, weak, stats


@query(f"WITH {_STANDS} SELECT gap, side, unitig_id, branching FROM ca")
def color_candidates(spark, sf):
    """Vertices around and in gaps that may give colours: within six places, of little coverage, two branching ones a side."""
    gaps, solid, weak, stats = _stands(spark, sf)
    return guided.color_candidates(gaps, solid, weak, stats, 6, 6, 2)


@query()
def region_colors(spark, sf):
    """The colours chosen from them, by tiers of sides; colours are customers that share a vertex."""
    gaps, solid, weak, stats = _stands(spark, sf)
    pairs = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select((F.col("o_orderkey") % 9).alias("unitig_id"), F.col("o_custkey").alias("color")).distinct()
    found = guided.color_candidates(gaps, solid, weak, stats, 6, 6, 2).withColumnRenamed("unitig_id", "vertex")
    out = regions.choose_colors_of(found, pairs.withColumnRenamed("unitig_id", "vertex"), "gap")
    return out.select("gap", F.array_join("colors", ",").alias("colors"), F.size("weighted").alias("n_weighted"), F.round("weight", 6).alias("weight"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS gap, o_orderkey % 60 AS color FROM orders), p AS (SELECT DISTINCT p_partkey % 300 AS tig, (p_partkey + p_partkey // 300 * 11) % 60 AS color FROM part WHERE p_size < 25)
SELECT gap, tig, count(*) AS n FROM c JOIN p USING (color) GROUP BY 1, 2 HAVING count(*) >= 2""")
def allowed_vertices(spark, sf):
    """Vertices that carry two of a gap's colours, counted by readings."""
    chosen = table(spark, sf, "orders").select(F.col("o_custkey").alias("gap"), (F.col("o_orderkey") % 60).alias("color")).distinct()
    pairs = table(spark, sf, "part").where("p_size < 25").select((F.col("p_partkey") % 300).alias("unitig_id"), ((F.col("p_partkey") + F.floor(F.col("p_partkey") / 300) * 11) % 60).alias("color")).distinct()
    both = spark.range(300).select(F.col("id").alias("unitig_id"), F.col("id").alias("v"))
    # 300 vertices, 60 colours
    return walks.allowed(chosen, F.broadcast(both), F.broadcast(pairs)).select("gap", F.col("v").alias("tig"), "n")


INSERT = 100
_WORN = """CASE WHEN (i - 1) % 37 = 5 OR ((i - 1) % 400 BETWEEN 60 AND 110 AND (i - 1) % 10 = 2) OR ((i - 1) % 400 BETWEEN 150 AND 300 AND (i - 1) % 10 = 4) THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END"""


@query(f"""WITH s AS (SELECT item_id, {ENC.format('text')} AS seq FROM benchmark), km AS (SELECT item_id, substr(seq, i, {KG}) AS kmer FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq) - {KG - 1})) AS i FROM s)),
own AS (SELECT kmer, min(item_id) AS tig FROM km GROUP BY kmer),
ns AS (SELECT item_id, string_agg({_WORN}, '' ORDER BY i) AS seq FROM (SELECT item_id, seq || seq AS seq, unnest(generate_series(1, 2 * length(seq))) AS i FROM s) GROUP BY item_id),
h AS MATERIALIZED (SELECT item_id, pos, tig FROM (SELECT item_id, i - 1 AS pos, substr(seq, i, {KG}) AS kmer FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq) - {KG - 1})) AS i FROM ns)) JOIN own USING (kmer)),
q AS (SELECT item_id, lag(pos) OVER (PARTITION BY item_id ORDER BY pos) AS p, pos AS n FROM h),
p AS (SELECT tig, (tig * m) % 11 AS color FROM (SELECT DISTINCT tig FROM own WHERE tig % 4 != 1), (SELECT unnest([1, 3, 4]) AS m)),
m AS (SELECT * FROM q WHERE 2 * (n - p) >= {INSERT} AND n - p < {INSERT}),
t AS (SELECT DISTINCT m.item_id, m.p, 'l' AS side, color FROM m JOIN h ON h.item_id = m.item_id AND h.pos <= m.p AND h.pos > m.p - ({INSERT} - (m.n - m.p)) JOIN p ON p.tig = h.tig
  UNION SELECT m.item_id, m.p, 'r', color FROM m JOIN h ON h.item_id = m.item_id AND h.pos >= m.n AND h.pos < m.n + {INSERT} - (m.n - m.p) JOIN p ON p.tig = h.tig),
tied AS (SELECT item_id, p FROM (SELECT item_id, p, color FROM t GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL HAVING count(*) >= 2)
SELECT item_id, 'long' AS class, CAST(p + {KG} AS INT) AS start, CAST(n AS INT) AS stop FROM q WHERE n - p >= {INSERT}
UNION ALL SELECT m.item_id, 'middle', m.p + {KG}, m.n FROM m WHERE NOT EXISTS (SELECT 1 FROM tied WHERE tied.item_id = m.item_id AND tied.p = m.p)
UNION ALL SELECT item_id, 'head', 0, min(pos) + {KG - 1} FROM h GROUP BY item_id HAVING 2 * min(pos) >= {INSERT}
UNION ALL SELECT item_id, 'tail', max(pos) + 1, any_value(length(seq)) FROM h JOIN ns USING (item_id) GROUP BY item_id HAVING 2 * (any_value(length(seq)) - max(pos)) >= {INSERT}""")
def searched_gaps(spark, sf):
    """Stretches of worn items that are searched for inexact hits, by their size and by the colours on both sides."""
    items = _benchmark(spark, sf).select(F.col("item_id").alias("read_id"), "seq")
    own = kmers.kmers(items, KG, ["read_id"]).groupBy("kmer").agg(F.min("read_id").alias("unitig_id"))
    worn = F.transform(F.filter(F.split(F.concat("seq", "seq"), ""), lambda c: c != ""), lambda c, i: F.when((i % 37 == 5) | ((i % 400).between(60, 110) & (i % 10 == 2)) | ((i % 400).between(150, 300) & (i % 10 == 4)), F.translate(c, "ACGT", "CGTA")).otherwise(c))
    long = graph.kept(items.select("read_id", F.array_join(worn, "").alias("seq")))
    index = graph.kept(own.select("kmer", "unitig_id", F.lit(0).alias("dist"), F.lit(True).alias("strand")))
    hits = graph.kept(seeding.exact_hits(long, index, KG))
    tigs = index.where("unitig_id % 4 != 1").select("unitig_id").distinct()
    pairs = tigs.select("unitig_id", F.explode(F.array(*((F.col("unitig_id") * m) % 11 for m in (1, 3, 4)))).alias("color")).distinct()
    out = seeding.searched_stretches(seeding.gap_classes(hits, long, KG, INSERT), hits, pairs, INSERT)
    return out.select(F.col("read_id").alias("item_id"), "class", "start", "stop")


@query("""WITH RECURSIVE v AS (SELECT unnest(range(60)) AS v), p AS (SELECT DISTINCT l_partkey % 60 AS tig, l_orderkey % 83 AS color FROM lineitem WHERE (l_partkey * 7 + l_orderkey) % 41 < 2),
sh AS MATERIALIZED (SELECT x.tig AS a, y.tig AS b FROM p x JOIN p y USING (color) GROUP BY 1, 2 HAVING count(*) >= 7),
l AS MATERIALIZED (SELECT (a.v * 5 + m) % 60 AS x, true AS xf, a.v AS y, (a.v + m) % 3 > 0 AS yf FROM v a, (SELECT unnest([1, 7, 20]) AS m)), ll AS MATERIALIZED (SELECT * FROM l UNION SELECT y, NOT yf, x, NOT xf FROM l),
c AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM v a, v b WHERE (a.v * 3 + b.v) % 11 = 1 AND a.v != b.v),
w(a, fwd, x, xf) AS (SELECT DISTINCT a, f, a, f FROM c, (SELECT unnest([true, false]) AS f) UNION SELECT w.a, fwd, y, yf FROM w JOIN ll ON ll.x = w.x AND ll.xf = w.xf JOIN sh ON sh.a = w.a AND sh.b = y),
met AS (SELECT w.* FROM w WHERE NOT (w.x = w.a AND w.xf = w.fwd)),
ok AS (SELECT DISTINCT c.a, c.b, fwd FROM met JOIN c ON c.a = met.a JOIN sh ON sh.a = c.b AND sh.b = met.x)
SELECT a, b FROM ok GROUP BY a, b HAVING count(*) = 2""")
def valid_snps(spark, sf):
    """Pairs of vertices of a small graph of which one's reads are reached from the other both ways, among vertices that share its reads."""
    line = table(spark, sf, "lineitem").where("(l_partkey * 7 + l_orderkey) % 41 < 2")
    pairs = line.select((F.col("l_partkey") % 60).alias("unitig_id"), (F.col("l_orderkey") % 83).alias("color")).distinct()
    v = spark.range(60).select(F.col("id").alias("v"))
    m = v.select("v", F.explode(F.array(F.lit(1), F.lit(7), F.lit(20))).alias("m"))
    name = lambda tig, fwd: tig * 2 + fwd.cast("long")
    x, yf = (F.col("v") * 5 + F.col("m")) % 60, (F.col("v") + F.col("m")) % 3 > 0
    links = m.select(name(x, F.lit(True)).alias("u"), name(F.col("v"), yf).alias("v")).union(m.select(name(F.col("v"), ~yf), name(x, F.lit(False)))).distinct()
    readings = v.select(F.col("v").alias("unitig_id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd")).withColumn("v", name(F.col("unitig_id"), F.col("fwd")))
    ab = v.select(F.col("v").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("b")).where("(a * 3 + b) % 11 = 1 and a != b")
    return graph.valid_candidates(ab, links, readings, pairs, 7)


_MIXED = "CASE WHEN i % 29 = 7 THEN substr('MRWSYKVHDBN', CAST((i + item_id) % 11 AS INT) + 1, 1) ELSE substr(seq, i, 1) END"


@query(f"""WITH s AS (SELECT item_id, {ENC.format('text')} AS seq FROM benchmark), km AS (SELECT substr(seq, i, {KG}) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - {KG - 1})) AS i FROM s)),
n AS (SELECT kmer FROM km UNION SELECT {RC.format('kmer')} FROM km),
a AS (SELECT item_id, string_agg({_MIXED}, '' ORDER BY i) AS seq FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq))) AS i FROM s) GROUP BY item_id),
at AS (SELECT item_id, seq, i, substr(seq, i, 1) AS own, greatest(i - {KG - 1}, 1) AS low FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq))) AS i FROM a) WHERE substr(seq, i, 1) NOT IN ('A', 'C', 'G', 'T')),
t AS (SELECT item_id, i, b, substr(seq, low, i - low) || b || substr(seq, i + 1, {KG - 1}) AS text FROM at, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE (instr('.ACMGRSVTWYHKDBN', own) - 1) & (1 << (instr('ACGT', b) - 1)) != 0),
f AS (SELECT DISTINCT item_id, i, b FROM (SELECT item_id, i, b, substr(text, j, {KG}) AS kmer FROM (SELECT *, unnest(generate_series(1, length(text) - {KG - 1})) AS j FROM t)) JOIN n USING (kmer))
SELECT item_id, CAST(i - 1 AS INT) AS pos, min(b) AS base FROM f GROUP BY item_id, i HAVING count(*) = 1""".replace("at AS (", "amb AS (").replace("FROM at,", "FROM amb,"))
def settled_letters(spark, sf):
    """Ambiguous letters of the items that only one base of theirs gives a k-mer of the graph."""
    items = _benchmark(spark, sf)
    nodes = graph.kept(graph.oriented(kmers.solid(kmers.kmers(items, KG, []), 1)).withColumnRenamed("v", "kmer"))
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    mixed = F.transform(letters, lambda c, i: F.when((i + 1) % 29 == 7, F.substring(F.lit("MRWSYKVHDBN"), ((i + 1 + F.col("item_id")) % 11).cast("int") + 1, 1)).otherwise(c))
    return graph.settled_bases(items.select("item_id", F.array_join(mixed, "").alias("seq")), nodes, KG, "item_id")
