"""Registered queries of single steps: column functions, alignment, colours, phasing, seeds of long reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import align, dna
from graphloom.operators import colors, correction, graph, kmers, ordering, packed, phasing, regions
from graphloom.plans.queries import _IN_REFERENCE, _NOISY, ENC, K, RC, _called, _in_reference, _noisy_reads, query, reads, sql_kmers, table
from graphloom.sources import fastx


def each_letter(expr: str, text: str) -> str:
    """SQL of a list: ``expr`` of c for each letter of a column."""
    return f"[{expr} for c in string_split({text}, '')]"


@query(f"SELECT p_partkey, array_to_string({each_letter('chr(least(greatest(ascii(c), 33), 73))', 'p_name')}, '') AS qual, round(list_avg({each_letter('least((ascii(c) - 33) / 40.0, 1.0)', 'p_name')}), 6) AS mean FROM part")
def base_quality_strings(spark, sf):
    """Names as quality strings: brought between 33 and 73, and their mean score."""
    return table(spark, sf, "part").select("p_partkey", dna.clamp_qual(F.col("p_name"), 40).alias("qual"), F.round(dna.mean_qual(F.col("p_name"), 0, 40), 6).alias("mean"))


@query("SELECT p_partkey, coalesce(list_bool_and([substr(upper(p_name), i, 1) NOT IN ('A', 'C', 'G', 'T') OR ascii(substr(reverse(p_name), i, 1)) >= 105 for i in generate_series(1, length(p_name))]), true) AS reached FROM part")
def bases_of_quality(spark, sf):
    """Whether all plain bases of a name have a quality of 105, its reverse standing for the qualities."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", dna.all_bases_reach(F.upper("p_name"), F.reverse("p_name"), 105).alias("reached"))


@query("SELECT o_custkey, coalesce(count(*) FILTER (WHERE o_orderstatus = 'P') = 0 OR bool_or(o_orderstatus = 'P' AND o_orderkey % 3 = o_custkey % 3), true) AS valid FROM orders GROUP BY o_custkey")
def haplotype_validity(spark, sf):
    """Whether a read's haplotype is among a vertex's, or the vertex has none."""
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 3)).alias("haps"))
    return sets.select("o_custkey", dna.valid_haplotype(F.col("haps"), F.col("o_custkey") % 3).alias("valid"))


@query("SELECT 'c' || conv_id || '/' || turn AS name FROM conversations WHERE turn IN (1, 2)")
def mate_suffixes(spark, sf):
    """Names that end in /1 or /2, which the reader warns of."""
    return fastx.suffixed_names(table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("name")))


@query("SELECT p_partkey, length(regexp_replace(upper(p_name), '[ACGT]', '', 'g')) AS n_drawn, true AS plain FROM part")
def plain_base_draws(spark, sf):
    """Letters that were drawn as others than plain bases were there, and that none of these is left."""
    p = table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("s"), dna.plain_bases(F.col("p_name"), F.col("p_partkey")).alias("d"))
    changed = F.filter(F.zip_with(F.split("s", ""), F.split("d", ""), lambda a, b: a != b), lambda x: x)
    return p.select("p_partkey", F.size(changed).cast("long").alias("n_drawn"), F.col("d").rlike("^[ACGT]*$").alias("plain"))


@query("SELECT conv_id, turn, min(conv_id * 1000 + turn) OVER (PARTITION BY role || turn % 5) AS color FROM conversations")
def read_numbers(spark, sf):
    """A number for each name by its first place, shared by all reads of the name."""
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", (F.col("turn") % 5).cast("string")).alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return colors.read_ids(r, "name", "ord").select("conv_id", "turn", "color")


@query(f"""WITH s AS (SELECT conv_id, turn, {ENC.format('text')} AS seq FROM conversations)
SELECT conv_id, turn, md5(array_to_string([CASE WHEN (ascii(substr(seq, i, 1)) + (i - 1) * 7) % 23 = 0 THEN 'N' ELSE substr(seq, i, 1) END for i in generate_series(1, length(seq))], '')) AS seq FROM s""")
def masked_bases(spark, sf):
    """Reads whose bases under a quality of 10 became N."""
    return correction.masked(_called(spark, sf), dna.QUAL_BASE + 10).select("conv_id", "turn", F.md5("seq").alias("seq"))


@query("SELECT l_partkey AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS cov_phased, count(*) FILTER (WHERE l_returnflag != 'R') AS cov_unphased FROM lineitem GROUP BY l_partkey")
def vertex_coverage(spark, sf):
    """Visits of a vertex by phased and by unphased reads."""
    hits = table(spark, sf, "lineitem").withColumn("v", F.col("l_partkey"))
    return colors.coverage(hits, "v", F.col("l_returnflag") == "R")


_VS = "vs AS (SELECT v, list_sort(list(color)) AS c FROM (SELECT DISTINCT l_partkey AS v, l_suppkey % 40 AS color FROM lineitem) GROUP BY v)"


@query(f"WITH {_VS}, b AS (SELECT x.v, list_sort(list_intersect(x.c, y.c)) AS same FROM vs x JOIN vs y ON y.v = x.v + 1) SELECT v, len(same) >= 3 AS enough, array_to_string(same[1:3], ',') AS least, list_contains(same, 7) AS has_seven FROM b")
def least_common_colors(spark, sf):
    """Of neighbouring vertices: whether they share three colours, and the least three of these."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), (F.col("l_suppkey") % 40).alias("color"))
    sets = colors.color_sets(pairs, "v", "color")
    both = sets.select("v", F.col("colors").alias("a")).join(sets.select((F.col("v") - 1).alias("v"), F.col("colors").alias("b")), "v")
    a, b = F.col("a"), F.col("b")
    return both.select("v", colors.shares_at_least(a, b, 3).alias("enough"), F.array_join(colors.first_common(a, b, 3), ",").alias("least"), F.array_contains(colors.common(a, b), F.lit(7).cast("long")).alias("has_seven"))


@query("SELECT l_orderkey, p_partkey AS anchor FROM (SELECT l_orderkey, p_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_size DESC, p_partkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE k = 1")
def anchor_vertices(spark, sf):
    """The longest vertex that a read meets."""
    hits = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return colors.anchor_vertex(hits, "l_orderkey", "p_partkey", "p_size")


@query("""WITH vc AS (SELECT DISTINCT l_partkey AS v, l_suppkey AS color FROM lineitem), l AS (SELECT p_partkey AS u, p_partkey + 1 AS v FROM part WHERE p_partkey % 4 != 0),
s AS (SELECT u, l.v, count(*) AS n FROM l JOIN vc a ON a.v = u JOIN vc b ON b.v = l.v AND a.color = b.color GROUP BY u, l.v),
w AS (SELECT u, v FROM l LEFT JOIN s USING (u, v) WHERE coalesce(n, 0) < 2 AND u % 3 != 0)
SELECT v, CAST(2 * count(*) AS BIGINT) AS n FROM (SELECT u AS v FROM w UNION ALL SELECT v FROM w) GROUP BY v""")
def synthetic_colors(spark, sf):
    """Colours given to both ends of links with fewer than two shared ones that stand side by side in a longer graph."""
    links = table(spark, sf, "part").where("p_partkey % 4 != 0").select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"))
    pairs = colors.colored(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("color")), "v", "color")
    weak = colors.supported(links, pairs, "color").where("not supported").select("u", "v")
    return colors.synthetic_links(weak, links.where("u % 3 != 0")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT s_suppkey, s_nationkey % 2 AS hap_id FROM supplier WHERE s_nationkey % 3 != 0), n AS (SELECT l_partkey AS v, hap_id, count(*) AS cov FROM lineitem JOIN h ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT v, hap_id, cov FROM (SELECT *, sum(cov) OVER (PARTITION BY v) AS total FROM n) WHERE total >= 4""")
def vertex_haplotypes(spark, sf):
    """Haplotypes of the reads that visit a vertex, where phased visits reach four."""
    haps = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 2).alias("hap_id"), (F.col("s_nationkey") % 3 != 0).alias("phased"))
    hits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("s_suppkey"))
    return phasing.vertex_haplotypes(hits, haps, "v", "s_suppkey", 4)


@query("""WITH h AS (SELECT o_custkey AS read, o_orderkey AS pos, list_distinct([o_orderkey % 3, o_orderkey % 5, o_orderkey % 7]) AS c FROM orders),
p AS (SELECT a.read, a.pos, max(CASE WHEN abs(a.pos - b.pos) > 2000 AND len(list_intersect(a.c, b.c)) >= 0.85 * len(a.c) AND len(list_intersect(a.c, b.c)) >= 0.85 * len(b.c) THEN 1 ELSE 0 END) AS fits FROM h a JOIN h b ON a.read = b.read GROUP BY a.read, a.pos)
SELECT read, pos FROM p WHERE fits = 0 AND (EXISTS (SELECT 1 FROM p q WHERE q.read = p.read AND q.pos > p.pos + 2000) OR EXISTS (SELECT 1 FROM p q WHERE q.read = p.read AND q.pos < p.pos - 2000 AND q.fits = 1))""")
def phase_conflicts(spark, sf):
    """Places of a read with no place of fitting colours far along it."""
    key = F.col("o_orderkey")
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("read"), key.alias("pos"), F.array_distinct(F.array(key % 3, key % 5, key % 7)).alias("colors"))
    return phasing.incompatible(hits, "read", 2000)


def _placed(spark, sf, n: int, step: int) -> DataFrame:
    """Orders as hits: places of a customer by order, some left out, on one of n vertices that change every few places."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("read"), "o_orderkey", place.alias("pos"))
    return rows.where("(pos + read) % 11 != 4").select("read", "pos", (F.floor((F.col("pos") + F.col("read") % 3) / step) * 5 % n).cast("long").alias("unitig_id"))


_PLACED = """h AS (SELECT read, pos, (pos + read % 3) // {step} * 5 % {n} AS unitig_id FROM (SELECT o_custkey AS read, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE (pos + read) % 11 != 4),"""


@query(f"""WITH {_PLACED.format(n=7, step=4)}
b AS (SELECT *, CASE WHEN pos != lag(pos) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS (PARTITION BY read ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY read ORDER BY pos) AS run FROM b), e AS (SELECT read, run, min(pos) AS a, max(pos) AS b FROM r GROUP BY read, run),
x AS (SELECT read, run, lead(a) OVER (PARTITION BY read ORDER BY run) AS following FROM e)
SELECT r.read, CAST(pos AS INT) AS pos, CAST(unitig_id AS BIGINT) AS unitig_id FROM r JOIN x ON x.read = r.read AND x.run = r.run WHERE following IS NULL OR pos + 3 <= following""")
def overlaps_voided(spark, sf):
    """Hits without the tails that the next run overlaps by three places."""
    return regions.without_overlaps(_placed(spark, sf, 7, 4), "read", 3)


@query(f"""WITH {_PLACED.format(n=9, step=3)} vc AS (SELECT DISTINCT o_orderkey % 9 AS v, o_custkey % 13 AS color FROM orders WHERE (o_orderkey * 3 + o_custkey) % 10 < 2 AND o_orderkey % 9 != o_custkey % 4),
l AS (SELECT a.range AS u, b.range AS v FROM range(9) a, range(9) b WHERE (2 * a.range + b.range) % 4 != 1),
s AS (SELECT u, l.v, count(*) AS n FROM l JOIN vc x ON x.v = l.u JOIN vc y ON y.v = l.v AND x.color = y.color GROUP BY u, l.v HAVING count(*) >= 6),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY read ORDER BY pos) AS run FROM (SELECT *, CASE WHEN unitig_id != lag(unitig_id) OVER (PARTITION BY read ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM h)),
e AS (SELECT read, run, any_value(unitig_id) AS u, min(pos) AS a, max(pos) AS b FROM r GROUP BY read, run),
t AS (SELECT read, run, u, b, lead(u) OVER w AS v, lead(a) OVER w AS following FROM e WINDOW w AS (PARTITION BY read ORDER BY run)),
g AS (SELECT read, run FROM t WHERE following = b + 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.u = t.u AND s.v = t.v))
SELECT read, CAST(pos AS INT) AS pos, CAST(unitig_id AS BIGINT) AS unitig_id FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.read = r.read AND r.run - g.run IN (0, 1))""")
def supported_steps(spark, sf):
    """Hits whose step to the next vertex is a link with six shared colours."""
    o = table(spark, sf, "orders").where("(o_orderkey * 3 + o_custkey) % 10 < 2 and o_orderkey % 9 != o_custkey % 4")
    pairs = o.select((F.col("o_orderkey") % 9).alias("v"), (F.col("o_custkey") % 13).alias("color")).distinct()
    links = spark.range(9).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("v")).where("(2 * u + v) % 4 != 1")
    return regions.color_consistent(_placed(spark, sf, 9, 3), pairs, links, "read", 6)


@query("""WITH RECURSIVE l AS (SELECT DISTINCT n_nationkey AS u, (n_nationkey * m + 1) % 25 AS v FROM nation, (SELECT unnest([2, 3, 7]) AS m)),
w AS (SELECT u AS start, v AS last, [v] AS path FROM l UNION ALL SELECT start, l.v, list_append(path, l.v) FROM w JOIN l ON l.u = last WHERE last != start AND len(path) < 4 AND NOT list_contains(path, l.v))
SELECT start, array_to_string(path, '-') AS path FROM w WHERE start = last""")
def vertex_cycles(spark, sf):
    """Simple cycles of up to four links on a small graph."""
    u = F.col("n_nationkey")
    links = table(spark, sf, "nation").select(u.alias("u"), F.explode(F.array(*((u * m + 1) % 25 for m in (2, 3, 7)))).alias("v")).distinct()
    return graph.short_cycles(links, 4).select("start", F.array_join("path", "-").alias("path"))


@query("""WITH s AS (SELECT p_partkey % 200 AS v, CAST(p_size AS INT) AS pos, CAST(bit_or(1 << CAST(p_partkey % 4 AS INT)) AS INT) AS bases FROM part GROUP BY 1, 2),
m AS (SELECT o_orderkey, o_custkey % 200 AS v, CAST(o_orderkey % 20 AS INT) AS start, CAST(o_orderkey % 20 + 15 AS INT) AS stop, o_orderkey % 2 = 0 AS strand FROM orders)
SELECT o_orderkey, CASE WHEN strand THEN pos - start ELSE stop - 1 - pos END AS pos, CASE WHEN strand THEN bases ELSE ((bases & 1) << 3) | ((bases & 2) << 1) | ((bases & 4) >> 1) | ((bases & 8) >> 3) END AS bases FROM m JOIN s ON s.v = m.v AND pos >= start AND pos < stop""")
def mapped_snps(spark, sf):
    """Ambiguous places of a vertex along mappings to it, mirrored on the other strand."""
    part, o = table(spark, sf, "part"), F.col("o_orderkey")
    snps = part.groupBy((F.col("p_partkey") % 200).alias("v"), F.col("p_size").cast("int").alias("pos")).agg(F.bit_or(F.expr("shiftleft(1, int(p_partkey % 4))")).alias("bases"))
    maps = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("v"), (o % 20).cast("int").alias("start"), (o % 20 + 15).cast("int").alias("stop"), (o % 2 == 0).alias("strand"))
    return graph.mapped_ambiguity(snps, maps, "v").select("o_orderkey", "pos", "bases")


@query("""WITH s AS (SELECT p_partkey % 200 AS v, CAST(p_size AS INT) AS pos, CAST(bit_or(1 << CAST(p_partkey % 4 AS INT)) AS INT) AS bases FROM part GROUP BY 1, 2),
t AS (SELECT l_orderkey, l_partkey % 200 AS v, CAST(l_linenumber * 20 AS INT) AS "offset" FROM lineitem)
SELECT l_orderkey, "offset" + pos AS pos, CAST(bit_or(bases) AS INT) AS bases FROM t JOIN s USING (v) WHERE "offset" + pos >= 31 AND "offset" + pos < 160 - 31 GROUP BY 1, 2""")
def path_snps(spark, sf):
    """Ambiguous places along paths of overlapping vertices, but for 31 bases at both ends."""
    part = table(spark, sf, "part")
    snps = part.groupBy((F.col("p_partkey") % 200).alias("v"), F.col("p_size").cast("int").alias("pos")).agg(F.bit_or(F.expr("shiftleft(1, int(p_partkey % 4))")).alias("bases"))
    steps = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("v"), (F.col("l_linenumber") * 20).cast("int").alias("offset"), F.lit(160).alias("length"))
    return graph.path_ambiguity(steps, F.broadcast(snps), "l_orderkey", "v", "length", 31)  # 200 vertices of 50 places at most


@query(f"WITH {_IN_REFERENCE}, d AS (SELECT p_partkey, j, levenshtein(seq, substr(reference, 1, j)) AS n FROM (SELECT *, unnest(generate_series(0, length(reference))) AS j FROM c)), m AS (SELECT p_partkey, min(n) AS least FROM d GROUP BY p_partkey) SELECT p_partkey, CAST(least AS INT) AS dist, string_agg(CAST(j - 1 AS VARCHAR), ',' ORDER BY j) AS ends FROM d JOIN m USING (p_partkey) WHERE n = least GROUP BY 1, 2")
def prefix_alignments(spark, sf):
    """Distances of names to starts of a reference, and all ends of the best ones."""
    x = align.distance(F.col("seq"), F.col("reference"), "SHW")
    return _in_reference(spark, sf).where("length(seq) > 0").select("p_partkey", x.alias("x")).select("p_partkey", "x.dist", F.array_join("x.ends", ",").alias("ends"))


@query(f"WITH {_IN_REFERENCE}, d AS (SELECT p_partkey, j, min(levenshtein(seq, substr(reference, i, j - i + 1))) AS n FROM (SELECT *, unnest(generate_series(1, j + 1)) AS i FROM (SELECT *, unnest(generate_series(0, length(reference))) AS j FROM c)) GROUP BY p_partkey, j), m AS (SELECT p_partkey, min(n) AS least FROM d GROUP BY p_partkey) SELECT p_partkey, CAST(least AS INT) AS dist, string_agg(CAST(j - 1 AS VARCHAR), ',' ORDER BY j) AS ends FROM d JOIN m USING (p_partkey) WHERE n = least GROUP BY 1, 2")
def infix_alignments(spark, sf):
    """Distances of names to any part of a reference, and all ends of the best ones."""
    x = align.distance(F.col("seq"), F.col("reference"), "HW")
    return _in_reference(spark, sf).where("length(seq) > 0").select("p_partkey", x.alias("x")).select("p_partkey", "x.dist", F.array_join("x.ends", ",").alias("ends"))


@query(f"WITH s AS (SELECT conv_id * 1000 + turn AS ord, 'c' || conv_id AS name, {ENC.format('text')} AS seq FROM conversations) SELECT ord, name, length(seq) AS n_raw, md5({RC.format('seq')}) AS seq FROM s")
def raw_and_corrected(spark, sf):
    """Raw reads beside corrected ones of the same place; only the first letter of their names may differ."""
    r = reads(spark, sf, "conversations", ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "conv_id", "seq")
    raw = r.withColumn("name", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    other = r.select("ord", F.concat(F.lit("@"), F.col("conv_id").cast("string")).alias("name"), dna.revcomp(F.col("seq")).alias("seq"))
    return ordering.paired(raw, other).select("ord", "name", F.length("raw").cast("long").alias("n_raw"), F.md5("seq").alias("seq"))


@query(f"""WITH {sql_kmers()}, one AS (SELECT rep, min(doc_id) AS doc_id, CAST(min(pos) AS INT) AS dist, min(kmer) AS kmer FROM km GROUP BY rep HAVING count(*) = 1), {_NOISY},
a AS (SELECT item_id, CAST(lk.pos AS INT) AS start, one.doc_id, one.dist, one.kmer = lk.kmer AS strand FROM lk JOIN one USING (rep)),
n AS (SELECT *, lead(start) OVER w AS stop, lead(doc_id) OVER w AS doc2, lead(dist) OVER w AS dist2, lead(strand) OVER w AS strand2 FROM a WINDOW w AS (PARTITION BY item_id ORDER BY start)),
g AS (SELECT n.*, CASE WHEN strand THEN dist ELSE dist2 END AS x, CASE WHEN strand THEN dist2 ELSE dist END AS y, stop - start + {K} AS n_raw FROM n WHERE stop - start >= {K} AND doc_id = doc2 AND strand = strand2),
p AS (SELECT g.*, substr(s.seq, x + 1, y - x + {K}) AS piece FROM g JOIN s USING (doc_id) WHERE y > x)
SELECT item_id, start, stop, CASE WHEN strand THEN piece ELSE {RC.format('piece')} END AS path FROM p WHERE length(piece) >= n_raw * 0.75 AND length(piece) <= n_raw * 1.25""")
def same_vertex_paths(spark, sf):
    """Gaps of noisy long reads whose anchors lie on one document, at k-mers of one place, and the document between them."""
    long = _noisy_reads(spark, sf).withColumnRenamed("item_id", "read_id")
    one = packed.places(reads(spark, sf), long, K, "doc_id", 1)
    one = one.select("rep", F.col("key").alias("doc_id"), F.col("pos").alias("dist"), "fwd")
    own = kmers.kmers(long, K, ["read_id"]).select("read_id", "pos", "kmer", (F.col("kmer") == F.col("rep")).alias("own"), packed.packed(F.col("rep")).alias("rep"))
    found = graph.kept(own.join(one, "rep"))  # read for the gaps and for both ends
    at = found.select("read_id", "pos", "doc_id", "dist", (F.col("own") == F.col("fwd")).alias("strand"))
    gaps = correction.regions(found.select("read_id", "pos", "kmer"), long, K)
    side = lambda name, place: at.select("read_id", F.col("pos").alias(place), F.col("doc_id").alias(f"{name}_id"), F.col("dist").alias(f"{name}_dist"), F.col("strand").alias(f"{name}_strand"))
    known = gaps.join(side("left", "start"), ["read_id", "start"]).join(side("right", "stop"), ["read_id", "stop"])
    tigs = reads(spark, sf).select(F.col("doc_id").alias("unitig_id"), "seq", F.length("seq").alias("n_kmers"))
    return regions.same_unitig(known, tigs, K).select(F.col("read_id").alias("item_id"), "start", "stop", "path")
