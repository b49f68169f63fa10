"""Registered queries of the read-correction operators, each with its SQL where SQL can say it.

The tables have no DNA: texts are encoded (functions.dna.encode_seq). documents play the short
reads, benchmark the long ones, pages the unmapped ones, conversations the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import align, dna
from graphloom.operators import colors, correction, graph, junctions, kmers, ordering, packed, phasing

K = 31
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ENC = "translate(upper(regexp_replace({0},'[^A-Za-z]','','g')),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC')"
RC = "reverse(translate({0},'ACGT','TGCA'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    df = table(spark, sf, name)
    keys = [key] if isinstance(key, str) else key
    # one small file is one split; the k-mer explode wants more
    return df.select(*keys, dna.encode_seq(F.col(text)).alias("seq")).repartition(spark.sparkContext.defaultParallelism, *keys)


def sql_kmers(name: str = "documents", key: str = "doc_id", k: int = K, text: str = "text") -> str:
    """CTEs s(key, seq) and km(key, pos, kmer, rep)."""
    return f"""s AS (SELECT {key}, {ENC.format(text)} AS seq FROM {name}),
km AS (SELECT *, least(kmer, {RC.format("kmer")}) AS rep FROM (
  SELECT {key}, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT {key}, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM s WHERE length(seq) >= {k})))"""


def doc_kmers(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return kmers.kmers(reads(spark, sf), k, ["doc_id"])


@query(f"WITH {sql_kmers()}, c AS (SELECT rep, count(*) AS n FROM km GROUP BY rep) SELECT rep, n FROM c WHERE n >= 20")
def kmer_counts(spark, sf):
    """Canonical k-mers found 20 times or more."""
    return packed.counts(reads(spark, sf), K, 20).select(packed.letters(F.col("rep"), K).alias("rep"), "n")


@query(f"WITH {sql_kmers()}, c AS (SELECT rep, count(*) AS n, count(DISTINCT doc_id) AS d FROM km GROUP BY rep) SELECT least(d, 20) AS n_docs, count(*) AS n_kmers, CAST(sum(n) AS BIGINT) AS n_found FROM c WHERE n >= 2 GROUP BY 1")
def solid_kmers(spark, sf):
    """Solid k-mers by the number of documents (20 and over together)."""
    per = packed.counts_by_reads(reads(spark, sf), K, "doc_id", 2)
    return per.groupBy(F.least("d", F.lit(20)).alias("n_docs")).agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("n").alias("n_found"))


@query(f"WITH {sql_kmers()}, c AS (SELECT rep, count(*) AS n FROM km GROUP BY rep) SELECT n, count(*) AS n_kmers FROM c GROUP BY n")
def kmer_spectrum(spark, sf):
    return packed.spectrum(reads(spark, sf), K)


@query(f"WITH {sql_kmers()}, c AS (SELECT rep, count(*) AS n FROM km GROUP BY rep) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS f0, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS f1 FROM c")
def distinct_kmers(spark, sf):
    per, n = packed.spectrum(reads(spark, sf), K), F.col("n_kmers")
    return per.agg(F.sum(F.col("n") * n).alias("total"), F.coalesce(F.sum(n), F.lit(0)).alias("f0"), F.sum(F.when(F.col("n") == 1, n).otherwise(0)).alias("f1"))


_P = "((length(seq) - length(replace(seq, '{0}', ''))) * 1.0 / length(seq))"
_H = " + ".join(f"CASE WHEN {_P.format(b)} > 0 THEN {_P.format(b)} * log2({_P.format(b)}) ELSE 0 END" for b in "ACGT")


@query(f"WITH s AS (SELECT doc_id, {ENC.format('text')} AS seq FROM documents) SELECT doc_id, round(CASE WHEN length(seq) > 0 THEN -({_H}) ELSE 0 END, 6) + 0.0 AS entropy FROM s")
def read_entropy(spark, sf):
    return reads(spark, sf).select("doc_id", (F.round(dna.entropy(F.col("seq")), 6) + 0.0).alias("entropy"))


@query(f"WITH s AS (SELECT doc_id, {ENC.format('text')} AS seq FROM documents) SELECT doc_id, md5({RC.format('seq')}) AS rc, CAST(length(seq) AS BIGINT) AS n FROM s")
def revcomp(spark, sf):
    return reads(spark, sf).select("doc_id", F.md5(dna.revcomp(F.col("seq"))).alias("rc"), F.length("seq").cast("long").alias("n"))


@query("SELECT p_partkey, substr('.ACMGRSVTWYHKDBN', CAST(p_size % 16 AS INT) + 1, 1) AS code, CAST(p_size % 16 AS BIGINT) AS bits, ((p_size % 16) & (p_partkey % 16)) != 0 AS overlap, substr('.ACMGRSVTWYHKDBN', CAST(((p_size % 16) | (p_partkey % 16)) AS INT) + 1, 1) AS either FROM part")
def iupac_codes(spark, sf):
    """Codes of 4-bit sets and back, overlap and union of two sets."""
    a, b = (F.col("p_size") % 16).cast("long"), F.col("p_partkey") % 16
    out = table(spark, sf, "part").select("p_partkey", dna.iupac_code(a).alias("code"), dna.iupac_overlap(a, b).alias("overlap"), dna.iupac_code(a.bitwiseOR(b)).alias("either"))
    return out.withColumn("bits", dna.iupac_bits(F.col("code")).cast("long"))


@query("SELECT event_id, chr(CAST(floor(least(abs(value) / 100, 1.0) * 40 + 33) AS INT)) AS q0, chr(CAST(floor(least(abs(value) / 100, 1.0) * 39 + 34) AS INT)) AS q1, round(least((CAST(floor(least(abs(value) / 100, 1.0) * 40 + 33) AS INT) - 33) / 40.0, 1.0), 6) AS score FROM events WHERE value IS NOT NULL")
def qual_from_score(spark, sf):
    s = F.abs("value") / 100
    out = table(spark, sf, "events").where("value is not null").select("event_id", dna.qual_char(s, 0, 40).alias("q0"), dna.qual_char(s, 1, 40).alias("q1"))
    return out.withColumn("score", F.round(dna.qual_score(F.col("q0"), 0, 40), 6))


@query("SELECT o_orderkey, greatest(CAST(trunc(n - n * 0.25) AS BIGINT), 1) AS low, greatest(CAST(trunc(n + n * 0.25) AS BIGINT), 1) AS high, CAST(floor(log2(n + 1)) AS BIGINT) AS log FROM (SELECT o_orderkey, o_custkey % 1000 AS n FROM orders)")
def length_window(spark, sf):
    n = F.col("n")
    low, high = dna.length_window(n, 0.25)
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("n")).select("o_orderkey", low.alias("low"), high.alias("high"), dna.floor_log2(n + 1).alias("log"))


def _called(spark, sf):
    """Conversations as reads with made qualities: 40, but for every place whose letter and number fall together."""
    r = reads(spark, sf, "conversations", ["conv_id", "turn"])
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    qual = F.transform(letters, lambda c, i: F.when((F.ascii(c) + i * 7) % 23 == 0, F.char(F.lit(33 + 5))).otherwise(F.char(F.lit(33 + 40))))
    return r.withColumn("qual", F.array_join(qual, "")).withColumn("name", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))


@query(f"""WITH s AS (SELECT conv_id, turn, {ENC.format('text')} AS seq FROM conversations),
p AS (SELECT conv_id, turn, seq, i FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM s WHERE length(seq) > 0) WHERE (ascii(substr(seq, i, 1)) + (i - 1) * 7) % 23 != 0),
r AS (SELECT conv_id, turn, any_value(seq) AS seq, min(i) AS a, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM p) GROUP BY conv_id, turn, run HAVING count(*) >= 15),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY a) AS part FROM r)
SELECT conv_id, turn, 'c' || conv_id || '.' || turn || '/' || part AS name, substr(seq, a, n) AS seq, CAST(part AS INT) AS part FROM n""")
def trim_split(spark, sf):
    return correction.trimmed(_called(spark, sf), ["conv_id", "turn"], 10, 15)


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank, count(*) OVER () AS n FROM orders) SELECT CAST((rank - 1) // greatest(n // 50, 1) AS BIGINT) AS chunk, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1")
def chunk_ntile(spark, sf):
    rows = ordering.chunked(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", [], 50)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT count(*) AS records, count(DISTINCT conv_id) AS names, CAST(sum(CASE WHEN turn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS mates FROM conversations")
def name_dedup(spark, sf):
    return table(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("conv_id").alias("names"), F.sum((F.col("turn") > 0).cast("long")).alias("mates"))


_SOLID = f"{sql_kmers()}, solid AS (SELECT rep, count(*) AS n FROM km GROUP BY rep HAVING count(*) >= 2), node AS (SELECT rep AS v FROM solid UNION SELECT {RC.format('rep')} FROM solid), edge AS (SELECT a.v AS u, b.v AS v FROM node a JOIN node b ON substr(a.v, 2) = substr(b.v, 1, {K - 1}))"


def _graph(spark, sf):
    nodes = graph.kept(graph.oriented(kmers.solid(doc_kmers(spark, sf))))  # read at both ends of a link
    return nodes, graph.edges(nodes, K)


@query(f"WITH {_SOLID} SELECT substr(v, {K}, 1) AS letter, count(*) AS n, count(DISTINCT u) AS sources FROM edge GROUP BY 1")
def edges(spark, sf):
    links = junctions.links(junctions.junctions(reads(spark, sf), K), K)
    n = links.groupBy(F.col("v").bitwiseAND(F.lit(3)).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.substring(F.lit("ACGT"), F.col("last").cast("int") + 1, F.lit(1)).alias("letter"), "n", F.col("n").alias("sources"))  # a k-mer has one link by a letter


@query(f"WITH {_SOLID}, i AS (SELECT v, count(*) AS n FROM edge GROUP BY v), o AS (SELECT u AS v, count(*) AS n FROM edge GROUP BY u) SELECT coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) > 1 OR coalesce(o.n, 0) > 1 AS branching, count(*) AS n FROM node LEFT JOIN i USING (v) LEFT JOIN o USING (v) GROUP BY 1, 2, 3")
def degree_branching(spark, sf):
    per = junctions.degrees(junctions.junctions(reads(spark, sf), K), K).groupBy("n_in", "n_out").agg(F.count(F.lit(1)).alias("n"))
    both = per.union(per.select("n_out", "n_in", "n")).select(*(F.col(c).cast("long").alias(c) for c in ("n_in", "n_out")), "n")
    return both.groupBy("n_in", "n_out", F.expr("n_in > 1 or n_out > 1").alias("branching")).agg(F.sum("n").alias("n"))


_LONG = sql_kmers("benchmark", "item_id").replace("s AS", "ls AS", 1).replace("km AS", "lk AS", 1).replace("FROM s ", "FROM ls ")


def _long(spark, sf):
    return reads(spark, sf, "benchmark", "item_id")


def _long_kmers(long):
    """Their k-mers by place, the canonical ones packed."""
    return kmers.kmers(long, K, ["item_id"]).withColumn("rep", packed.packed(F.col("rep")))


def _of_long(spark, sf, long):
    """(rep, n): k-mers of the long reads that the documents have, packed, and how often."""
    return packed.shared(reads(spark, sf), long, K).where("n > 0").select("rep", "n")


def _noisy_reads(spark, sf):
    """Benchmark items with every 37th base changed, from the sixth on."""
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    noisy = F.transform(letters, lambda c, i: F.when(i % 37 == 5, F.translate(c, "ACGT", "CGTA")).otherwise(c))
    return reads(spark, sf, "benchmark", "item_id").withColumn("seq", F.array_join(noisy, ""))


_NOISY = f"""ls0 AS (SELECT item_id, {ENC.format('text')} AS seq FROM benchmark),
ls AS (SELECT item_id, string_agg(CASE WHEN (i - 1) % 37 = 5 THEN translate(substr(seq, i, 1), 'ACGT', 'CGTA') ELSE substr(seq, i, 1) END, '' ORDER BY i) AS seq
  FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq))) AS i FROM ls0) GROUP BY item_id),
lk AS (SELECT *, least(kmer, {RC.format("kmer")}) AS rep FROM (
  SELECT item_id, i - 1 AS pos, substr(seq, i, {K}) AS kmer FROM (SELECT item_id, seq, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM ls WHERE length(seq) >= {K})))"""


@query(f"WITH {sql_kmers()}, c AS (SELECT rep, count(*) AS n FROM km GROUP BY rep), {_LONG} SELECT item_id, count(*) AS n_kmers, count(c.rep) AS n_hit, CAST(sum(CASE WHEN c.n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_solid FROM lk LEFT JOIN c USING (rep) GROUP BY item_id")
def read_kmer_hits(spark, sf):
    long = _long(spark, sf)
    found = _long_kmers(long).join(_of_long(spark, sf, long), "rep", "left")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_kmers"), F.count("n").alias("n_hit"), F.sum((F.coalesce("n", F.lit(0)) >= 2).cast("long")).alias("n_solid"))


_RUNS = f"WITH {sql_kmers()}, c AS (SELECT DISTINCT rep FROM km), {_NOISY}, h AS (SELECT item_id, pos, pos - row_number() OVER (PARTITION BY item_id ORDER BY pos) AS run FROM lk JOIN c USING (rep)), r AS (SELECT item_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) AS INT) AS stop, count(*) AS n FROM h GROUP BY item_id, run)"


def _runs(spark, sf):
    long = _noisy_reads(spark, sf)
    return kmers.islands(kmers.hits(_long_kmers(long), _of_long(spark, sf, long).select("rep")), "item_id")  # a passage may stand in one document alone


@query(f"{_RUNS} SELECT item_id, start, stop, n FROM r")
def seed_islands(spark, sf):
    """Stretches of noisy long reads whose k-mers the documents have: the anchors a correction starts from."""
    return _runs(spark, sf).select("item_id", "start", "stop", "n")


@query(f"""{_RUNS}, w AS (SELECT r.*, lead(start) OVER (PARTITION BY item_id ORDER BY start) AS following, lag(stop) OVER (PARTITION BY item_id ORDER BY start) AS prior, CAST(length(seq) AS INT) AS len FROM r JOIN ls USING (item_id))
SELECT item_id, 'head' AS kind, 0 AS start, start AS stop FROM w WHERE prior IS NULL AND start > 0
UNION ALL SELECT item_id, CASE WHEN following IS NULL THEN 'tail' ELSE 'middle' END, stop + {K}, coalesce(following, len) FROM w WHERE coalesce(following, len) > stop + {K}""")
def weak_gaps(spark, sf):
    return kmers.gaps(_runs(spark, sf), _noisy_reads(spark, sf), "item_id", K, F.length("seq"))


@query(f"""WITH {sql_kmers("conversations", "conv_id, turn")}, h AS (SELECT conv_id, turn, min(rep) AS head FROM km GROUP BY conv_id, turn),
f AS (SELECT conv_id, md5(string_agg(head, ',' ORDER BY head)) AS fingerprint FROM h GROUP BY conv_id)
SELECT conv_id, min(conv_id) OVER (PARTITION BY fingerprint) AS kept_as FROM f""")
def pair_fingerprint_dups(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", dna.encode_seq(F.col("text")).alias("seq"))
    turns = turns.repartition("conv_id", "turn")  # as many tasks as the input takes, not one to a core
    heads = packed.least_kmers(turns, K, ["conv_id", "turn"]).repartition("conv_id").groupBy("conv_id", "turn").agg(F.min("head").alias("head"))
    heads = heads.withColumn("head", packed.letters(F.col("head"), K))
    return colors.duplicates(colors.pair_fingerprints(heads, "conv_id", "turn", "head"), "conv_id")


@query("SELECT l_partkey AS v, count(DISTINCT l_orderkey) AS card, min(l_orderkey) AS least, max(l_orderkey) AS most, list_aggregate(list_sort(list_distinct(list(l_orderkey)))[1:3], 'string_agg', ',') AS first FROM lineitem GROUP BY l_partkey")
def color_sets(spark, sf):
    sets = colors.color_sets(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("color")), "v", "color")
    return sets.select("v", "card", F.array_min("colors").alias("least"), F.array_max("colors").alias("most"), F.array_join(F.slice("colors", 1, 3), ",").alias("first"))


_VC = "vc AS (SELECT DISTINCT l_partkey AS v, l_suppkey AS color FROM lineitem)"


@query(f"WITH {_VC}, l AS (SELECT p_partkey AS u, p_partkey + 1 AS v FROM part WHERE p_partkey + 1 <= (SELECT max(p_partkey) FROM part)), s AS (SELECT u, l.v, count(*) AS shared FROM l JOIN vc a ON a.v = l.u JOIN vc b ON b.v = l.v AND a.color = b.color GROUP BY u, l.v) SELECT l.u, l.v, coalesce(shared, 0) AS shared, coalesce(shared, 0) >= 2 AS supported FROM l LEFT JOIN s USING (u, v)")
def color_support(spark, sf):
    part = table(spark, sf, "part").select("p_partkey")
    links = part.select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v")).join(part.select(F.col("p_partkey").alias("v")), "v", "left_semi").select("u", "v")
    pairs = colors.colored(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("color")), "v", "color")
    return colors.supported(links, pairs, "color")


@query(f"WITH {_VC}, a AS (SELECT v, list_sort(list(color)) AS c FROM vc GROUP BY v) SELECT x.v, CAST(len(list_intersect(x.c, y.c)) AS BIGINT) AS both_n, CAST(len(list_distinct(list_concat(x.c, y.c))) AS BIGINT) AS either_n, CAST(len(x.c) - len(list_intersect(x.c, y.c)) AS BIGINT) AS only_n, round(len(list_intersect(x.c, y.c)) * 1.0 / len(list_distinct(list_concat(x.c, y.c))), 6) AS jaccard FROM a x JOIN a y ON y.v = x.v + 1")
def color_jaccard(spark, sf):
    sets = colors.color_sets(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("color")), "v", "color")
    pairs = sets.select("v", F.col("colors").alias("a")).join(sets.select((F.col("v") - 1).alias("v"), F.col("colors").alias("b")), "v")
    a, b = F.col("a"), F.col("b")
    n, m = F.size(colors.common(a, b)).cast("long"), F.size(colors.union_of(a, b)).cast("long")
    return pairs.select("v", n.alias("both_n"), m.alias("either_n"), F.size(colors.without(a, b)).cast("long").alias("only_n"), F.round(n / m, 6).alias("jaccard"))


@query(f"WITH {_SOLID}, vis AS (SELECT DISTINCT kmer AS v, doc_id FROM km UNION SELECT DISTINCT {RC.format('kmer')}, doc_id FROM km), sh AS (SELECT u, edge.v, count(*) AS n FROM edge JOIN vis a ON a.v = edge.u JOIN vis b ON b.v = edge.v AND a.doc_id = b.doc_id GROUP BY u, edge.v) SELECT coalesce(sh.n, 0) >= 2 AS supported, count(*) AS n, bit_xor(CAST(('0x' || substr(md5(u || v), 1, 15)) AS BIGINT)) AS all_links FROM edge LEFT JOIN sh USING (u, v) GROUP BY 1")
def edge_support(spark, sf):
    """Links of the graph whose ends share two documents or more."""
    links = junctions.supported_links(reads(spark, sf), K, "doc_id")
    return links.groupBy((F.col("shared") >= 2).alias("supported")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.md5("both"), 1, 15), 16, 10).cast("long")).alias("all_links"))


@query(f"WITH {_SOLID} SELECT doc_id, count(*) AS n_solid, CAST(round(sum(n) * 1.0 / count(*)) AS BIGINT) AS coverage FROM km JOIN solid USING (rep) GROUP BY doc_id")
def kmer_coverage(spark, sf):
    found = packed.coverage(reads(spark, sf), K, "doc_id").where("n_solid > 0").withColumnRenamed("key", "doc_id")
    return found.select("doc_id", "n_solid", dna.rounded_coverage(F.col("total"), F.col("n_solid")).alias("coverage"))


@query(f"""WITH {_SOLID}, cov AS (SELECT rep AS v, n FROM solid UNION SELECT {RC.format('rep')}, n FROM solid),
deg AS (SELECT node.v, (SELECT count(*) FROM edge e WHERE e.v = node.v) > 1 OR (SELECT count(*) FROM edge e WHERE e.u = node.v) > 1 AS b FROM node),
m AS (SELECT u FROM edge GROUP BY u HAVING count(*) > 1), f AS (SELECT edge.u, edge.v FROM edge JOIN m USING (u)),
g AS (SELECT f.u FROM f JOIN deg ON deg.v = f.v LEFT JOIN edge e ON e.u = f.v GROUP BY f.u HAVING max(CAST(b AS INT)) = 0 AND count(DISTINCT e.v) = 1),
x AS (SELECT DISTINCT f.v, cov.n FROM f JOIN g USING (u) JOIN cov ON cov.v = f.v)
SELECT CAST(CASE WHEN count(*) > 0 THEN sum(n) // count(*) ELSE 0 END AS BIGINT) AS coverage FROM x""")
def bubble_coverage(spark, sf):
    return junctions.bubble_coverage(junctions.junctions(reads(spark, sf), K), K).select(F.col("coverage").cast("long").alias("coverage"))


@query("WITH c AS (SELECT l_orderkey, count(*) * 100 + CAST(sum(l_quantity) AS BIGINT) AS cov FROM lineitem GROUP BY l_orderkey), r AS (SELECT cov, row_number() OVER (ORDER BY cov DESC, l_orderkey) AS rank, count(*) OVER () AS n FROM c) SELECT greatest(cov, 128) AS top FROM r WHERE rank = CAST(floor(n * 0.001) AS BIGINT) + 1")
def top_coverage(spark, sf):
    cov = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) * 100 + F.sum("l_quantity").cast("long")).alias("cov"))
    return ordering.value_at(cov, "cov", ["l_orderkey"], 0.001).select(F.greatest("value", F.lit(128)).cast("long").alias("top"))


_PAGE = sql_kmers("pages", "page_id", K, "html").replace("s AS", "ps AS", 1).replace("km AS", "pk AS", 1).replace("FROM s ", "FROM ps ")


@query(f"WITH {sql_kmers()}, w AS (SELECT DISTINCT rep FROM km), {_PAGE}, {_LONG}, many AS (SELECT rep FROM lk GROUP BY rep HAVING count(*) >= 2) SELECT page_id, count(*) AS n FROM pk WHERE rep IN (SELECT rep FROM w) AND rep NOT IN (SELECT rep FROM many) GROUP BY page_id HAVING count(*) >= 31")
def rescue_reads(spark, sf):
    """Pages with 31 or more k-mers of the documents, not counting those that benchmark has twice."""
    pages = reads(spark, sf, "pages", "page_id", "html")
    return packed.rescued(pages, reads(spark, sf), _long(spark, sf), K, "page_id").withColumnRenamed("key", "page_id")


@query(f"WITH {_SOLID}, m AS (SELECT v, p, substr(v, 1, p - 1) || substr(v, p + 1) AS rest FROM (SELECT v, unnest(generate_series(1, {K})) AS p FROM node)), g AS (SELECT p, rest, bit_or(1 << (instr('ACGT', substr(v, p, 1)) - 1)) AS bases, count(*) AS n FROM m GROUP BY p, rest HAVING count(*) > 1) SELECT CAST(p - 1 AS INT) AS pos, CAST(bases AS INT) AS bases, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2")
def snp_candidates(spark, sf):
    return junctions.snp_candidates(packed.counts(reads(spark, sf), K, 2), K).groupBy("pos", "bases").agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT DISTINCT doc_id % 97 AS block, quality AS type FROM labels) SELECT block, type, dense_rank() OVER (ORDER BY block) - 1 AS block_id, dense_rank() OVER (ORDER BY type) - 1 AS type_id, 2 * (dense_rank() OVER (ORDER BY block) - 1) + dense_rank() OVER (ORDER BY type) - 1 AS hap_id FROM b")
def hap_dictionary(spark, sf):
    return phasing.dictionary(table(spark, sf, "labels").select((F.col("doc_id") % 97).alias("block"), F.col("quality").alias("type")))


@query("SELECT doc_id % 150 AS name, CASE WHEN count(DISTINCT quality) = 1 THEN min(quality) ELSE -1 END AS hap_id, count(DISTINCT quality) = 1 AS phased FROM labels GROUP BY 1")
def hap_conflicts(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 150).alias("name"), F.col("quality").alias("hap"))
    return phasing.assignments(rows, "name", "hap", long_reads=False).na.fill(-1, ["hap_id"])


@query("SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS dist FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def global_edit_distance(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey").select("p_partkey", align.global_distance(F.col("a"), F.col("b")).alias("dist"))


@query("WITH r AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY p_brand), c AS (SELECT part.p_brand, part.p_partkey AS \"order\", part.p_name AS text, levenshtein(part.p_name, f.p_name) * 1.0 / greatest(length(part.p_name), length(f.p_name), 1) AS score FROM part JOIN r ON r.p_brand = part.p_brand JOIN part f ON f.p_partkey = r.first WHERE part.p_partkey != r.first), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, \"order\") AS k FROM c) SELECT p_brand, round(score, 6) AS score, \"order\", text FROM n WHERE k = 1")
def best_candidate(spark, sf):
    """Of the parts of a brand, the name closest to its first part's."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    first = p.groupBy("p_brand").agg(F.min(F.struct("p_partkey", "p_name")).alias("f")).select("p_brand", F.col("f.p_partkey").alias("first"), F.col("f.p_name").alias("reference"))
    return align.best_candidate(p.join(first, "p_brand").where("p_partkey != first"), ["p_brand"], "p_name", "reference", "p_partkey").withColumn("score", F.round("score", 6))


def _in_reference(spark, sf):
    """Names of the parts of a size as DNA, beside that of the first part of the size."""
    p = table(spark, sf, "part").select("p_size", "p_partkey", dna.encode_seq(F.col("p_name")).alias("seq"))
    first = p.groupBy("p_size").agg(F.min(F.struct("p_partkey", "seq")).alias("f")).select("p_size", F.col("f.p_partkey").alias("first"), F.col("f.seq").alias("reference"))
    # one small file is one split; alignment wants more
    return p.join(first, "p_size").where("p_partkey != first").repartition(spark.sparkContext.defaultParallelism, "p_partkey")


_IN_REFERENCE = f"""p AS (SELECT p_size, p_partkey, {ENC.format('p_name')} AS seq FROM part), f AS (SELECT p_size, min(p_partkey) AS first FROM p GROUP BY p_size),
c AS (SELECT p.p_size, p.p_partkey, p.seq, r.seq AS reference FROM p JOIN f USING (p_size) JOIN p r ON r.p_partkey = f.first WHERE p.p_partkey != first AND length(p.seq) > 0)"""
_BEST = "b AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY score, p_partkey) AS k FROM m) SELECT p_size, round(score, 6) AS score, p_partkey AS \"order\", seq AS text FROM b WHERE k = 1"


@query(f"WITH {_IN_REFERENCE}, m AS (SELECT p_size, p_partkey, seq, min(levenshtein(seq, substr(reference, 1, j))) * 1.0 / length(seq) AS score FROM (SELECT *, unnest(generate_series(0, length(reference))) AS j FROM c) GROUP BY p_size, p_partkey, seq), {_BEST}")
def best_prefix(spark, sf):
    """Of the parts of a size, the name closest to a start of the first part's."""
    return align.best_aligned(_in_reference(spark, sf), ["p_size"], "seq", "reference", "p_partkey", "SHW").withColumn("score", F.round("score", 6))


@query(f"WITH {_IN_REFERENCE}, m AS (SELECT p_size, p_partkey, seq, min(levenshtein(seq, substr(reference, i, j))) * 1.0 / length(seq) AS score FROM (SELECT *, unnest(generate_series(0, length(reference) - i + 1)) AS j FROM (SELECT *, unnest(generate_series(1, length(reference) + 1)) AS i FROM c)) GROUP BY p_size, p_partkey, seq), {_BEST}")
def best_infix(spark, sf):
    """Of the parts of a size, the name closest to any part of the first part's."""
    return align.best_aligned(_in_reference(spark, sf), ["p_size"], "seq", "reference", "p_partkey", "HW").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, CAST(coalesce(max(i) FILTER (WHERE substr(a, 1, i) = substr(b, 1, i)), 0) AS INT) AS n FROM (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, unnest(generate_series(0, least(length(a.p_name), length(b.p_name)))) AS i FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) GROUP BY p_partkey")
def common_prefixes(spark, sf):
    """Letters that the names of neighbouring parts have in common from their starts."""
    p = table(spark, sf, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return pairs.select("p_partkey", dna.common_prefix(F.col("a"), F.col("b")).alias("n"))


@query(f"WITH s AS (SELECT conv_id, turn, {ENC.format('text')} AS seq FROM conversations) SELECT conv_id, turn, md5('@c' || conv_id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq))) AS record FROM s")
def fastq_records(spark, sf):
    r = reads(spark, sf, "conversations", ["conv_id", "turn"])
    record = dna.fastq(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("seq"), F.expr("repeat('I', length(seq))"))
    return r.select("conv_id", "turn", F.md5(record).alias("record"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events")
def ordered_output(spark, sf):
    """Places in the order of the input, as an ordered sink writes them."""
    return ordering.global_rank(table(spark, sf, "events").select("event_id"), "event_id", [])


@query("WITH g AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS files FROM orders GROUP BY o_custkey) SELECT o_custkey, c_mktsegment, r_name, CAST(len(files) AS BIGINT) AS n, files[1] AS first FROM g JOIN customer ON c_custkey = o_custkey CROSS JOIN (SELECT min(r_name) AS r_name FROM region) i")
def wf_group_join_combine(spark, sf):
    """Grouping by id, joining by id, and combining with one index row."""
    files = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("files"))
    index = table(spark, sf, "region").agg(F.min("r_name").alias("r_name"))  # one row
    joined = files.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return joined.crossJoin(F.broadcast(index)).select("o_custkey", "c_mktsegment", "r_name", F.size("files").cast("long").alias("n"), F.col("files")[0].alias("first"))


@query()
def unitigs(spark, sf):
    """Lengths of unitigs of the documents' solid k-mers."""
    tigs, _ = graph.unitigs_by_slots(reads(spark, sf), K)
    return tigs.groupBy("n_kmers").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))


@query()
def alignments(spark, sf):
    """Names of neighbouring parts aligned with the target's ends free."""
    p = table(spark, sf, "part")
    pairs = p.select("p_partkey", F.col("p_brand").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    pairs = pairs.repartition(spark.sparkContext.defaultParallelism, "p_partkey")  # as above
    return pairs.withColumn("x", align.alignment(F.col("a"), F.col("b"), "HW")).select("p_partkey", "x.dist", "x.ends", "x.start", "x.cigar")


@query()
def color_subsample(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("color")).distinct()
    stats = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("cov")).withColumn("branching", F.col("v") % 5 == 0)
    return colors.subsample(pairs, stats, 20.0).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {sql_kmers()}, solid AS (SELECT DISTINCT rep FROM km), {_NOISY},
weak AS (SELECT item_id, pos, kmer FROM lk WHERE rep NOT IN (SELECT rep FROM solid)),
e AS (SELECT weak.*, i, b FROM (SELECT *, unnest(generate_series(1, {K})) AS i FROM weak) weak, (SELECT unnest(['A', 'C', 'G', 'T']) AS b)),
n AS (SELECT item_id, pos, kmer, substr(kmer, 1, i - 1) || b || substr(kmer, i + 1) AS near FROM e
  UNION SELECT item_id, pos, kmer, substr(substr(kmer, 1, i) || b || substr(kmer, i + 1), 1, {K}) FROM e WHERE i < {K}
  UNION SELECT item_id, pos, kmer, substr(kmer, 1, i - 1) || substr(kmer, i + 1) || b FROM e)
SELECT item_id, pos, count(DISTINCT near) AS n FROM n JOIN solid ON solid.rep = least(near, {RC.format("near")}) WHERE near != kmer GROUP BY item_id, pos""")
def inexact_hits(spark, sf):
    """Places of noisy long reads whose k-mer the documents don't have but is one edit from one that they have."""
    long, docs = _noisy_reads(spark, sf), reads(spark, sf)
    weak = _long_kmers(long).join(_of_long(spark, sf, long), "rep", "left_anti")
    near = packed.near_hits(weak.select((F.col("item_id") * (1 << 32) + F.col("pos")).alias("key"), "kmer"), docs, K)
    return near.select(F.shiftright("key", 32).alias("item_id"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "n")


@query()
def corrected_reads(spark, sf):
    """Benchmark items, with every 37th base changed, corrected along the documents' graph."""
    from graphloom.plans.pipeline import Params, correct_once

    long = reads(spark, sf, "benchmark", "item_id").select(F.col("item_id").alias("read_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), "seq")
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    noisy = long.withColumn("seq", F.array_join(F.transform(letters, lambda c, i: F.when(i % 37 == 36, F.translate(c, "ACGT", "CGTA")).otherwise(c)), ""))
    out = correct_once(reads(spark, sf), noisy, Params(insert=100))
    return out.select("read_id", "name", "seq", "qual")
