"""Two-pass correction of long reads, from reads to reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.dna import QUAL_BASE, all_bases_reach, revcomp
from graphloom.operators import colors, correction, graph, guided, kmers, ordering, packed, regions, seeding, walks
from graphloom.sources import store


@dataclass(frozen=True)
class Params:
    """A run's settings and their limits. collapse: short reads that visit the same unitigs count as copies, with one colour."""

    k: int = 31
    k2: int = 63
    solid: int = 2
    max_qual: int = 40
    longest_gap: int = 1000
    longest_gap2: int = 5000
    window: float = 0.25
    trim: int = 0
    insert: int = 500
    least_colors: int = 2
    least_length2: int = 3000
    color_confidence: float = 0.0
    top_coverage: float = 128.0
    beam: int = 512
    rounds: int = 1
    collapse: bool = True
    settle: bool = False

    def __post_init__(self) -> None:
        if self.k % 2 == 0 or self.k2 % 2 == 0:
            raise ValueError("k-mer lengths are odd")
        if self.k2 <= self.k:
            raise ValueError("the second length is over the first")
        if not 0 <= self.trim <= self.max_qual:
            raise ValueError("0 <= trim <= max_qual")
        if not 0 < self.window < 1:
            raise ValueError("0 < window < 1")
        if self.insert <= 0 or self.rounds <= 0:
            raise ValueError("insert and rounds are over 0")
        if not 0 <= self.color_confidence <= 1:
            raise ValueError("0 <= color_confidence <= 1")


@dataclass(frozen=True)
class Pass:
    """Settings of one pass."""

    k: int
    longest: int
    window: float
    second: bool = False


@dataclass(frozen=True)
class Graph:
    """Unitigs with what reads say of them. Tables: tigs, index, both readings, supported links, pairs (unitig_id, color), stats (unitig_id, cov, branching)."""

    tigs: DataFrame
    index: DataFrame
    both: DataFrame
    links: DataFrame
    pairs: DataFrame
    stats: DataFrame
    k: int


def both_unitigs(short: DataFrame, params: Params) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Unitigs and index of the first and of the second length: the graph of the first is that of the second's unitigs, each k-mer of which counts."""
    long_tigs = graph.unitigs(kmers.solid(kmers.kmers(short, params.k2, [], strict=True), params.solid), params.k2)
    inner = kmers.kmers(long_tigs[0].select("seq"), params.k, [])
    return graph.unitigs(kmers.solid(inner, 1), params.k), long_tigs


def side_by_side(long_tigs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(u, v): unitigs that follow one another in the unitigs of a greater length, both ways round."""
    hits = kmers.kmers(long_tigs, k, ["unitig_id"]).select("kmer", F.col("unitig_id").alias("whole"), "pos").join(index.select("kmer", "unitig_id"), "kmer").select("whole", "pos", F.col("unitig_id").alias("u"))
    after = hits.select("whole", (F.col("pos") - 1).alias("pos"), F.col("u").alias("v"))
    pairs = hits.join(after, ["whole", "pos"]).where("u != v").select("u", "v")
    return pairs.union(pairs.select("v", "u")).distinct()


def colored_graph(tigs: DataFrame, index: DataFrame, reads: DataFrame, k: int, params: Params, once: bool = True, adjacent: DataFrame | None = None) -> Graph:
    """The graph with the colours of reads (color, seq). once: of reads that visit the same unitigs one gives its colour.

    adjacent: (u, v) of unitigs whose link gets two colours of its own where it has too few; it isn't a supported one for that.
    """
    if k > 31:
        hits = kmers.kmers(reads, k, ["color"]).select("color", "kmer").join(index.select("kmer", "unitig_id"), "kmer").groupBy("unitig_id", "color").agg(F.count(F.lit(1)).alias("n"))
    else:  # slot by slot, no row per k-mer
        hits = packed.colored(reads, tigs, k, "color").withColumnRenamed("key", "color")
    hits = graph.kept(hits)
    pairs = hits.select("unitig_id", "color")
    if once:
        prints = pairs.groupBy("color").agg(F.md5(F.array_join(F.sort_array(F.collect_list("unitig_id")), ",")).alias("fingerprint"))
        pairs = pairs.join(colors.duplicates(prints, "color").where("color = kept_as").select("color"), "color", "left_semi").select("unitig_id", "color")
    pairs = graph.kept(pairs)
    both = graph.kept(walks.sides(tigs))
    links = graph.kept(walks.steps(both, k, 2 * max(params.longest_gap, params.longest_gap2)))
    out = links.groupBy(F.col("u").alias("v")).agg(F.countDistinct("v").alias("n")).where("n > 1").select("v")
    branching = both.join(out, "v", "left_semi").select("unitig_id").distinct().withColumn("branching", F.lit(True))
    cov = hits.groupBy("unitig_id").agg(F.sum("n").alias("n")).join(tigs.select("unitig_id", "n_kmers"), "unitig_id", "right")
    stats = cov.select("unitig_id", F.round(F.coalesce("n", F.lit(0)) / F.col("n_kmers")).alias("cov")).join(branching, "unitig_id", "left").na.fill(False, ["branching"])
    supported = graph.kept(walks.supported_steps(links, both, pairs, params.least_colors))
    if adjacent is not None:
        made = colors.synthetic_links(walks.unitig_links(links, both).join(walks.unitig_links(supported, both), ["u", "v"], "left_anti"), adjacent)
        pairs = graph.kept(pairs.union(made.select("v", "color")).distinct())
    return Graph(tigs, index, both, supported, pairs, graph.kept(stats), k)


def seeds(g: Graph, reads: DataFrame, params: Params, step: Pass) -> tuple[DataFrame, DataFrame]:
    """Solid and weak anchors of reads. The second pass has no weak ones, as no stretch is searched for inexact hits."""
    # up to 31 letters reads' k-mers are looked up slot by slot, so that no table of all of the graph's is made
    index = (lambda wanted: packed.located(wanted, g.tigs, g.k)) if g.k <= 31 else g.index
    exact = graph.kept(seeding.exact_hits(reads, index, g.k))
    solid = regions.without_overlaps(exact, "read_id", g.k)
    ends = walks.unitig_links(g.links, g.both)
    solid = graph.kept(guided.anchors(regions.color_consistent(solid, g.pairs.withColumnRenamed("unitig_id", "v"), ends, "read_id", params.least_colors), g.tigs))
    if step.second:
        return solid, solid.limit(0)
    plain = g.pairs.join(g.stats.where("not branching").select("unitig_id"), "unitig_id", "left_semi")
    classes = seeding.gap_classes(exact, reads, g.k, params.insert)
    searched = graph.kept(seeding.searched_stretches(classes, exact, plain, params.insert, params.least_colors))
    near = graph.kept(seeding.inexact_hits(searched, reads, index, g.k))
    return solid, graph.kept(guided.anchors(regions.non_overlapping_weak(near, "read_id", g.k), g.tigs, "near"))


def correct_pass(g: Graph, long: DataFrame, params: Params, step: Pass) -> DataFrame:
    """(read_id, name, seq, qual): one pass over reads (read_id, name, seq), in the second with their qual.

    Gaps along one unitig are filled from it; the others are walked along links and vertices of their chosen colours. Gaps without two
    colours, and in the second pass those of the greatest quality throughout, stay as they are.
    """
    k = g.k
    reads = long.select("read_id", "name", F.upper("seq").alias("seq"), *(["qual"] if step.second else []))
    solid, weak = seeds(g, reads, params, step)
    gaps = guided.stretches(solid, reads, k)
    nexts = solid.select("read_id", F.col("pos").alias("at"), "rv", "roff", F.col("kmer").alias("n_kmer"))
    right = gaps.where("kind = 'middle'").join(nexts.withColumnRenamed("at", "stop"), ["read_id", "stop"]).select("gap", F.col("rv").alias("r_u"), F.col("roff").alias("r_off"), revcomp(F.col("n_kmer")).alias("r_kmer"))
    left = gaps.where("kind = 'middle'").join(nexts.withColumnRenamed("at", "start"), ["read_id", "start"]).select("gap", F.col("rv").alias("r_w"), F.col("roff").alias("r_w_off"))
    gaps = gaps.join(right, "gap", "left").join(left, "gap", "left")
    if step.second:
        gaps = gaps.join(reads.select("read_id", "qual"), "read_id").withColumn("raw_qual", F.expr(f"substring(qual, start + 1, stop - start + {k})")).drop("qual")
        gaps = gaps.withColumn("raw_qual", F.when(F.col("kind") == "head", F.reverse("raw_qual")).otherwise(F.col("raw_qual"))).where(~all_bases_reach(F.col("raw"), F.col("raw_qual"), QUAL_BASE + params.max_qual))
    else:
        gaps = gaps.withColumn("raw_qual", F.lit(None).cast("string"))
    gaps = graph.kept(gaps)
    on_one = graph.kept(guided.along_unitig(gaps, g.both, k, step.window))
    todo = gaps.join(on_one.select("gap"), "gap", "left_anti").where((F.col("kind") != "middle") | (F.col("stop") - F.col("start") >= k))
    top = ordering.value_at(g.stats, "cov", ["unitig_id"], 0.001).first()
    candidates = guided.color_candidates(todo, solid, weak, g.stats, params.insert, max(params.top_coverage, top.value if top else 0.0))
    chosen = graph.kept(guided.chosen_colors(candidates, g.pairs, params.least_colors))
    todo = graph.kept(todo.join(chosen.select("gap").distinct(), "gap", "left_semi"))
    fixed = guided.corrected_gaps(todo, guided.in_gaps(todo, weak, k), g.both, g.links, (chosen, g.pairs, params.least_colors), k, step.longest, params.max_qual, step.window, params.beam)
    best = chr(QUAL_BASE + params.max_qual)
    filled = on_one.where("path is not null").select("gap", F.col("path").alias("seq"), F.expr(f"repeat('{best}', length(path))").alias("qual"))
    return guided.stitched(reads, solid, gaps, fixed.union(filled), k, params.max_qual)


def round_limits(params: Params) -> list[tuple[float, int]]:
    """(share of length, longest gap) of each round of the first pass: both grow to the run's own, the share from a tenth on."""
    n = params.rounds
    step = 0.0 if n == 1 else (params.window - 0.10) / (n - 1)
    return [(params.window - (n - j - 1) * step, (j + 1) * (params.longest_gap // n)) for j in range(n)]


def read_colors(reads: DataFrame) -> DataFrame:
    """(color, seq): a colour for each name, so that mates have one; without names for each row."""
    if "name" in reads.columns:
        return reads.select(F.xxhash64("name").alias("color"), F.upper("seq").alias("seq"))
    return reads.select(F.monotonically_increasing_id().alias("color"), F.upper("seq").alias("seq"))


def correct_once(short: DataFrame, long: DataFrame, params: Params) -> DataFrame:
    """One pass at the first length, on the graph of the short reads' own k-mers."""
    short = graph.kept(read_colors(short))
    tigs, index = graph.unitigs_by_slots(short, params.k, params.solid)
    return correct_pass(colored_graph(tigs, index if params.k <= 31 else graph.kept(index), short, params.k, params, params.collapse), long, params, Pass(params.k, params.longest_gap, params.window))


def first_graph(short: DataFrame, params: Params) -> tuple[Graph, DataFrame]:
    """The coloured graph of the first length, and the unitigs of the second."""
    short = graph.kept(read_colors(short))
    (tigs, index), (long_tigs, _) = both_unitigs(short, params)
    return colored_graph(tigs, index, short, params.k, params, params.collapse, side_by_side(long_tigs, index, params.k)), long_tigs


def second_graph(tigs: DataFrame, corrected: DataFrame, params: Params, accurate: DataFrame | None = None) -> Graph:
    """The graph of the second length with the colours of reads of ``least_length2`` or more.

    corrected: (read_id, seq, qual) of the first pass, whose bases under the confidence are left out; accurate: (name, seq) of other long reads.
    """
    sure = QUAL_BASE + 1 + int(params.color_confidence * (params.max_qual - 1))
    sources = correction.masked(corrected, sure).select(F.xxhash64(F.lit(1), "read_id").alias("color"), "seq")
    if accurate is not None:
        sources = sources.union(accurate.select(F.xxhash64(F.lit(2), "name"), F.upper("seq")))
    sources = graph.kept(sources.where(F.length("seq") >= params.least_length2))
    return colored_graph(tigs, graph.kept(store.index_of(tigs, params.k2)), sources, params.k2, params, once=False)


def first_pass(g: Graph, long: DataFrame, params: Params) -> DataFrame:
    """All rounds of the first pass."""
    for share, longest in round_limits(params):
        long = graph.kept(correct_pass(g, long, params, Pass(g.k, longest, share)))
    return long


def second_pass(g: Graph, corrected: DataFrame, params: Params) -> DataFrame:
    """The second pass over (read_id, name, seq, qual); with ``settle`` ambiguous letters that the graph tells are replaced first."""
    if params.settle:
        corrected = graph.settled(corrected, g.index.select("kmer"), g.k, "read_id")
    out = correct_pass(g, corrected, params, Pass(g.k, params.longest_gap2, params.window, second=True))
    return correction.trimmed(out, ["read_id"], params.trim, g.k, with_qual=True) if params.trim else out


def rescued_reads(unmapped: DataFrame, short: DataFrame, long: DataFrame, params: Params) -> DataFrame:
    """The unmapped short reads (name, seq) with 31 or more k-mers that long reads have and that aren't repeated in the short ones."""
    of = lambda df: kmers.kmers(df.select(F.upper("seq").alias("seq")), params.k, [], strict=True)
    rows = graph.kept(unmapped.select("name", F.upper("seq").alias("seq")).withColumn("row", F.monotonically_increasing_id()))
    found = colors.rescued(kmers.kmers(rows, params.k, ["row"], strict=True), of(long), kmers.solid(of(short), 2), "row")
    return rows.join(found.select("row"), "row", "left_semi").select("name", "seq")


def save_graph(g: Graph, path: str) -> None:
    store.write_store(g.tigs, g.links, g.k, path, pairs=g.pairs, stats=g.stats)


def load_graph(spark: SparkSession, path: str) -> Graph:
    k, tigs, links, parts = store.read_store(spark, path)
    return Graph(tigs, graph.kept(store.index_of(tigs, k)), graph.kept(walks.sides(tigs)), links, parts["pairs"], parts["stats"], k)


def correct(short: DataFrame, long: DataFrame, params: Params, accurate: DataFrame | None = None) -> DataFrame:
    """(read_id, name, seq, qual) of long reads (read_id, name, seq) by short ones (seq, and name where mates are to share a colour).

    The first pass has the graph of the first length with the colours of the short reads; the second that of the second length with the
    colours of the first pass's reads of ``least_length2`` or more, bases without confidence left out. With ``trim`` only runs of that quality and
    of k2 or more come out, numbered (read_id, name, seq, qual, part). Reads without any anchor come out as they are; no short reads correct nothing.
    """
    g, long_tigs = first_graph(short, params)
    now = first_pass(g, long, params)
    return second_pass(second_graph(long_tigs, now, params, accurate), now, params)
