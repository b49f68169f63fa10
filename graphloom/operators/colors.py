"""Colours of graph vertices: the reads that visit them, as sets, with coverage, support and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_ids(reads: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``color``: a number per distinct name by first place; mates of a name share it.

    Numbers follow the order of first places without a gap; a sparse first place itself would do as well.
    """
    first = reads.groupBy(name).agg(F.min(order).alias("__first"))
    return reads.join(first, name).withColumn("color", F.col("__first")).drop("__first")


def colored(hits: DataFrame, vertex: str, color: str) -> DataFrame:
    """(vertex, color): each visit once."""
    return hits.select(vertex, color).distinct()


def color_sets(pairs: DataFrame, vertex: str, color: str) -> DataFrame:
    """(vertex, colors, card)."""
    sets = pairs.groupBy(vertex).agg(F.sort_array(F.collect_set(color)).alias("colors"))
    return sets.withColumn("card", F.size("colors").cast("long"))


def union_of(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def common(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def without(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def shares_at_least(a: Column, b: Column, n: int) -> Column:
    return F.size(F.array_intersect(a, b)) >= n


def first_common(a: Column, b: Column, n: int) -> Column:
    return F.slice(common(a, b), 1, n)


def shared_counts(links: DataFrame, pairs: DataFrame, color: str) -> DataFrame:
    """(u, v, shared): colours that both ends of each link have; links without any have 0. pairs: (v, color).

    Counts come from joins and partial sums, so no vertex's set is gathered in one row.
    """
    left = links.join(pairs.select(F.col("v").alias("u"), color), "u")
    both = left.join(pairs.select("v", color), ["v", color]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    return links.join(both, ["u", "v"], "left").na.fill(0, ["shared"])


def supported(links: DataFrame, pairs: DataFrame, color: str, least: int = 2) -> DataFrame:
    return shared_counts(links, pairs, color).withColumn("supported", F.col("shared") >= least)


def coverage(hits: DataFrame, vertex: str, phased: Column | None = None) -> DataFrame:
    """(vertex, cov_phased, cov_unphased): visits of k-mers, by whether the read has a haplotype."""
    is_phased = phased if phased is not None else F.lit(False)
    return hits.groupBy(vertex).agg(F.sum(is_phased.cast("long")).alias("cov_phased"), F.sum((~is_phased).cast("long")).alias("cov_unphased"))


def anchor_vertex(hits: DataFrame, read: str, vertex: str, length: str) -> DataFrame:
    """(read, anchor): of the vertices that a read meets the longest, of equal ones the least."""
    best = F.max(F.struct(F.col(length).alias("n"), (-F.col(vertex)).alias("v")))
    return hits.groupBy(read).agg(best.alias("best")).select(read, (-F.col("best.v")).alias("anchor"))


def pair_fingerprints(heads: DataFrame, pair: str, mate: str, head: str) -> DataFrame:
    """(pair, fingerprint): the distinct heads of each mate, all mates' together in order."""
    once = heads.select(pair, mate, head).distinct()
    return once.groupBy(pair).agg(F.sort_array(F.collect_list(head)).alias("heads")).select(pair, F.md5(F.array_join("heads", ",")).alias("fingerprint"))


def duplicates(prints: DataFrame, pair: str) -> DataFrame:
    """(pair, kept_as): pairs of one fingerprint stand for their least."""
    least = prints.groupBy("fingerprint").agg(F.min(pair).alias("kept_as"))
    return prints.join(least, "fingerprint").select(pair, "kept_as")


def sampled(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Bernoulli sample by a hash of the key: the same rows each time; a rate of 0 keeps none."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rate * (1 << 30)))


def subsample(pairs: DataFrame, stats: DataFrame, hap_coverage: float, bins: int = 20, few: int = 5) -> DataFrame:
    """Colours to keep. pairs: (v, color). stats: (v, cov, branching).

    With a haplotype coverage of 10 or more: up to two colours of each plain vertex, and of each
    5 % bin of coverage a share of 5 / coverage, whole bins where the least coverage is under ``few``.
    Bins are half open, so vertices of the greatest coverage add none but their two. Draws go by
    hashes, so they hold from run to run, and a colour has one draw in its lowest bin.
    """
    if hap_coverage < 10:
        return pairs
    rate = 5 / hap_coverage
    plain = pairs.join(stats.where("not branching").select("v"), "v", "left_semi")
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("v", "color")))
    two = plain.withColumn("place", place).where("place <= 2").select("color")
    cuts = stats.agg(F.percentile_approx("cov", [i / bins for i in range(bins + 1)], 10_000).alias("q")).first().q or []
    bounds = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    chosen = two
    if bounds:
        number = sum((F.when(F.col("cov") >= a, 1).otherwise(0) for a, _ in bounds[1:]), F.lit(0))
        binned = stats.where(F.col("cov") < bounds[-1][1]).select("v", number.alias("bin"))
        low = F.element_at(F.array(*(F.lit(float(a)) for a, _ in bounds)), F.col("bin") + 1)
        lowest = pairs.join(binned, "v").groupBy("color").agg(F.min("bin").alias("bin"))
        draw = F.pmod(F.xxhash64("color", "bin"), F.lit(1 << 30)) < int(rate * (1 << 30))
        chosen = chosen.union(lowest.where(draw | (low < few)).select("color"))
    return pairs.join(chosen.distinct(), "color", "left_semi").select("v", "color")


def synthetic_links(weak: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(v, color): two colours for both ends of links with few shared ones that stand side by side in a longer graph."""
    both = weak.join(adjacent, ["u", "v"], "left_semi")
    color = F.explode(F.array(F.xxhash64(F.lit(1), "u", "v"), F.xxhash64(F.lit(2), "u", "v"))).alias("color")
    made = both.select("u", "v", color)
    return made.select("v", "color").union(made.select(F.col("u"), "color")).distinct()


def rescued(occurrences: DataFrame, wanted: DataFrame, common_kmers: DataFrame, read: str, least: int = 31) -> DataFrame:
    """(read, n): reads with ``least`` or more k-mers that are wanted and not common ones."""
    good = occurrences.join(wanted.select("rep").distinct(), "rep", "left_semi").join(common_kmers.select("rep"), "rep", "left_anti")
    return good.groupBy(read).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ranked_by_coverage(stats: DataFrame, top: int) -> DataFrame:
    return stats.orderBy(F.col("cov").desc(), "v").limit(top)
