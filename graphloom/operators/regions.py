"""Seeds and regions of long reads: pruning, the shortcut along one unitig, colour choice, consensus by runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import align
from graphloom.functions.dna import revcomp
from graphloom.storage import stored

MAX_EDITS = 0.25


def non_overlapping_weak(hits: DataFrame, read: str, k: int) -> DataFrame:
    """Weak hits without those that contradict another one.

    hits: (read, pos, kmer, near, kind, unitig_id), near being one edit from the read's kmer. Hits
    that vary at their first or last base go. Two variants whose places are within k of one another
    and that no unitig has in common both go. Places are joined by ranges of k, not all with all.
    """
    first = F.substring("kmer", 1, 1) != F.substring("near", 1, 1)
    last = F.expr("right(kmer, 1) != right(near, 1)")
    inner = hits.where(~(first | last)).withColumn("cell", F.floor(F.col("pos") / k))
    variant = inner.groupBy(read, "pos", "near", "kind", "cell").agg(F.sort_array(F.collect_set("unitig_id")).alias("tigs"))
    a = variant.select(read, F.col("pos").alias("p"), F.col("near").alias("n"), F.col("tigs").alias("t"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    clash = a.join(variant, [read, "cell"]).where((F.abs(F.col("pos") - F.col("p")) < k) & ((F.col("pos") != F.col("p")) | (F.col("near") != F.col("n"))) & ~F.arrays_overlap("tigs", "t"))
    return inner.drop("cell").join(clash.select(read, "pos", "near").distinct(), [read, "pos", "near"], "left_anti")


def color_consistent(hits: DataFrame, pairs: DataFrame, links: DataFrame, read: str, least: int = 2) -> DataFrame:
    """Solid hits whose step to the next on another unitig is a link of the graph with ``least`` shared colours.

    hits: (read, pos, unitig_id). Where a step fails, the runs on both its sides go, each as far as
    its unitig reaches. pairs: (v, color) and links: (u, v) of unitigs.
    """
    order = Window.partitionBy(read).orderBy("pos")
    marked = hits.withColumn("fresh", F.coalesce((F.col("unitig_id") != F.lag("unitig_id").over(order)).cast("int"), F.lit(0)))
    runs = marked.withColumn("run", F.sum("fresh").over(order))
    ends = runs.groupBy(read, "run").agg(F.first("unitig_id").alias("u"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    by_run = Window.partitionBy(read).orderBy("run")
    steps = ends.select(read, "run", "u", F.lead("u").over(by_run).alias("v"), "b", F.lead("a").over(by_run).alias("next"))
    steps = steps.where(F.col("next") == F.col("b") + 1)
    # colours are compared for the links that a read takes, not for all of the graph
    taken = links.select("u", "v").join(steps.select("u", "v").distinct(), ["u", "v"], "left_semi")
    common = pairs.select(F.col("v").alias("u"), "color").join(taken, "u").join(pairs.select("v", "color"), ["v", "color"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    broken = steps.join(common.where(F.col("shared") >= least), ["u", "v"], "left_anti")
    gone = broken.select(read, "run").union(broken.select(read, F.col("run") + 1)).distinct()
    return runs.join(gone, [read, "run"], "left_anti").drop("fresh", "run")


def without_overlaps(hits: DataFrame, read: str, k: int) -> DataFrame:
    """Solid hits without the tails of runs that the next run overlaps.

    hits: (read, pos, …). A run is of consecutive places, whatever unitigs they lie on. Where the next run starts within k
    bases of a place, that place goes.
    """
    order = Window.partitionBy(read).orderBy("pos")
    breaks = F.coalesce((F.col("pos") != F.lag("pos").over(order) + 1).cast("int"), F.lit(0))
    runs = hits.withColumn("fresh", breaks)
    start = F.min(F.when(F.col("fresh") == 1, F.col("pos"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return runs.withColumn("next", start).where(F.col("next").isNull() | (F.col("pos") + k <= F.col("next"))).drop("fresh", "next")


def same_unitig(regions: DataFrame, tigs: DataFrame, k: int, share: float = MAX_EDITS) -> DataFrame:
    """(region columns, path): regions whose anchors lie on one unitig, strand and forward, with a fitting length.

    regions: (…, left_id, left_dist, left_strand, right_id, right_dist, right_strand, raw).
    """
    one = regions.where("left_id = right_id and left_strand = right_strand").join(tigs.select(F.col("unitig_id").alias("left_id"), "seq", "n_kmers"), "left_id")
    a = F.when(F.col("left_strand"), F.col("left_dist")).otherwise(F.col("right_dist"))
    b = F.when(F.col("left_strand"), F.col("right_dist")).otherwise(F.col("left_dist"))
    cut = one.withColumn("a", a).withColumn("b", b).where("b > a").withColumn("piece", F.expr(f"substring(seq, a + 1, b - a + {k})"))
    path = F.when(F.col("left_strand"), F.col("piece")).otherwise(revcomp(F.col("piece")))
    n = F.length("raw")
    return cut.withColumn("path", path).where((F.length("path") >= n * (1 - share)) & (F.length("path") <= n * (1 + share))).drop("a", "b", "piece", "seq", "n_kmers")


def choose_colors(candidates: DataFrame, region: list[str], most: int = 30, least: int = 2) -> DataFrame:
    """(region, colors, weighted, weight): colours to follow through a region, by tiers.

    candidates: (region, vertex, side in left, right, inner, branching, color). Colours of plain vertices come before those of
    branching ones alone; within each, colours found on three sides before two and one. A vertex gives colours until ``most`` of its own
    are chosen, those of small sets first; vertices of fewer than ``least`` colours give none. Colours of plain vertices are weighted.
    A region's rows are bounded: vertices lie within an insert of it and have no more than the greatest coverage of colours each.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        plain = set(rows.color[~rows.branching])
        sides = rows.groupby("color").side.nunique().to_dict()
        sets = {v: sorted(set(c)) for v, c in rows.groupby("vertex").color}
        chosen, weighted, weight = _chosen(plain, sides, sets, {v: len(c) for v, c in sets.items()}, most, least)
        return pd.DataFrame({c: [rows[c].iloc[0]] for c in region} | {"colors": [chosen], "weighted": [weighted], "weight": [weight]})

    names = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in region)
    return candidates.groupBy(*region).applyInPandas(choose, f"{names}, colors array<long>, weighted array<long>, weight double")


def _chosen(plain: set[int], sides: dict[int, int], sets: dict[int, list[int]], sizes: dict[int, int], most: int, least: int) -> tuple[list[int], list[int], float]:
    """(colors, weighted, weight) by tiers. sets: colours of each vertex in order; sizes: how many it has, those not listed included."""
    order = sorted((v for v in sets if sizes[v] >= least), key=lambda v: (sizes[v], v))
    left = {v: min(most, sizes[v]) for v in order}
    chosen: set[int] = set()
    for of_plain in (True, False):
        for tier in (3, 2, 1):
            todo = {c for c, n in sides.items() if (c in plain) == of_plain and n == tier}
            for v in order:
                if not left[v] or not todo.intersection(sets[v]):
                    continue
                left[v] = min(most, sizes[v]) - min(len(chosen.intersection(sets[v])), min(most, sizes[v]))
                taken = [c for c in sets[v] if c in todo][: left[v]]
                chosen.update(taken)
                todo.difference_update(taken)
                left[v] -= min(len(taken), left[v])
            if not any(left.values()):
                break
    weighted = chosen & plain
    free = len(chosen) - len(weighted)
    return sorted(chosen), sorted(weighted), 2.0 * max(free / len(weighted), 1.0) if weighted else 2.0


def choose_colors_of(candidates: DataFrame, pairs: DataFrame, region: str, most: int = 30, least: int = 2) -> DataFrame:
    """As ``choose_colors`` of candidates (region, vertex, side, branching) joined with pairs (vertex, color), each once, without that join's rows.

    Regions with the same vertices on the same sides have the same colours, so each such pattern is worked on once. Colours that lie on the
    same of a pattern's vertices stand in one tier, and of these none is chosen but the ``most`` least: a vertex takes its colours in order and has no more than
    ``most`` chosen. So a pattern's row has so many colours of each kind at most, and the number that each vertex has in all.
    """
    name = lambda c: F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g"))
    mark = F.struct("vertex", "side", "branching")
    marks = candidates.groupBy(region).agg(F.sort_array(F.collect_set(mark)).alias("marks"))
    regions = stored(marks.withColumn("on", F.sort_array(F.array_distinct(F.transform("marks", lambda m: m.vertex)))).withColumns({"pattern": name("marks"), "area": name("on")}), "regions")
    patterns = regions.groupBy("pattern").agg(F.first("marks").alias("marks"), F.first("area").alias("area"))
    areas = stored(regions.groupBy("area").agg(F.first("on").alias("on")).select("area", F.explode("on").alias("vertex")), "areas")
    # colours by the vertices that they lie on, of which an area cuts out its own
    wanted = pairs.join(areas.select("vertex").distinct(), "vertex", "left_semi")
    kinds = wanted.groupBy("color").agg(F.sort_array(F.collect_list("vertex")).alias("on")).withColumn("kind", name("on"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("color"))
    kinds = stored(kinds.withColumn("place", place).where(F.col("place") <= most).drop("place"), "kinds")  # the least colours of a kind
    of = kinds.groupBy("kind").agg(F.first("on").alias("on")).select("kind", F.explode("on").alias("vertex"))
    cut = areas.join(of, "vertex").groupBy("area", "kind").agg(F.sort_array(F.collect_list("vertex")).alias("on"))
    place = F.row_number().over(Window.partitionBy("area", "on").orderBy("color"))
    some = cut.join(kinds.select("kind", "color"), "kind").withColumn("place", place).where(F.col("place") <= most)
    same = some.groupBy("area", "on").agg(F.collect_list("color").alias("colors"))
    same = same.groupBy("area").agg(F.collect_list(F.struct("on", "colors")).alias("same"))
    size = wanted.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
    sizes = areas.join(size, "vertex").groupBy("area").agg(F.map_from_entries(F.collect_list(F.struct("vertex", "n"))).alias("sizes"))

    @F.pandas_udf("colors array<long>, weighted array<long>, weight double")
    def choose(marks: pd.Series, same: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for own, alike, n in zip(marks, same, sizes, strict=True):
            plain, sides, sets = set(), {}, {}
            for x in alike:
                on, cs = set(x["on"]), list(x["colors"])
                here = [m for m in own if m["vertex"] in on]
                sides.update(dict.fromkeys(cs, len({m["side"] for m in here})))
                if any(not m["branching"] for m in here):
                    plain.update(cs)
                for v in on:
                    sets.setdefault(v, []).extend(cs)
            out.append(_chosen(plain, sides, {v: sorted(c) for v, c in sets.items()}, dict(n), most, least))
        return pd.DataFrame(out, columns=["colors", "weighted", "weight"])

    done = patterns.join(same, "area").join(sizes, "area").select("pattern", choose("marks", "same", "sizes").alias("x"))
    return regions.select(region, "pattern").join(done, "pattern").select(region, "x.colors", "x.weighted", "x.weight")


def score_path(path: str, raw: str, anchored: bool) -> float:
    """1 - edits / length of a whole path; of an open one, of the read's start against it."""
    if anchored:
        return 1 - align.align(path, raw)["dist"] / max(len(path), len(raw), 1)
    short, long = (path, raw[: int(len(path) * (1 + MAX_EDITS))]) if len(path) < len(raw) else (raw, path)
    return min(max(1 - align.align(short, long, "HW")["dist"] / max(len(short), 1), 0.0), 1.0)


def consensus(forward: tuple, backward: tuple, raw: str) -> tuple[str, str] | None:
    """Of two corrections of a region (seq, qual, which letters of raw are replaced) one, spliced by runs; None if neither is any good.

    One that replaced nothing gives way to the other. Of two, one over a quarter of edits gives way, and if both are there is none.
    Else raw is gone through: at each place the correction with the longer replaced run from there is taken for that run, that of
    more replaced letters (the forward one on a tie) where they are equal; where neither has one, up to where the first begins. A splice
    over a quarter of edits gives way to the one of more replaced letters.
    """
    rate = lambda s: align.align(s, raw)["dist"] / max(len(s), len(raw), 1)
    n_f, n_b = int(forward[2].sum()), int(backward[2].sum())
    if not n_f or not n_b:
        return forward[:2] if n_f else backward[:2] if n_b else None
    if n_b > n_f:
        forward, backward = backward, forward
    rates = rate(forward[0]), rate(backward[0])
    if max(rates) > MAX_EDITS:
        return None if min(rates) > MAX_EDITS else forward[:2] if rates[0] <= MAX_EDITS else backward[:2]
    both = forward, backward
    runs = [_run_lengths(x[2]) for x in both]
    cigars = [align.align(x[0], raw)["cigar"] for x in both]
    seq, qual, i = [], [], 0
    while i < len(raw):
        n = [int(r[i]) for r in runs]
        if max(n) > 0:
            which = 0 if n[0] >= n[1] else 1
        else:  # letters that neither replaced, up to the first that one did
            which = 1 if n[1] > n[0] else 0
        end = min(len(raw), i + abs(n[which]))
        a, b = align.slice_cigar(cigars[which], i, end)
        seq.append(both[which][0][a:b])
        qual.append(both[which][1][a:b])
        i = end
    out = "".join(seq)
    return forward[:2] if rate(out) > MAX_EDITS else (out, "".join(qual))


def _run_lengths(flags: np.ndarray) -> np.ndarray:
    """From each place on, how many letters are set, or, as a negative number, not set."""
    ends = np.append(np.flatnonzero(np.diff(flags.astype(np.int8))) + 1, len(flags))
    to_end = ends[np.searchsorted(ends, np.arange(len(flags)), side="right")] - np.arange(len(flags))
    return np.where(flags, to_end, -to_end)


def resolve_ambiguity(seq: Column, raw: Column) -> Column:
    """IUPAC letters of a corrected string become the read's base where the code allows it, in an alignment of both."""

    @F.pandas_udf("string")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _resolved(a, b) for a, b in zip(s, r, strict=True)])

    return run(seq, raw)


def _resolved(seq: str, raw: str) -> str:
    import re

    if all(c in "ACGT" for c in seq) or not raw:
        return seq
    out, i, j = [], 0, 0
    for n, op in re.findall(r"(\d+)(.)", align.align(seq, raw)["cigar"]):
        for _ in range(int(n)):
            if op in "=X":
                c, base = seq[i], raw[j]
                out.append(base if c not in "ACGT" and base in align.EQUAL.get(c, "") else c)
                i, j = i + 1, j + 1
            elif op == "I":
                out.append(seq[i])
                i += 1
            else:
                j += 1
    return "".join(out)


def insert_cycles(path: str, cycles: list[str], raw: str) -> str:
    """A path with stored cycles (start to start, as strings) put in where its start occurs, while edits to the read fall."""
    best, edits = path, align.align(path, raw)["dist"]
    while True:
        tries = [best[: at + 1] + c[1:] + best[at + 1 :] for c in cycles if c for at in range(len(best)) if best[at] == c[0] == c[-1]]
        scored = min(((align.align(t, raw)["dist"], t) for t in tries), default=(edits, best))
        if scored[0] >= edits:
            return best
        edits, best = scored
