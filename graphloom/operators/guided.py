"""Correction of the stretches between solid anchors: colours, hops from weak anchor to weak anchor, partial results, both directions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import align
from graphloom.functions.dna import QUAL_BASE, revcomp
from graphloom.operators import walks
from graphloom.operators.regions import MAX_EDITS, choose_colors_of, consensus
from graphloom.operators.seeding import around
from graphloom.storage import stored

ANCHOR = ["pos", "kmer", "v", "rv", "off", "roff"]


def anchors(hits: DataFrame, tigs: DataFrame, kmer: str = "kmer") -> DataFrame:
    """(read_id, pos, kmer, unitig_id, v, rv, off, roff): hits with the reading that they go along, the other one, and the places in both."""
    both = hits.join(tigs.select("unitig_id", "n_kmers"), "unitig_id")
    a, b = F.col("dist"), F.col("n_kmers") - 1 - F.col("dist")
    return both.select(
        "read_id", "pos", F.col(kmer).alias("kmer"), "unitig_id", F.xxhash64("unitig_id", "strand").alias("v"), F.xxhash64("unitig_id", ~F.col("strand")).alias("rv"),
        F.when(F.col("strand"), a).otherwise(b).alias("off"), F.when(F.col("strand"), b).otherwise(a).alias("roff"),
    )


def stretches(solid: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(gap, read_id, kind, start, stop, raw, u, off, w, w_off, kmer): what lies between neighbouring solid anchors, and before and after them.

    start and stop are the places of both anchors, raw the read from one to the end of the other; a head is turned round. w is null
    where there is no right anchor. kmer: the left anchor's. Neighbours that follow on directly leave nothing between them.
    """
    order = Window.partitionBy("read_id").orderBy("pos")
    nexts = {f"n_{c}": F.lead(c).over(order) for c in ("pos", "v", "off")}
    row = solid.select("read_id", *ANCHOR).withColumns(nexts).withColumn("before", F.lag("pos").over(order)).join(reads.select("read_id", "seq"), "read_id")
    none, n = F.lit(None), F.length("seq")
    middle = row.where("n_pos > pos + 1").select("read_id", F.lit("middle").alias("kind"), F.col("pos").alias("start"), F.col("n_pos").alias("stop"), F.expr(f"substring(seq, pos + 1, n_pos - pos + {k})").alias("raw"), F.col("v").alias("u"), "off", F.col("n_v").alias("w"), F.col("n_off").alias("w_off"), "kmer")
    tail = row.where(F.col("n_pos").isNull() & (n > F.col("pos") + k)).select("read_id", F.lit("tail"), "pos", n - k, F.expr("substring(seq, pos + 1)"), "v", "off", none.cast("long"), none.cast("int"), "kmer")
    head = row.where("before is null and pos > 0").select("read_id", F.lit("head"), F.lit(0), "pos", revcomp(F.expr(f"substring(seq, 1, pos + {k})")), "rv", "roff", none.cast("long"), none.cast("int"), revcomp(F.col("kmer")))
    return middle.union(tail).union(head).withColumn("gap", F.concat_ws(":", "read_id", "kind", "start"))


def color_candidates(gaps: DataFrame, solid: DataFrame, weak: DataFrame, stats: DataFrame, insert: int, most_cov: float, branching_sets: int = 5) -> DataFrame:
    """(gap, side, unitig_id, branching): unitigs whose colours may guide a gap, once a side.

    left and right: solid and weak anchors less than ``insert`` before and beyond; inner: weak ones inside. Unitigs of ``most_cov`` or more
    go; a side keeps its ``branching_sets`` nearest branching ones. An open side has none. stats: (unitig_id, cov, branching).
    """
    at = F.col("start"), F.col("stop")
    left = gaps.where("kind != 'head'").select("gap", "read_id", F.lit("left").alias("side"), (at[0] - insert + 1).alias("low"), at[0].alias("high"))
    right = gaps.where("kind != 'tail'").select("gap", "read_id", F.lit("right").alias("side"), at[1].alias("low"), (at[1] + insert - 1).alias("high"))
    low = F.when(F.col("kind") == "head", F.lit(0)).otherwise(at[0])
    inner = gaps.select("gap", "read_id", F.lit("inner").alias("side"), low.alias("low"), (F.col("stop") - F.when(F.col("kind") == "tail", 0).otherwise(1)).alias("high"))
    here = lambda df, solid: df.select("read_id", "pos", "unitig_id", F.lit(solid).alias("solid"))
    outer = around(left.union(right), here(solid, True).union(here(weak, False)), insert)
    found = outer.select("gap", "side", "unitig_id", F.when(F.col("side") == "left", -F.col("pos")).otherwise(F.col("pos")).alias("far"), "solid")
    found = found.union(around(inner, here(weak, False), insert).select("gap", "side", "unitig_id", F.lit(0), "solid"))
    once = found.groupBy("gap", "side", "unitig_id").agg(F.min(F.struct(~F.col("solid"), "far")).alias("far")).join(stats.where(F.col("cov") < most_cov).select("unitig_id", "branching"), "unitig_id")
    place = F.row_number().over(Window.partitionBy("gap", "side", "branching").orderBy("far", "unitig_id"))
    return once.withColumn("place", place).where(~F.col("branching") | (F.col("side") == "inner") | (F.col("place") <= branching_sets)).select("gap", "side", "unitig_id", "branching")


def chosen_colors(candidates: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """(gap, color): the colours to follow through each gap; gaps with fewer than ``least`` have none. pairs: (unitig_id, color)."""
    picked = choose_colors_of(candidates.withColumnRenamed("unitig_id", "vertex"), pairs.withColumnRenamed("unitig_id", "vertex"), "gap").where(F.size("colors") >= least)
    return picked.select("gap", F.explode("colors").alias("color"))


def in_gaps(gaps: DataFrame, weak: DataFrame, k: int) -> DataFrame:
    """(gap, at, kmer, v, off, rv, roff): weak anchors of a gap by their place from its start, along it; of one place the least k-mer."""
    first = weak.groupBy("read_id", "pos").agg(F.min(F.struct("kmer", "v", "off", "rv", "roff")).alias("x"))
    marks = gaps.select("read_id", F.col("start").alias("pos"), F.struct("gap", "kind", "start", "stop").alias("g"), F.lit(None).cast("int").alias("x_pos"), F.lit(None).cast(first.schema["x"].dataType).alias("x"))
    rows = marks.union(first.select("read_id", "pos", F.lit(None).cast(marks.schema["g"].dataType), "pos", "x"))
    last = F.last("g", ignorenulls=True).over(Window.partitionBy("read_id").orderBy("pos", F.col("x_pos").isNotNull()))
    own = rows.withColumn("g", last).where("x is not null and g is not null and pos < g.stop").select("g.*", "pos", "x.*")
    head = F.col("kind") == "head"
    turned = lambda a, b: F.when(head, F.col(b)).otherwise(F.col(a))
    at = F.when(head, F.col("stop") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    return own.select("gap", at.alias("at"), F.when(head, revcomp(F.col("kmer"))).otherwise(F.col("kmer")).alias("kmer"), turned("v", "rv").alias("v"), turned("off", "roff").alias("off"), turned("rv", "v").alias("rv"), turned("roff", "off").alias("roff"))


def chains(now: DataFrame, weak: DataFrame, k: int) -> DataFrame:
    """(gap, hop, i, at, to, raw, u, off, w, w_off, kmer): hops from anchor to anchor, at least k apart, to the end of each gap.

    now: (gap, raw, w, w_off, at, v, off, kmer): where each gap goes on from. weak: (gap, at, kmer, v, off).
    """
    end = F.length("raw") - k
    own = now.select("gap", "raw", "w", "w_off", F.col("at").alias("from"), F.struct("at", "v", "off", "kmer").alias("first"))
    some = own.join(weak.select("gap", F.struct("at", "v", "off", "kmer").alias("a")), "gap", "left").groupBy("gap").agg(F.sort_array(F.collect_list("a")).alias("all"))
    rows = own.join(some, "gap").withColumn("end", end)
    step = lambda acc, x: F.when((x["at"] >= F.element_at(acc, -1)["at"] + k) & (x["at"] < F.col("end") - k), F.concat(acc, F.array(x))).otherwise(acc)
    picked = rows.withColumn("stops", F.aggregate("all", F.array("first"), step))
    last = F.struct(F.col("end").alias("at"), F.col("w").alias("v"), F.col("w_off").alias("off"), F.lit(None).cast("string").alias("kmer"))
    each = picked.select("gap", "raw", "end", F.posexplode(F.arrays_zip("stops", F.expr("slice(stops, 2, size(stops))").alias("later"))).alias("i", "p"), last.alias("last"))
    to = F.coalesce("p.later", "last")
    hop = each.select("gap", F.concat_ws("/", "gap", "p.stops.at").alias("hop"), "i", F.col("p.stops.at").alias("at"), to["at"].alias("to"), "raw", F.col("p.stops.v").alias("u"), F.col("p.stops.off").alias("off"), to["v"].alias("w"), to["off"].alias("w_off"), F.col("p.stops.kmer").alias("kmer"))
    return hop.withColumn("raw", F.expr(f"substring(raw, at + 1, to - at + {k})"))


def prefix_end(path: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Distance of a path to the start of the read that is nearest to it, and the first place where such a start ends."""
    out = []
    for p, r in zip(path, raw, strict=True):
        row = align.last_row(p, r)
        out.append((int(row.min()), int(row.argmin()) - 1))
    return pd.DataFrame(out, columns=["dist", "last"])


def prefix_length(raw: pd.Series, seq: pd.Series) -> pd.Series:
    """How much of seq the whole of raw lies at, at its start: the greatest length of least distance."""
    out = []
    for r, s in zip(raw, seq, strict=True):
        row = align.last_row(r, s)
        out.append(len(row) - 1 - int(row[::-1].argmin()))
    return pd.Series(out, dtype="int32")


def path_qualities(path: Column, raw: Column, score: Column, second: Column, top: int) -> Column:
    """A quality for each letter of a path: that of its score where the read has the same letter, else of its lead over the next path."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, raws: pd.Series, scores: pd.Series, seconds: pd.Series) -> pd.Series:
        out = []
        for p, r, a, b in zip(paths, raws, scores, seconds, strict=True):
            if p is None:
                out.append(None)
                continue
            high = chr(int(min(a, 1.0) * top) + QUAL_BASE)
            low = chr(int(min(max(a - (b if b == b and b is not None else 0.0), 0.0), 1.0) * (top - 1)) + QUAL_BASE + 1)
            out.append("".join((high if op == "=" else low) for op in align.operations(p, r, "SHW") if op != "D"))
        return pd.Series(out, dtype=object)

    return run(path, raw, score, second)


def attempt(gaps: DataFrame, weak: DataFrame, both: DataFrame, links: DataFrame, colors: tuple[DataFrame, DataFrame, int] | None, k: int, longest: int, top: int = 40, share: float = walks.SHARE, beam: int = 512) -> DataFrame:
    """(gap, seq, qual, runs, complete): one direction of each gap.

    gaps: (gap, raw, u, off, w, w_off, kmer); weak: (gap, at, kmer, v, off). All hops of all gaps are walked at once. What a chain reaches before its first
    hole stands if it has at most a quarter of edits to the read; then the next weak anchor k beyond it goes on, the read's own bases
    between them, and so in rounds until no gap goes on. runs: the stretches of raw (a, b) that are replaced. complete: all of raw is, and seq
    ends in the right anchor. Others end where the read's end fits their end best. ``raw_qual`` (a column of gaps, may be null) holds the bases' own qualities.
    """
    least_qual, greatest = chr(QUAL_BASE), chr(QUAL_BASE + top)
    own = F.coalesce("raw_qual", F.expr(f"repeat('{least_qual}', length(raw))"))
    fixed = stored(gaps.select("gap", "raw", own.alias("raw_qual"), "w", "w_off"), "gaps")
    empty = F.lit("")
    now = stored(gaps.select("gap", F.lit(0).alias("at"), F.col("u").alias("v"), "off", "kmer", empty.alias("seq"), empty.alias("qual"), F.expr("cast(array() as array<struct<a: int, b: int>>)").alias("runs")), "gaps-now")
    weak = stored(weak.select("gap", "at", "kmer", "v", "off"), "gaps-weak")
    done: list[DataFrame] = []
    while not now.isEmpty():
        here = now.join(fixed, "gap")
        hops = stored(chains(here, weak, k), "hops")
        limit = F.when(F.col("w").isNull(), longest // 2).otherwise(longest)
        found = walks.walk(hops.where(F.length("raw") <= limit).select("hop", "gap", "raw", "u", "off", "w", "w_off"), both, links, k, colors, share, beam=beam)
        hop = hops.select("gap", "hop", "i", "raw", "kmer").join(found, "hop", "left")
        hop = hop.withColumn("q", path_qualities(F.col("path"), F.col("raw"), F.col("score"), F.col("second"), top))
        sorted_hops = F.sort_array(F.collect_list(F.struct("i", "path", "q", "kmer"))).alias("hops")
        chain = hop.groupBy("gap").agg(sorted_hops, F.min(F.when(F.col("path").isNull(), F.col("i"))).alias("hole"))
        ok = F.filter("hops", lambda x: F.col("hole").isNull() | (x["i"] < F.col("hole")))
        joined = lambda name: F.array_join(F.transform(ok, lambda x: F.when(x["i"] == 0, x[name]).otherwise(F.substring(x[name], k + 1, 1 << 30))), "")
        first = F.col("hops")[0]["kmer"]
        chain = chain.select("gap", "hole", F.when(F.size(ok) == 0, first).otherwise(joined("path")).alias("path"), joined("q").alias("q"))
        q = F.concat(F.lit(greatest * k), F.expr(f"substring(q, {k + 1})"))
        state = here.join(chain, "gap").withColumn("q", q).withColumn("rest", F.expr("substring(raw, at + 1)"))
        state = stored(state.withColumn("end", F.pandas_udf(prefix_end, "dist int, last int")("path", "rest")), "gaps-state")
        whole = state.where("hole is null").select("gap", F.concat("seq", "path").alias("seq"), F.concat("qual", "q").alias("qual"), F.concat("runs", F.array(F.struct(F.col("at").alias("a"), F.length("raw").alias("b")))).alias("runs"))
        part = state.where("hole is not null")
        bad = part.where(F.col("end.dist") > MAX_EDITS * F.length("path"))
        raw_from = lambda c, a: F.expr(f"substring({c}, {a} + 1)")
        given_up = bad.select("gap", F.concat("seq", raw_from("raw", "at")).alias("seq"), F.concat("qual", raw_from("raw_qual", "at")).alias("qual"), "runs")
        good = part.where(F.col("end.dist") <= MAX_EDITS * F.length("path")).withColumn("upto", F.col("at") + F.col("end.last") + 1)
        good = good.withColumns({"seq": F.concat("seq", "path"), "qual": F.concat("qual", "q"), "runs": F.concat("runs", F.array(F.struct(F.col("at").alias("a"), F.col("upto").alias("b"))))})
        reach = weak.select("gap", F.struct("at", "v", "off", "kmer").alias("x"))
        later = good.select("gap", "at", "upto", F.length("raw").alias("n")).join(reach, "gap").where((F.col("x.at") >= F.col("upto") + k - 1) & (F.col("x.at") < F.col("n") - 2 * k) & (F.col("x.at") - F.col("at") < longest))
        nexts = later.groupBy("gap").agg(F.min("x").alias("x"))
        good = stored(good.select("gap", "raw", "raw_qual", "seq", "qual", "runs", "upto").join(nexts, "gap", "left"), "gaps-good")
        ended = good.where("x is null").select("gap", F.concat("seq", raw_from("raw", "upto")).alias("seq"), F.concat("qual", raw_from("raw_qual", "upto")).alias("qual"), "runs")
        between = lambda c: F.expr(f"substring({c}, upto + 1, x.at - upto)")
        done.append(stored(whole.union(given_up).union(ended), "gaps-done"))
        now = stored(good.where("x is not null").select("gap", "x.at", "x.v", "x.off", "x.kmer", F.concat("seq", between("raw")).alias("seq"), F.concat("qual", between("raw_qual")).alias("qual"), "runs"), "gaps-now")
    if not done:
        return gaps.sparkSession.createDataFrame([], "gap string, seq string, qual string, runs array<struct<a: int, b: int>>, complete boolean")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    covered = F.aggregate("runs", F.lit(0), lambda acc, x: acc + x["b"] - x["a"])
    out = out.join(fixed.select("gap", "raw", "w"), "gap")
    complete = (covered == F.length("raw")) & (F.col("w").isNull() | (F.expr(f"right(seq, {k})") == F.expr(f"right(raw, {k})")))
    out = out.withColumn("complete", complete)
    n = F.when(F.col("complete"), F.length("seq")).otherwise(F.pandas_udf(prefix_length, "int")("raw", "seq"))
    return out.withColumn("n", n).select("gap", F.expr("left(seq, n)").alias("seq"), F.expr("left(qual, n)").alias("qual"), "runs", "complete")


def turned(gaps: DataFrame, weak: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Middle gaps and their weak anchors from the other end. gaps also has r_u, r_off, r_w, r_w_off and r_kmer: both anchors on the other strand."""
    n = gaps.select("gap", F.length("raw").alias("n"))
    back = gaps.select("gap", revcomp(F.col("raw")).alias("raw"), F.reverse("raw_qual").alias("raw_qual"), F.col("r_u").alias("u"), F.col("r_off").alias("off"), F.col("r_w").alias("w"), F.col("r_w_off").alias("w_off"), F.col("r_kmer").alias("kmer"))
    other = weak.join(n, "gap").select("gap", (F.col("n") - k - F.col("at")).alias("at"), revcomp(F.col("kmer")).alias("kmer"), F.col("rv").alias("v"), F.col("roff").alias("off"))
    return back, other


def agreed(both_ways: DataFrame) -> DataFrame:
    """(gap, seq, qual): of two incomplete corrections of a gap what ``regions.consensus`` makes of them; none where it makes nothing.

    both_ways: (gap, raw, f_seq, f_qual, f_runs, b_seq, b_qual, b_runs), all along the gap.
    """

    @F.pandas_udf("seq string, qual string")
    def run(raw: pd.Series, fs: pd.Series, fq: pd.Series, fr: pd.Series, bs: pd.Series, bq: pd.Series, br: pd.Series) -> pd.DataFrame:
        out = [consensus((s, q, _covered(a, len(r))), (t, p, _covered(b, len(r))), r) for r, s, q, a, t, p, b in zip(raw, fs, fq, fr, bs, bq, br, strict=True)]
        return pd.DataFrame([x or (None, None) for x in out], columns=["seq", "qual"])

    texts = [F.to_json(F.col(c)) for c in ("f_runs", "b_runs")]
    x = run("raw", "f_seq", "f_qual", texts[0], "b_seq", "b_qual", texts[1])
    return both_ways.select("gap", x.alias("x")).select("gap", "x.*").where("seq is not null")


def _covered(runs: str, n: int) -> np.ndarray:
    import json

    out = np.zeros(n, bool)
    for x in json.loads(runs):
        out[x["a"] : x["b"]] = True
    return out


def corrected_gaps(gaps: DataFrame, weak: DataFrame, both: DataFrame, links: DataFrame, colors: tuple[DataFrame, DataFrame, int] | None, k: int, longest: int, top: int = 40, share: float = walks.SHARE, beam: int = 512) -> DataFrame:
    """(gap, seq, qual): each gap's correction along itself, where there is one.

    Gaps that the forward direction doesn't complete are tried from the other end, if they have an anchor there; a complete result stands, of two incomplete
    ones the longer corrected run at each place.
    """
    ahead = stored(attempt(gaps, weak, both, links, colors, k, longest, top, share, beam), "forward")
    half = stored(gaps.where("w is not null").join(ahead.where("not complete").select("gap"), "gap", "left_semi"), "half-done")
    back_gaps, back_weak = turned(half, weak.join(half.select("gap"), "gap", "left_semi"), k)
    back = attempt(back_gaps, back_weak, both, links, colors, k, longest, top, share, beam)
    n = half.select("gap", "raw", F.length("raw").alias("n"))
    mirrored = F.transform("runs", lambda x: F.struct((F.col("n") - x["b"]).alias("a"), (F.col("n") - x["a"]).alias("b")))
    back = stored(back.join(n, "gap").select("gap", "raw", revcomp(F.col("seq")).alias("b_seq"), F.reverse("qual").alias("b_qual"), mirrored.alias("b_runs"), "complete"), "backward")
    open_end = ahead.join(half.select("gap"), "gap", "left_anti").select("gap", "seq", "qual")
    by_back = back.where("complete").select("gap", F.col("b_seq").alias("seq"), F.col("b_qual").alias("qual"))
    two = back.where("not complete").drop("complete").join(ahead.select("gap", F.col("seq").alias("f_seq"), F.col("qual").alias("f_qual"), F.col("runs").alias("f_runs")), "gap")
    return open_end.union(by_back).union(agreed(two))


def along_unitig(gaps: DataFrame, both: DataFrame, k: int, share: float = walks.SHARE) -> DataFrame:
    """(gap, path): gaps whose anchors lie on one reading of a unitig; path is null where order or length don't fit, and the gap stays as it is.

    The length between the anchors is within ``share`` of that on the unitig.
    """
    one = gaps.where("u = w").join(both.select(F.col("v").alias("u"), "seq"), "u")
    span, own = F.col("w_off") - F.col("off"), F.col("stop") - F.col("start")
    fits = (span > 0) & (own >= F.greatest(span * (1 - share), F.lit(1)).cast("int")) & (own <= F.greatest(span * (1 + share), F.lit(1)).cast("int"))
    return one.select("gap", F.when(fits, F.expr(f"substring(seq, off + 1, w_off - off + {k})")).alias("path"))


def stitched(reads: DataFrame, solid: DataFrame, gaps: DataFrame, fixed: DataFrame, k: int, top: int = 40) -> DataFrame:
    """(read_id, name, seq, qual): reads with corrected gaps. fixed: (gap, seq, qual) along each gap.

    Where reads have a quality it stays on the read's own bases; else bases under a solid anchor have the greatest, others the least.
    Reads without anchors pass through. Rows of null read ids are lost: ids come with the reads.
    """
    own = "qual" if "qual" in reads.columns else None
    base = reads.select("read_id", "name", F.coalesce("seq", F.lit("")).alias("seq"), (F.col(own) if own else F.lit(None).cast("string")).alias("q0"))
    order = Window.partitionBy("read_id").orderBy("pos")
    under = solid.select("read_id", "pos").distinct().withColumn("fresh", F.coalesce((F.col("pos") > F.lag("pos").over(order) + k).cast("int"), F.lit(0)))
    runs = under.withColumn("run", F.sum("fresh").over(order)).groupBy("read_id", "run").agg(F.min("pos").alias("a"), (F.max("pos") + k).alias("b"))
    runs = runs.withColumn("before", F.coalesce(F.lag("b").over(Window.partitionBy("read_id").orderBy("a")), F.lit(0)))
    low, high = chr(QUAL_BASE), chr(QUAL_BASE + top)
    piece = F.struct("a", F.expr(f"concat(repeat('{low}', a - before), repeat('{high}', b - a))").alias("q"))
    solid_q = runs.groupBy("read_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["q"]), "").alias("q"))
    base = base.join(solid_q, "read_id", "left").withColumn("q0", F.coalesce("q0", F.expr(f"rpad(coalesce(q, ''), length(seq), '{low}')"))).drop("q")
    step = gaps.select("gap", "read_id", "kind", "start", "stop").join(fixed, "gap")
    head, tail = F.col("kind") == "head", F.col("kind") == "tail"
    text = F.when(head, revcomp(F.col("seq"))).otherwise(F.col("seq"))
    q = F.when(head, F.reverse("qual")).otherwise(F.col("qual"))
    keep = F.length("seq") - F.when(tail, 0).otherwise(k)
    step = step.select("read_id", F.col("start").alias("a"), F.when(tail, F.lit((1 << 31) - 1)).otherwise(F.col("stop")).alias("b"), F.substring(text, F.lit(1), keep).alias("text"), F.substring(q, F.lit(1), keep).alias("q"))
    step = step.withColumn("before", F.coalesce(F.lag("b").over(Window.partitionBy("read_id").orderBy("a")), F.lit(0)))
    steps = step.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("a", "before", "text", "q"))).alias("steps"), F.max("b").alias("last"))
    rows = base.join(steps, "read_id", "left")
    whole = lambda c, name: F.concat(F.array_join(F.transform(F.coalesce("steps", F.array()), lambda x: F.concat(F.substring(F.col(c), x["before"] + 1, x["a"] - x["before"]), x[name])), ""), F.when(F.coalesce("last", F.lit(0)) < F.length("seq"), F.substring(F.col(c), F.coalesce("last", F.lit(0)) + 1, F.length("seq"))).otherwise(F.lit("")))
    return rows.select("read_id", "name", whole("seq", "text").alias("seq"), whole("q0", "q").alias("qual"))
