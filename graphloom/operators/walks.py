"""Walks over unitigs: all gaps of all reads at once, a unitig a round, by joins with the graph's links.

An open path carries the last row of its distance matrix against the read, so a step costs its own letters only.
The graph is never gathered: a round joins open paths with links, and with the vertices that a gap's colours allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import align
from graphloom.functions.dna import revcomp
from graphloom.operators.graph import dealt
from graphloom.storage import fresh_path

SHARE = 0.25
EDITS = 0.25
REACHED = "row binary, low int, cut int, dist int"


def sides(tigs: DataFrame) -> DataFrame:
    """(v, unitig_id, fwd, seq, n_kmers): both readings of each unitig; v names the reading."""
    fwd = tigs.select("unitig_id", F.lit(True).alias("fwd"), "seq", "n_kmers")
    both = fwd.union(tigs.select("unitig_id", F.lit(False), revcomp(F.col("seq")), "n_kmers"))
    return both.select(F.xxhash64("unitig_id", "fwd").alias("v"), "unitig_id", "fwd", "seq", "n_kmers")


def placed(hits: DataFrame, tigs: DataFrame) -> DataFrame:
    """hits (…, unitig_id, dist, strand) with v, the reading that they go along, and off, the place in it."""
    n = hits.join(tigs.select("unitig_id", "n_kmers"), "unitig_id")
    off = F.when(F.col("strand"), F.col("dist")).otherwise(F.col("n_kmers") - 1 - F.col("dist"))
    return n.withColumn("v", F.xxhash64("unitig_id", "strand")).withColumn("off", off).drop("n_kmers")


def steps(both: DataFrame, k: int, most: int) -> DataFrame:
    """(u, v, ext): readings that follow one another by k - 1 letters; ext is what v adds, ``most`` letters at most."""
    left = both.select(F.col("v").alias("u"), F.expr(f"right(seq, {k - 1})").alias("overlap"))
    right = both.select("v", F.substring("seq", 1, k - 1).alias("overlap"), F.substring("seq", k, most).alias("ext"))
    return left.join(right, "overlap").select("u", "v", "ext")


def supported_steps(links: DataFrame, both: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """Links whose unitigs share ``least`` colours. pairs: (unitig_id, color), each once."""
    of = both.select("v", "unitig_id")
    named = links.join(of.select(F.col("v").alias("u"), F.col("unitig_id").alias("a")), "u").join(of.withColumnRenamed("unitig_id", "b"), "v")
    ends = named.select("a", "b").distinct()
    left = ends.join(pairs.withColumnRenamed("unitig_id", "a"), "a")
    good = left.join(pairs.withColumnRenamed("unitig_id", "b"), ["b", "color"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return named.join(good.select("a", "b"), ["a", "b"], "left_semi").select(*links.columns)


def unitig_links(links: DataFrame, both: DataFrame) -> DataFrame:
    """(u, v) of unitigs, each once, for links of readings."""
    of = both.select("v", "unitig_id")
    named = links.join(of.select(F.col("v").alias("u"), F.col("unitig_id").alias("a")), "u").join(of.withColumnRenamed("unitig_id", "b"), "v")
    return named.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def allowed(chosen: DataFrame, both: DataFrame, pairs: DataFrame, least: int = 2, wanted: DataFrame | None = None) -> DataFrame:
    """(gap, v, n): readings of unitigs that carry n, ``least`` or more, of a gap's chosen colours. chosen: (gap, color), pairs: (unitig_id, color), each once.

    wanted: the (gap, v) that are asked for. With it the rows are those times a unitig's colours; without it every unitig of each chosen colour is met,
    after the colours are dealt by gap: where pairs are broadcast, nothing but them is shuffled.
    """
    if wanted is None:
        good = dealt(chosen, "gap", 50_000).join(pairs, "color").groupBy("gap", "unitig_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        return good.join(both.select("unitig_id", "v"), "unitig_id").select("gap", "v", "n")
    own = wanted.distinct().join(both.select("v", "unitig_id"), "v").join(pairs, "unitig_id").join(chosen, ["gap", "color"])
    return own.groupBy("gap", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def length_window(n: Column, k: int, share: float = SHARE) -> tuple[Column, Column]:
    """Least and greatest length of a path for a stretch of n letters, anchors included."""
    inner = F.greatest(n - k, F.lit(0))
    return F.greatest(inner * (1 - share), F.lit(1)).cast("int") + k, F.greatest(F.greatest(inner * (1 + share), F.lit(1)).cast("int"), F.lit(10)) + k


def reached(row: pd.Series, ext: pd.Series, raw: pd.Series, had: pd.Series, least: pd.Series, most: pd.Series, stop: pd.Series, is_open: pd.Series) -> pd.DataFrame:
    """Takes a path on by ext. row: of ``had`` letters, or null before the first.

    low: the least distance to any prefix of the read. cut, dist: the length at which the path may end, and its distance
    to all of the read there: after ``stop`` letters of ext, or, of an open path, where it is closest.
    """
    out, costs = [], {}
    for r, e, s, h, a, b, t, o in zip(row, ext, raw, had, least, most, stop, is_open, strict=True):
        cost = costs.get(s)
        if cost is None:
            costs.clear()
            cost = costs[s] = align.mismatches(s)
        now = np.arange(len(s) + 1, dtype=np.int32) if r is None else np.frombuffer(r, np.int32)
        rows, last = [], now
        for c in e[: max(0, b - h)]:
            last = align.next_row(last, cost[c])
            rows.append(last)
        cut = dist = None
        if o:
            ends = [(int(x[-1]) / max(h + i, len(s)), h + i, int(x[-1])) for i, x in enumerate(rows, 1) if a <= h + i <= b]
            if ends:
                _, cut, dist = min(ends)
        elif t is not None and t == t and 0 < t <= len(rows) and a <= h + t <= b:
            cut, dist = int(h + t), int(rows[int(t) - 1][-1])
        out.append((last.tobytes(), int(last.min()), cut, dist))
    return pd.DataFrame(out, columns=["row", "low", "cut", "dist"]).astype({"cut": "Int32", "dist": "Int32"})


def leading(new: DataFrame) -> DataFrame:
    """Rows (hop, v, path, row, goes_on, …) with goes_on taken from open paths that can't be among the two closest of their hop in the end.

    Paths of one length that end with the same unitig go on in the same ways, and the distance of what becomes of them is the least sum of a cell of their row
    and what it costs from there, which is the same for all. So only paths that are, by distance and then by letters, one of the first two in some cell go on:
    twice the read's letters at most for a unitig and a length, however many lead there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            on = t.column("goes_on").to_numpy().copy()
            path, row = t.column("path"), t.column("row")
            for a, z in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                own = a + np.flatnonzero(on[a:z])
                if len(own) < 3:
                    continue
                own = own[np.argsort(np.array(path.take(own).to_pylist(), dtype=object), kind="stable")]
                cells = np.stack([np.frombuffer(r, np.int32) for r in row.take(own).to_pylist()])
                on[own] = False
                on[own[np.argsort(cells, axis=0, kind="stable")[:2].ravel()]] = True
            yield from t.set_column(t.schema.get_field_index("goes_on"), "goes_on", pa.array(on)).combine_chunks().to_batches()

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if not held.num_rows:
                continue
            keys = [held.column("hop").combine_chunks().dictionary_encode().indices.to_numpy(), held.column("v").to_numpy(), pc.utf8_length(held.column("path")).to_numpy()]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            if len(starts) > 1:
                yield from done(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from done(held, np.zeros(1, np.int64))

    dealt = new.withColumn("__length", F.length("path")).repartition("hop", "v", "__length").sortWithinPartitions("hop", "v", "__length").drop("__length")
    return dealt.mapInArrow(run, new.schema)


def walk(gaps: DataFrame, both: DataFrame, links: DataFrame, k: int, colors: tuple[DataFrame, DataFrame, int] | None = None, share: float = SHARE, edits: float | None = EDITS, beam: int | None = None) -> DataFrame:
    """(hop, path, score, second, other): the closest path of each gap that has one, and the score and path of the next closest.

    gaps: (hop, gap, raw, u, off, w, w_off): raw from anchor to anchor, both included; u, w: readings that the anchors
    lie on and where; w null for a gap without a right anchor, which may end anywhere. colors: (chosen, pairs, least) as
    ``allowed`` takes them, looked up for the unitigs that a round reaches; None for any step.
    A path ends in the right anchor with a length within ``share`` of the read's; paths over ``edits`` of their length to all of the read's
    prefixes go, which takes none that would be close enough at its end. With ``beam`` a gap keeps its so many closest open paths a round, else all
    that ``leading`` finds: none of the two closest is lost.
    score = 1 - distance / the greater length. Of equally close paths the shortest, then the least.
    """
    spark = gaps.sparkSession
    least, most = length_window(F.length("raw"), k, share)
    todo = gaps.withColumns({"least": least, "most": most, "is_open": F.col("w").isNull()})
    seq = both.select(F.col("v").alias("u"), "seq")
    first = todo.join(seq, "u").withColumns({"had": F.lit(0), "path": F.lit(""), "row": F.lit(None).cast("binary"), "v": F.col("u"), "ext": F.expr("substring(seq, off + 1, most)"), "stop": F.when((F.col("u") == F.col("w")) & (F.col("w_off") >= F.col("off")), F.col("w_off") - F.col("off") + k)})
    folder, number = fresh_path(spark, "walks"), 0
    todo = todo.select("hop", "gap", "raw", "w", "w_off", "least", "most", "is_open")
    now = first
    place = F.row_number().over(Window.partitionBy("hop").orderBy(F.col("rate"), F.length("path"), "path"))
    while True:
        at = F.pandas_udf(reached, REACHED)("row", "ext", "raw", "had", "least", "most", "stop", "is_open")
        new = now.select("hop", "gap", F.concat("path", F.expr("left(ext, greatest(0, most - had))")).alias("path"), "v", "raw", "most", at.alias("at")).select("hop", "gap", "path", "v", F.length("raw").alias("n"), "most", "at.*")
        goes_on = (F.length("path") < F.col("most")) if edits is None else (F.length("path") < F.col("most")) & (F.col("low") <= edits * F.greatest("n", "most"))
        new = new.withColumn("goes_on", goes_on).where("goes_on or cut is not null").withColumn("rate", F.when(F.col("goes_on"), F.col("low") / F.length("path")).otherwise(2.0))
        kept = leading(new.drop("rate", "most")) if beam is None else new.withColumn("goes_on", F.col("goes_on") & (place <= beam)).drop("rate", "most")
        kept.write.parquet(f"{folder}/round={number}")
        state = spark.read.parquet(f"{folder}/round={number}")
        ahead = state.where("goes_on")
        if ahead.isEmpty():
            break
        onward = ahead.select("hop", "gap", "path", F.col("v").alias("u"), "row").join(links, "u").drop("u")
        if colors is not None:
            chosen, pairs, need = colors
            onward = onward.join(allowed(chosen, both, pairs, need, onward.select("gap", "v")), ["gap", "v"], "left_semi")
        now = onward.join(todo.drop("gap"), "hop").withColumns({"had": F.length("path"), "stop": F.when(F.col("v") == F.col("w"), F.col("w_off") + 1)})
        number += 1
    done = spark.read.parquet(folder).where("cut is not null").select("hop", F.expr("left(path, cut)").alias("path"), (1 - F.col("dist") / F.greatest("cut", "n")).alias("score")).distinct()
    ranked = done.withColumn("place", F.row_number().over(Window.partitionBy("hop").orderBy(F.col("score").desc(), F.length("path"), "path")))
    best = ranked.where("place <= 2").groupBy("hop").agg(F.max(F.when(F.col("place") == 1, F.col("path"))).alias("path"), F.max("score").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("place") == 2, F.col("path"))).alias("other"))
    return best
