"""Seeds of long reads on the graph: exact hits, the gaps that are worth an inexact search, inexact hits, and what they void."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import kmers


Index = DataFrame | Callable[[DataFrame], DataFrame]  # (kmer, unitig_id, dist, strand) of the graph's k-mers, or what gives those of a table (kmer)


def _looked_up(found: DataFrame, index: Index, kmer: str) -> DataFrame:
    known = index(found.select(F.col(kmer).alias("kmer")).distinct()) if callable(index) else index
    return found.join(known.withColumnRenamed("kmer", kmer), kmer)


def exact_hits(reads: DataFrame, index: Index, k: int) -> DataFrame:
    """(read_id, pos, kmer, unitig_id, dist, strand): places of reads longer than k whose k-mer the graph has."""
    found = kmers.kmers(reads.where(F.length("seq") > k), k, ["read_id"]).select("read_id", "pos", "kmer")
    return _looked_up(found, index, "kmer").select("read_id", "pos", "kmer", "unitig_id", "dist", "strand")


def gap_classes(hits: DataFrame, reads: DataFrame, k: int, insert: int) -> DataFrame:
    """(read_id, class, before, after, start, stop): the stretches between hits that are long enough to be looked at.

    class: long, for neighbours at ``insert`` or more from one another; middle, at half of it or more; head and tail, where
    the first hit is at half of it or later, or the last as far from the end. before and after are the places of the
    neighbours; bases from start to before stop belong to no neighbour (head and tail: to all but its last or first base).
    """
    order = Window.partitionBy("read_id").orderBy("pos")
    near = hits.select("read_id", "pos").distinct().withColumn("before", F.lag("pos").over(order))
    d = F.col("pos") - F.col("before")
    inner = near.where((d * 2 >= insert) & (d > k)).select("read_id", F.when(d >= insert, "long").otherwise("middle").alias("class"), "before", F.col("pos").alias("after"), (F.col("before") + k).alias("start"), F.col("pos").alias("stop"))
    ends = hits.groupBy("read_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).join(reads.select("read_id", F.length("seq").alias("n")), "read_id")
    none = F.lit(None).cast("int")
    head = ends.where(F.col("a") * 2 >= insert).select("read_id", F.lit("head"), none, "a", F.lit(0), F.col("a") + k - 1)
    tail = ends.where((F.col("n") - F.col("b")) * 2 >= insert).select("read_id", F.lit("tail"), "b", none, F.col("b") + 1, "n")
    return inner.union(head).union(tail)


def around(windows: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """hits joined to the windows (…, read_id, low, high) that they lie in, low and high included; by cells of ``width``, as no window is much wider."""
    cells = windows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return cells.join(hits.withColumn("cell", F.floor(F.col("pos") / width)), ["read_id", "cell"]).where("pos between low and high").drop("cell", "low", "high")


def searched_stretches(classes: DataFrame, hits: DataFrame, plain_pairs: DataFrame, insert: int, least: int = 2) -> DataFrame:
    """The rows of ``gap_classes`` that the inexact search takes: all but middle gaps whose sides share colours.

    A side is the unitigs of hits up to insert - gap beyond its neighbour. plain_pairs: (unitig_id, color) of unitigs that don't branch.
    With ``least`` common colours of both sides a gap is left to the exact hits.
    """
    middle = classes.where("class = 'middle'").withColumn("reach", insert - (F.col("after") - F.col("before")))
    left = middle.select("read_id", "before", F.lit("left").alias("side"), (F.col("before") - F.col("reach") + 1).alias("low"), F.col("before").alias("high"))
    right = middle.select("read_id", "before", F.lit("right").alias("side"), F.col("after").alias("low"), (F.col("after") + F.col("reach") - 1).alias("high"))
    near = around(left.union(right), hits.select("read_id", "pos", "unitig_id"), insert).select("read_id", "before", "side", "unitig_id").distinct()
    both = near.join(plain_pairs, "unitig_id").groupBy("read_id", "before", "color").agg(F.countDistinct("side").alias("n")).where("n = 2")
    tied = both.groupBy("read_id", "before").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("read_id", "before", F.lit("middle").alias("class"))
    return classes.join(tied, ["read_id", "before", "class"], "left_anti").select(*classes.columns)


def inexact_hits(stretches: DataFrame, reads: DataFrame, index: Index, k: int) -> DataFrame:
    """(read_id, pos, kmer, near, kind, unitig_id, dist, strand): hits one edit away of the k-mers that lie in the stretches, exact ones left out."""
    inside = stretches.join(reads.select("read_id", "seq"), "read_id").select("read_id", "start", F.expr("substring(seq, start + 1, stop - start)").alias("seq"))
    each = kmers.kmers(inside, k, ["read_id", "start"], strict=True).select("read_id", (F.col("start") + F.col("pos")).alias("pos"), "kmer")
    near = kmers.neighbourhood(each, k, ["read_id"]).select("read_id", "pos", "kmer", "near", "kind")
    return _looked_up(near, index, "near").select("read_id", "pos", "kmer", "near", "kind", "unitig_id", "dist", "strand")
