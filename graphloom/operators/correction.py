"""Gaps between anchors of long reads, and what is done with corrected ones: trimming and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.dna import QUAL_BASE


def regions(anchors: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(read_id, kind, start, stop, left, right, raw): gaps between neighbouring anchors that aren't consecutive.

    start and stop are the places of both anchors; raw is the read from one to the end of the other.
    Anchors that overlap leave no gap to correct.
    """
    order = Window.partitionBy("read_id").orderBy("pos")
    pairs = anchors.withColumn("stop", F.lead("pos").over(order)).withColumn("right", F.lead("kmer").over(order)).where(F.col("stop") - F.col("pos") >= k)
    raw = F.substring("seq", F.col("start") + 1, F.col("stop") - F.col("start") + k)
    return pairs.join(reads.select("read_id", "seq"), "read_id").select("read_id", F.lit("middle").alias("kind"), F.col("pos").alias("start"), "stop", F.col("kmer").alias("left"), "right", "seq").withColumn("raw", raw).drop("seq")


def trimmed(reads: DataFrame, key: list[str], least_qual: int, k: int, with_qual: bool = False) -> DataFrame:
    """(key, name, seq, part): maximal runs of bases of at least 33 + least_qual, k or longer, numbered from 1 as name/i; on demand with their qual."""
    place = reads.where("length(seq) > 0").select(*key, "name", "seq", "qual", F.posexplode(F.filter(F.split("qual", ""), lambda c: c != "")).alias("i", "q"))
    good = place.where(F.ascii("q") >= QUAL_BASE + least_qual)
    run = good.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i")))
    runs = run.groupBy(*key, "name", "run").agg(F.first("seq").alias("seq"), F.first("qual").alias("qual"), F.min("i").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    part = F.row_number().over(Window.partitionBy(*key).orderBy("a"))
    cut = runs.withColumn("part", part)
    own = [F.expr("substring(qual, a + 1, n)").alias("qual")] if with_qual else []
    return cut.select(*key, F.concat_ws("/", "name", "part").alias("name"), F.expr("substring(seq, a + 1, n)").alias("seq"), *own, "part")


def masked(reads: DataFrame, least: int) -> DataFrame:
    """Bases under a quality become N; reads without qualities stay."""
    letters = F.zip_with(F.filter(F.split("seq", ""), lambda c: c != ""), F.filter(F.split("qual", ""), lambda c: c != ""), lambda s, q: F.when(F.ascii(q) >= least, s).otherwise("N"))
    return reads.withColumn("seq", F.when(F.col("qual").isNull(), F.col("seq")).otherwise(F.array_join(letters, "")))
