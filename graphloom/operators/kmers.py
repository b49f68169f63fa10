"""k-mers of reads: explode, count, solid filter, hits and the runs they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.dna import canonical

CHUNK = 256


def kmers(reads: DataFrame, k: int, keep: list[str], seq_col: str = "seq", strict: bool = False) -> DataFrame:
    """(keep, pos, kmer, rep): every k-mer by place, from 0; those with other letters than ACGT go if strict.

    Long strings are cut into overlapping chunks first, as a substring at a far place walks the string.
    """
    seq = F.col(seq_col)
    chunks = reads.where(F.length(seq) >= k).select(*keep, seq.alias("__s"), F.explode(F.sequence(F.lit(0), F.length(seq) - k, F.lit(CHUNK))).alias("__at"))
    chunks = chunks.select(*keep, "__at", F.substring("__s", F.col("__at") + 1, F.lit(CHUNK + k - 1)).alias("__c"))
    places = chunks.select(*keep, "__at", "__c", F.explode(F.sequence(F.lit(0), F.length("__c") - k)).alias("__i"))
    out = places.select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), F.substring("__c", F.col("__i") + 1, F.lit(k)).alias("kmer"))
    if strict:
        out = out.where(F.col("kmer").rlike("^[ACGT]+$"))
    return out.withColumn("rep", canonical(F.col("kmer")))


def counts(occurrences: DataFrame) -> DataFrame:
    """(rep, n): occurrences of each canonical k-mer."""
    return occurrences.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))


def solid(occurrences: DataFrame, least: int = 2) -> DataFrame:
    return counts(occurrences).where(F.col("n") >= least)


def spectrum(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("n_kmers"))


def cardinality(counted: DataFrame) -> DataFrame:
    """All occurrences, distinct k-mers, and those found once."""
    return counted.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("f0"), F.sum((F.col("n") == 1).cast("long")).alias("f1"))


def hits(occurrences: DataFrame, index: DataFrame) -> DataFrame:
    """Occurrences whose k-mer the index (rep, ...) has."""
    return occurrences.join(index, "rep")


def islands(found: DataFrame, read: str, pos: str = "pos") -> DataFrame:
    """(read, start, stop, n): maximal runs of consecutive places."""
    order = Window.partitionBy(read).orderBy(pos)
    run = found.withColumn("__run", F.col(pos) - F.row_number().over(order))
    return run.groupBy(read, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count(F.lit(1)).alias("n")).drop("__run")


def gaps(runs: DataFrame, reads: DataFrame, read: str, k: int, length: Column) -> DataFrame:
    """(read, kind, start, stop): bases between solid runs: head, middle and tail. reads: (read, seq)."""
    order = Window.partitionBy(read).orderBy("start")
    with_next = runs.withColumn("following", F.lead("start").over(order)).withColumn("before", F.lag("stop").over(order)).join(reads, read)
    head = with_next.where(F.col("before").isNull() & (F.col("start") > 0)).select(read, F.lit("head").alias("kind"), F.lit(0).alias("start"), F.col("start").alias("stop"))
    rest = with_next.select(read, F.when(F.col("following").isNull(), "tail").otherwise("middle").alias("kind"), (F.col("stop") + k).alias("start"), F.coalesce("following", length).alias("stop"))
    return head.union(rest.where("stop > start"))


def neighbourhood(occurrences: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """(keep, pos, kmer, near, kind): k-mers one substitution, insertion or deletion away, for an equi-join."""
    place = F.sequence(F.lit(1), F.lit(k))
    each = occurrences.select(*keep, "pos", "kmer", F.explode(place).alias("__i"))
    left, right = F.substring("kmer", F.lit(1), F.col("__i") - 1), F.substring("kmer", F.col("__i") + 1, F.lit(k))
    base = F.explode(F.array(*map(F.lit, "ACGT")))
    swapped = each.select(*keep, "pos", "kmer", left.alias("l"), right.alias("r"), F.substring("kmer", F.col("__i"), F.lit(1)).alias("own"), base.alias("b"))
    substituted = swapped.where("b != own").select(*keep, "pos", "kmer", F.concat("l", "b", "r").alias("near"), F.lit("substitution").alias("kind"))
    longer = each.where(f"__i < {k}").select(*keep, "pos", "kmer", F.substring("kmer", F.lit(1), F.col("__i")).alias("l"), F.substring("kmer", F.col("__i") + 1, F.lit(k)).alias("r"), base.alias("b"))
    inserted = longer.select(*keep, "pos", "kmer", F.substring(F.concat("l", "b", "r"), F.lit(1), F.lit(k)).alias("near"), F.lit("insertion").alias("kind"))
    deleted = each.select(*keep, "pos", "kmer", F.concat(left, right).alias("d"), base.alias("b")).select(*keep, "pos", "kmer", F.concat("d", "b").alias("near"), F.lit("deletion").alias("kind"))
    return substituted.union(inserted).union(deleted).where("near != kmer").distinct().withColumn("rep", canonical(F.col("near")))
