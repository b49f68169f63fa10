"""Haplotype blocks of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dictionary(rows: DataFrame, block: str = "block", kind: str = "type") -> DataFrame:
    """(block, type, block_id, type_id, hap_id): numbers by order of value; hap_id = 2 block_id + type_id.

    Blocks and types are distinct values, few beside the rows. More than two types are an error.
    """
    kinds = rows.select(kind).distinct()
    if kinds.limit(3).count() > 2:
        raise ValueError("haplotypes of two types at most")
    blocks = rows.select(block).distinct()
    numbered = lambda df, c: df.select(c, (F.dense_rank().over(Window.orderBy(c)) - 1).cast("long").alias(f"{c}_id"))
    both = rows.select(block, kind).distinct().join(numbered(blocks, block), block).join(F.broadcast(numbered(kinds, kind)), kind)
    return both.select(F.col(block).alias("block"), F.col(kind).alias("type"), F.col(f"{block}_id").alias("block_id"), F.col(f"{kind}_id").alias("type_id"), (2 * F.col(f"{block}_id") + F.col(f"{kind}_id")).alias("hap_id"))


def assignments(rows: DataFrame, name: str, hap: str, long_reads: bool) -> DataFrame:
    """(name, hap_id, phased): a long read named twice is unphased; a short one only if its haplotypes differ."""
    out = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(hap).alias("n_haps"), F.min(hap).alias("hap_id"))
    phased = F.col("n") == 1 if long_reads else F.col("n_haps") == 1
    return out.select(name, F.when(phased, F.col("hap_id")).alias("hap_id"), phased.alias("phased"))


def vertex_haplotypes(hits: DataFrame, haps: DataFrame, vertex: str, name: str, least: int = 2) -> DataFrame:
    """(vertex, hap_id, cov): haplotypes of the reads that visit a vertex, where phased visits reach ``least``."""
    visits = hits.join(haps.where("phased"), name).groupBy(vertex, "hap_id").agg(F.count(F.lit(1)).alias("cov"))
    total = visits.groupBy(vertex).agg(F.sum("cov").alias("total")).where(F.col("total") >= least)
    return visits.join(total.select(vertex), vertex)


def incompatible(hits: DataFrame, read: str, insert: int, share: float = 0.85, most: int = 1000) -> DataFrame:
    """(read, pos): places to void, whose colours fit those of no place more than ``insert`` from them along the read.

    hits: (read, pos, colors), colors distinct, of vertices that don't branch; sets of over ``most`` colours are left out. Two sets fit if they share
    ``share`` of both. Places are judged in order and voided ones count no more: a place without a fitting one goes if there is any place far after it,
    or one far before it that stays. Hits are dealt once, by read, and what follows stays in the read's row: its distinct sets with their places.
    """
    own = hits.where(F.size("colors") <= most).select(read, "pos", F.sort_array("colors").alias("colors")).where(F.col(read).isNotNull()).repartition(read)
    sets = own.groupBy(read, "colors").agg(F.collect_list("pos").alias("at"))
    one = F.struct(F.col("colors").alias("c"), F.array_min("at").alias("first"), F.array_max("at").alias("last"), "at")
    rows = sets.groupBy(read).agg(F.collect_list(one).alias("sets"))

    def fit(s, t):
        n, m = F.size(s.c), F.size(t.c)
        both = F.size(F.array_intersect(s.c, t.c))
        # sizes first: they tell most pairs without looking at the colours
        return (m >= share * n) & (n >= share * m) & (both > 0) & (both >= share * n) & (both >= share * m)

    kind = sets.schema["at"].dataType.elementType
    none = F.struct(F.lit(None).cast(kind).alias("first"), F.lit(None).cast(kind).alias("last"))
    reach = lambda s: F.aggregate("sets", none, lambda x, t: F.when(fit(s, t), F.struct(F.least(x.first, t.first).alias("first"), F.greatest(x.last, t.last).alias("last"))).otherwise(x))
    reached = rows.select(read, F.transform("sets", lambda s: F.struct(s["at"].alias("at"), reach(s).alias("r"))).alias("sets"))
    far = lambda p, r: F.coalesce((p - r.first > insert) | (r.last - p > insert), F.lit(False))
    places = reached.select(read, F.flatten(F.transform("sets", lambda s: F.transform(s["at"], lambda p: F.struct(p.alias("pos"), far(p, s.r).alias("fits"))))).alias("places"))
    of = lambda x: F.transform(x, lambda p: p.pos)
    ends = places.select(read, "places", F.array_max(of("places")).alias("last"), F.array_min(of(F.filter("places", lambda p: p.fits))).alias("stays"))
    each = ends.select(read, "last", "stays", F.explode("places").alias("p")).select(read, "p.*", "last", "stays")
    gone = (F.col("last") - F.col("pos") > insert) | F.coalesce(F.col("pos") - F.col("stays") > insert, F.lit(False))
    return each.where(~F.col("fits") & gone).select(read, "pos").distinct()
