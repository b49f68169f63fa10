"""A coloured graph on disk: unitigs, and what is known of each, keyed by its first k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a vertex besides its sequence; each has unitig_id, or v (a reading) with unitig_id.
PARTS = ("pairs", "stats", "snps", "haplotypes", "cycles")


def write_store(tigs: DataFrame, links: DataFrame, k: int, path: str, **parts: DataFrame) -> None:
    """tigs: (unitig_id, seq, n_kmers); links: (u, v, ext) of readings; parts: tables of ``PARTS`` by unitig_id. An older store at the path is replaced."""
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"no parts of a vertex: {sorted(unknown)}")
    head = tigs.select("unitig_id", F.substring("seq", 1, k).alias("head"))
    tigs.join(head, "unitig_id").withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{path}/vertices")
    links.write.mode("overwrite").parquet(f"{path}/links")
    for name, part in parts.items():
        part.join(head, "unitig_id").drop("unitig_id").write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, parts: tuple[str, ...] = ("pairs", "stats")) -> tuple[int, DataFrame, DataFrame, dict[str, DataFrame]]:
    """(k, tigs, links, parts) as written. A store of two lengths, a head that two vertices have, or a part that names a head which the graph lacks, is an error."""
    vertices = spark.read.parquet(f"{path}/vertices")
    seen = vertices.agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("head").alias("heads")).first()
    if seen.n and (seen.a != seen.b or seen.n != seen.heads):
        raise ValueError(f"{path} is no store of one graph")
    out = {}
    head = vertices.select("head", "unitig_id")
    for name in parts:
        part = spark.read.parquet(f"{path}/{name}")
        if not part.join(head, "head", "left_anti").isEmpty():
            raise ValueError(f"{name} of {path} names vertices that the graph lacks")
        out[name] = part.join(head, "head").drop("head")
    return seen.a or 0, vertices.select("unitig_id", "seq", "n_kmers"), spark.read.parquet(f"{path}/links"), out


def index_of(tigs: DataFrame, k: int) -> DataFrame:
    """(kmer, unitig_id, dist, strand) of both strands, made of the unitigs; of a k-mer that one has twice the place on its own strand, then the first."""
    from graphloom.functions.dna import revcomp
    from graphloom.operators.kmers import kmers

    own = kmers(tigs, k, ["unitig_id"]).select("kmer", "unitig_id", F.col("pos").alias("dist"))
    both = own.withColumn("strand", F.lit(True)).union(own.select(revcomp(F.col("kmer")), "unitig_id", "dist", F.lit(False)))
    one = both.groupBy("kmer").agg(F.min(F.struct("unitig_id", (~F.col("strand")).alias("back"), "dist")).alias("x"))
    return one.select("kmer", "x.unitig_id", "x.dist", (~F.col("x.back")).alias("strand"))
