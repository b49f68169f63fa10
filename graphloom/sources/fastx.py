"""FASTA and FASTQ files, file lists and phasing tables as DataFrames, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "name string, seq string, qual string, file string, ord long"
READS = (".fa", ".fasta", ".fq", ".fastq")


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of reads as they are; any other file is a list of paths, one a line."""
    out: list[str] = []
    for p in paths:
        bare = p.removesuffix(".gz")
        out += [p] if bare.endswith(READS) else [r.value.strip() for r in spark.read.text(p).collect() if r.value.strip()]
    return out


def read_fastx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of plain or gzipped files, with the file and the place in it.

    Plain FASTA is cut at its record marks, so that large files are read in splits. FASTQ records
    of four lines are put together by line number within the file, as @ may start a quality line; lines are
    numbered by splits, so a plain file is read by several tasks.
    """
    files = expand(spark, paths)
    fasta = [f for f in files if f.removesuffix(".gz").endswith((".fa", ".fasta"))]
    fastq = [f for f in files if f not in fasta]
    parts = []
    if fasta:
        rows = spark.read.option("lineSep", "\n>").text(fasta).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("ord"))
        text = F.regexp_replace("value", r"\A>", "")
        lines = F.split(text, "\n", 2)
        rows = rows.where("length(trim(value)) > 0").select(F.split(lines[0], r"\s")[0].alias("name"), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"), F.lit(None).cast("string").alias("qual"), F.col("file_path").alias("file"), "ord")
        parts.append(rows)
    if fastq:
        lines = numbered_lines(spark, fastq)
        pick = lambda i: F.max(F.when(F.col("n") % 4 == i, F.col("value")))
        rec = lines.groupBy("file", F.floor(F.col("n") / 4).alias("ord")).agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"))
        parts.append(rec.select(F.split(F.substring("head", 2, 1 << 20), r"\s")[0].alias("name"), F.upper("seq").alias("seq"), "qual", "file", "ord"))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(value, file, n): the lines of each file from 0. Only the splits' line counts come together."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"]).select("value", "file", (F.col("before") + F.col("id") - F.col("first")).alias("n"))


def suffixed_names(reads: DataFrame) -> DataFrame:
    """Names that end in /1 or /2: mates are expected to share one name."""
    return reads.where(F.col("name").rlike("/[12]$")).select("name")


def read_phasing(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, block) of a tab-separated table; comments, broken rows and rows of ``none`` go."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="name string, type string, block string", mode="DROPMALFORMED")
    return rows.where("name is not null and type is not null and block is not null and type != 'none' and block != 'none'")


def write_fastq(reads: DataFrame, path: str, gz: bool = False) -> None:
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(record.alias("value")).write.text(path, compression="gzip" if gz else "none")


def write_fasta(reads: DataFrame, path: str, gz: bool = False) -> None:
    reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path, compression="gzip" if gz else "none")
