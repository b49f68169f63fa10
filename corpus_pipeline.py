"""documents to a clean, deduplicated, packed corpus, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import near_copies, packing, quality, rules, substring_dedup
from graphloom.llm.queries import TOKENIZER, labels
from graphloom.llm.shared import discard, spread, stored

MIN_QUALITY = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """Two hashes of a whole row: doc_id may be null or repeated, and rows of one key are equal in all columns."""
    columns = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is MIN_QUALITY or more."""
    weights = quality.fit(docs, labels(spark, sf_dir))
    scores = quality.quality_scores(spread(docs), weights, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scores.where(F.col("score") >= MIN_QUALITY).select(COLUMNS)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules and whose host does."""
    return rules.quality_rules(spread(docs), keep=("text", "lang", "n_chars")).where("kept").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each near-duplicate group (null ids last, then by key); one of rows equal in all columns.

    Links are operator 2's, each held against the texts, and those of bands for what differs in more bits.
    """
    groups = near_copies.groups(spread(docs).withColumn("key", _key()), ["doc_id", "key"], fingerprints=True)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    first = first.select("first.key.h", "first.key.g")
    rows = docs.withColumn("key", _key()).select(*COLUMNS, "key.h", "key.g")
    return rows.join(first, ["h", "g"], "left_semi").dropDuplicates(["h", "g"]).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents. Characters cut in half go; emptied documents stay."""
    rows = substring_dedup.remove_repeats(docs, keep=("lang", "source"), as_text=True).withColumnRenamed("kept", "text")
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, bin, offset) of all that is left."""
    return packing.pack_documents(spread(docs), TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("rules", keep_by_rules),
    ("near_duplicates", one_of_each_group),
    ("substrings", without_repeats),
    ("packing", packed),
]

ORACLE_SQL = None  # trained scores and packing have no SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*filter(None, [before]))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
