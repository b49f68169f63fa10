"""Ranks, chunks and ordered sinks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def global_rank(df: DataFrame, by: str, ties: list[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds ``rank`` from 1: by a numeric column, then ``ties``. Rows are dealt to ranges of the column.

    Rows of one value lie in one range; nulls come last. Only the ranges' sizes reach every task.
    """
    cuts = df.agg(F.percentile_approx(F.col(by).cast("double"), [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first().q
    value = F.col(by).cast("double")
    passed = sum(((value < c if descending else value > c).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    ranged = df.withColumn("__range", F.when(value.isNull(), F.lit(ranges)).otherwise(passed))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))  # at most ranges + 1 rows
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("rank", F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def chunked(df: DataFrame, by: str, ties: list[str], chunks: int) -> DataFrame:
    """Adds ``chunk`` from 0: runs of rows / chunks rows each, in order; what is over makes one more."""
    size = max(1, df.count() // chunks)
    return global_rank(df, by, ties).withColumn("chunk", F.floor((F.col("rank") - 1) / size)).drop("rank")


def value_at(df: DataFrame, by: str, ties: list[str], share: float) -> DataFrame:
    """The value at place floor(n * share), from 0, of the descending order; an empty table gives no row."""
    n = df.count()
    return global_rank(df, by, ties, descending=True).where(F.col("rank") == int(n * share) + 1).select(F.col(by).alias("value"))


def ordered(df: DataFrame, *by: Column) -> DataFrame:
    return df.orderBy(*by)


def paired(raw: DataFrame, corrected: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(ord, name, raw, seq): raw and corrected reads of one place; names that differ after the first letter, or a place without its mate, are an error.

    Either table: (ord, name, seq).
    """
    both = raw.select(ord_col, F.col("name").alias("a"), F.col("seq").alias("raw")).join(corrected.select(ord_col, F.col("name").alias("b"), "seq"), ord_col, "full")
    fits = F.coalesce(F.substring("a", 2, 1 << 20) == F.substring("b", 2, 1 << 20), F.lit(False))
    name = F.when(fits, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("raw and corrected reads differ at place "), F.col(ord_col).cast("string"))))
    return both.select(ord_col, name.alias("name"), "raw", "seq")
