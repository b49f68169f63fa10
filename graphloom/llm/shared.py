"""How the operators read and write tables between their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.storage import discard, fresh_path, stored

__all__ = ["discard", "fresh_path", "spread", "stored"]


def spread(df: DataFrame) -> DataFrame:
    """Input in fewer splits than there are cores is dealt out anew; a large input stays as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() * 2 < n else df
