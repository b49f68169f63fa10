"""Operator 3: conflict-constrained best-fit packing of documents into token bins.

Bins carry bitmaps of the sources and duplicate clusters they hold. Open bins stand ordered by
residual; for each piece, longest first, the successor search starts at the least residual that
holds it and goes on until a bin shares neither source nor cluster with it, so the piece gets
the tightest compatible bin. Shards are dealt by a hash of the id and hold a bounded number of
documents in the mean, whatever sources or clusters they come from.
"""

from __future__ import annotations

from bisect import bisect_left, insort
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import near_copies
from graphloom.llm.pretoken import encoder
from graphloom.llm.token_counts import piece_counts
from graphloom.llm.workers import hold

CAPACITY = 2048
DOCS_PER_SHARD = 2048


def place(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given; a negative source or cluster conflicts with none."""
    order: list[int] = []  # residual << 32 | bin
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, offsets = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        source, cluster = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(order, n << 32)
        while at < len(order):
            b = order[at] & 0xFFFFFFFF
            if not (held_sources[b] & source or held_clusters[b] & cluster):
                break
            at += 1
        if at < len(order):
            residual = order.pop(at) >> 32
        else:
            b, residual = len(held_sources), capacity
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= source
        held_clusters[b] |= cluster
        bins.append(b)
        offsets.append(capacity - residual)
        if residual > n or n == 0:
            insort(order, (residual - n) << 32 | b)
    return bins, offsets


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """rows: id, n_tokens, source, cluster of one shard. A row per piece: full pieces of a long document stand alone."""
    rows = rows.sort_values(["n_tokens", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    full = (rows.n_tokens // capacity).astype(int)
    rest = rows.n_tokens - full * capacity
    whole = np.repeat(rows.index.to_numpy(), full)
    piece = np.concatenate([np.arange(k) for k in full]) if len(whole) else np.zeros(0, int)
    small = rows.index[(rest > 0) | (full == 0)].to_numpy()
    small = small[np.argsort(-rest[small].to_numpy(), kind="stable")]
    code = lambda col: pd.factorize(rows[col])[0]  # noqa: E731  -1 for null
    source, cluster = code("source"), code("cluster")
    bins, offsets = place(rest[small].tolist(), source[small].tolist(), cluster[small].tolist(), capacity)
    out = pd.DataFrame({"row": np.concatenate([whole, small]), "piece": np.concatenate([piece, full[small].to_numpy()])})
    out["n_tokens"] = np.concatenate([np.full(len(whole), capacity), rest[small].to_numpy()])
    out["bin"] = np.concatenate([len(set(bins)) + np.arange(len(whole)), np.array(bins, int)])
    out["offset"] = np.concatenate([np.zeros(len(whole), int), np.array(offsets, int)])
    out["id"], out["shard"] = rows.id.to_numpy()[out.row], rows["shard"].iloc[0]
    return out[["id", "piece", "n_tokens", "shard", "bin", "offset"]]


def best_fit_pack(lengths: DataFrame, shards: int, capacity: int = CAPACITY, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster") -> DataFrame:
    """(id, piece, n_tokens, shard, bin, offset): every piece of every document, in bins of at most ``capacity`` tokens.

    A bin has at most one piece of a source and of a cluster, but for documents of over
    ``capacity`` tokens, whose full pieces each fill a bin. Null sources, clusters and ids
    conflict with nothing; a null length counts as 0, and empty documents get a place too.
    Repeated rows are placed each. Ties go by id, then source and cluster.
    """
    kind = lengths.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.col(source_col).alias("source"), F.col(cluster_col).alias("cluster")]
    apart = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())  # rows of null ids go to all shards
    dealt = lengths.select(*cols, F.pmod(F.xxhash64(F.col(id_col), F.col(source_col), F.col(cluster_col), apart), F.lit(max(1, shards))).cast("long").alias("shard"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        hold()
        return pack_shard(rows, capacity)

    packed = dealt.groupBy("shard").applyInPandas(pack, f"id {kind}, piece int, n_tokens long, shard long, bin long, offset long")
    return packed.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """best_fit_pack of documents by their token counts; a cluster is a near-duplicate group of ``near_copies``, whatever the case.

    Null texts are in no cluster.
    """
    n = docs.count()
    rows = docs.select("doc_id", "source", "text", F.lower("text").alias("lower"))
    rows = rows.withColumn("none", F.col("lower").isNull())
    lengths = near_copies.Measure("n_tokens", "text", lambda texts: piece_counts(path).of(texts), (encoder, piece_counts))
    near = near_copies.groups(rows, ["doc_id", "source", "none"], "lower", measure=lengths)
    clusters = near.select("doc_id", "source", "n_tokens", F.when(~F.col("none"), F.col("component")).alias("cluster"))
    return best_fit_pack(clusters, -(-n // docs_per_shard), capacity)
