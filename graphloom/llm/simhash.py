"""Operator 2: near-duplicates by SimHash, found through a byte-position inverted index.

Two fingerprints that differ in at most two bits share at least six of their eight bytes by
position. A posting of the index holds the fingerprints with the same bytes at four positions.
The fourteen sets of four positions used are those whose numbers add up to 0 without carry: any
three positions lie in one of them, so a pair that shares six bytes meets in exactly three
postings, one that shares seven in seven, and one that shares five or fewer in one at most.
Postings shared are tallied per pair, pairs that reach the least number guaranteed (three) are
kept, and their bits are compared. Only distinct fingerprints are indexed, so copies cost nothing.

A posting of over ``POSTING`` fingerprints is split: linked members also share two of its other
four bytes, and then two of the last four half bytes, where at most 256 can stand together. The
split parts count for the posting that they come from, so no pair loses any of its tally.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.pretoken import slices
from graphloom.llm.shared import stored
from graphloom.llm.workers import task

POSTING = 64
MAX_BITS = 2
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
LEAST_SHARED = min(sum(not {*c} & {*gone} for c in BLOCKS) for gone in combinations(range(8), MAX_BITS))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts, and len(texts) + 1 offsets; null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), at[offsets - offsets[0]]


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text's word shingles, repeats included."""
    words, offsets = split_words(pc.ascii_lower(texts))
    n = np.diff(offsets)
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    out = np.zeros(len(n), np.uint64)
    if not len(words):
        return out
    shingles: list[str] = []
    if len(words) >= shingle:
        joined = pc.binary_join_element_wise(*(words.slice(i, len(words) - shingle + 1) for i in range(shingle)), pa.scalar(" ", pa.large_string()))
        inside = np.zeros(len(joined) + 1, np.int64)
        long = n >= shingle
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, (offsets[:-1] + counts)[long], -1)
        shingles = joined.filter(pa.array(np.cumsum(inside)[:-1] > 0)).to_numpy(zero_copy_only=False).tolist()
    digests = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    long = np.flatnonzero(n >= shingle)
    if len(long):
        bits = np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(counts[long]) - counts[long]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        on = np.packbits(2 * sums > counts[long][:, None], axis=1, bitorder="little")
        out[long] = np.ascontiguousarray(on).view(np.uint64).reshape(-1)
    for i in np.flatnonzero((n > 0) & (n < shingle)).tolist():
        out[i] = xxhash.xxh64_intdigest(" ".join(words.slice(offsets[i], n[i]).to_pylist()), 42)
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): the fingerprint of each row as a signed long; null and empty texts: 0."""

    @task()
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_500_000):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fingerprints_of(b.column("text")).view(np.int64))], ["id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(mark, f"id {kind}, bits long")


def _mask(places: tuple[int, ...], width: int = 8) -> int:
    """These bytes (or units of ``width`` bits) of a signed long."""
    m = sum(((1 << width) - 1) << (width * i) for i in places)
    return m - (1 << 64) if m >> 63 else m


def _finer(level: int) -> list[tuple[int, int]]:
    """(mask, finer mask): a split posting's keys, by two more bytes and then by two more half bytes."""
    out = set()
    for places in BLOCKS if level == 1 else combinations(range(8), 6):
        rest = [i for i in range(8) if i not in places]
        units = [_mask((i,)) for i in rest] if level == 1 else [_mask((2 * i + k,), 4) for i in rest for k in (0, 1)]
        out |= {(_mask(places), _mask(places) | a | b) for a, b in combinations(units, 2)}
    return sorted(out)


def postings(bits: DataFrame) -> DataFrame:
    """(mask, key, block, bits): members of the postings with two fingerprints or more, large ones split."""
    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.lit(_mask(c)).alias("mask")) for k, c in enumerate(BLOCKS))))
    index = bits.select("bits", blocks.alias("b")).select("bits", "b.block", "b.mask")
    held = []
    for level in (1, 2, 3):
        index = index.withColumn("key", F.col("bits").bitwiseAND(F.col("mask")))
        size = index.groupBy("block", "mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        index = stored(index.join(size, ["block", "mask", "key"]), "postings")
        held.append(index if level == 3 else index.where(F.col("n") <= POSTING))
        if level < 3:
            finer = bits.sparkSession.createDataFrame(_finer(level), "mask long, finer long")
            index = index.where(F.col("n") > POSTING).join(F.broadcast(finer), "mask").select("bits", "block", F.col("finer").alias("mask"))
    return reduce(DataFrame.union, [h.select("mask", "key", "block", "bits") for h in held])


def links(bits: DataFrame) -> DataFrame:
    """bits: distinct fingerprints. (a, b), a < b: all pairs of MAX_BITS or fewer differing bits."""
    index = postings(bits)
    pairs = index.withColumnRenamed("bits", "a").join(index.withColumnRenamed("bits", "b"), ["mask", "key", "block"]).where("a < b")
    tally = pairs.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, block)")).alias("shared")).where(F.bit_count("shared") >= LEAST_SHARED)
    return tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits, component_id): one row per input row; component_id is the least id reachable over links.

    Null and empty texts have fingerprint 0 and link as any other. Null ids are linked too, but
    never name a component unless it has no other id. Repeated rows are kept.
    """
    marked = stored(simhash(docs, id_col, text_col), "simhash")
    named = stored(marked.groupBy("bits").agg(F.min("id").alias("least")), "fingerprints")
    groups = components(links(named.select("bits")))
    roots = named.join(groups, named["bits"] == groups["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(ids, "root").select("bits", "component_id")
    return marked.join(of, "bits").select(F.col("id").alias(id_col), "bits", "component_id")
