"""Near copies for the pipeline: texts whose sets of five-word shingles are alike by 0.8 (Jaccard) or more.

For the pipeline, texts that operator 2 links by their SimHashes are candidates. At 0.8 two of these
64-bit fingerprints differ in ten bits in the mean, which leaves no four bytes alone, so its index can't
find all such pairs; the rest come from bands. Here a posting is a band: ``ROWS`` of a set's least hashes. Two sets share one of ``BANDS`` bands with probability 1 - (1 - J^5)^32, 0.999997 at 0.8.

Every candidate is verified on its shingles. In a posting all members are first held against the one
that the most sets meet; only members that this leaves in different groups are then paired, each pair in the
least posting that it shares, so a group of near copies costs its size, and all candidate pairs that could join
two groups are looked at. Of these, pairs whose sketches differ in too many bits are not verified. A sketch has a bit for each of
``SKETCH_BITS`` cells, set if an odd number of shingles lie there, so sets differ in as many shingles as sketches in bits, or more: at 0.8
sets of n and m shingles differ in (n + m) / 9 at most, and a pair beyond that is surely no link. Of large sets, which fill the cells, fewer bits
differ; there the limit is five deviations over the mean at 0.8, so of such pairs one in a million is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.pretoken import SLICE_BYTES, listed, slices
from graphloom.llm.shared import stored
from graphloom.llm.simhash import fingerprints_of, links, split_words
from graphloom.llm.workers import task

SHINGLE = 5
BANDS, ROWS = 32, 5
SKETCH_BITS = 1024
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
SIEVE_LOG2 = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(11)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes; a shorter text is one shingle, null and empty ones none."""
    words, offsets = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, listed(coded.dictionary)), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    left = np.repeat(offsets[1:], n) - np.arange(len(h))
    mixed = h.copy()
    for i in range(1, min(SHINGLE, len(h))):
        mixed[:-i] = np.where(left[:-i] > i, mixed[:-i] * _BASE + h[i:], mixed[:-i])
    mixed = _mix(mixed)
    for a, c in zip(offsets[:-1].tolist(), counts.tolist(), strict=True):
        s = np.sort(mixed[a : a + c])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if c else s


def node_of(shingles: np.ndarray) -> int:
    """Name of a set, a signed long."""
    x = xxhash.xxh64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def least_hashes(rows: list[np.ndarray], draws: int) -> np.ndarray:
    """The least of each of the first ``draws`` hashes over each set, a row per set; of the empty set the greatest number."""
    out = np.full((len(rows), draws), 0xFFFFFFFF, np.uint32)
    times, plus, room = _TIMES[:draws], _PLUS[:draws], np.empty((256, draws), np.uint32)
    for least, shingles in zip(out, rows, strict=True):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(x), 256):
            part = room[: len(x) - a]
            np.multiply(x[a : a + 256, None], times, out=part)
            part += plus
            np.minimum(least, part.min(axis=0), out=least)
    return out


def bands_of(rows: list[np.ndarray]) -> np.ndarray:
    """Keys of the postings of each set, a row per set."""
    least = least_hashes(rows, BANDS * ROWS).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
    for i in range(ROWS):
        key = _mix(key ^ least[:, :, i]) + _BASE
    return key.view(np.int64)


def sketches(rows: list[np.ndarray]) -> np.ndarray:
    """Whether an odd number of shingles lies in each cell, 64 cells in a long; a row per set."""
    out = np.zeros((len(rows), len(SKETCH)), np.int64)
    for own, shingles in zip(out, rows, strict=True):
        odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).view(np.int64), minlength=SKETCH_BITS) & 1
        own[:] = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
    return out


def _near_enough(a: str, b: str) -> Column:
    """Whether the sketches of two sets differ in no more bits than those of sets alike by 0.8."""
    apart = sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in SKETCH), F.lit(0))
    most = (F.col(f"{a}_n") + F.col(f"{b}_n")) / 9
    mean = SKETCH_BITS / 2 * (1 - F.exp(-2 * most / SKETCH_BITS))
    deviation = F.sqrt(SKETCH_BITS / 4 * (1 - F.exp(-4 * most / SKETCH_BITS)))
    return (9 * apart <= F.col(f"{a}_n") + F.col(f"{b}_n")) & (apart <= mean + 5 * deviation + 1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def text_keys(texts: pa.Array) -> np.ndarray:
    """A hash of the bytes of each text; null: of none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    return np.fromiter((xxhash.xxh64_intdigest(t.as_buffer()) for t in texts), np.uint64, len(texts))


@dataclass(frozen=True)
class Measure:
    """A column ``name`` (long) of what ``of`` gives for ``column``, with the worker's tables that it needs."""

    name: str
    column: str
    of: Callable[[pa.Array], np.ndarray]
    tables: tuple = ()
    size: int = SLICE_BYTES


def marked(docs: DataFrame, keep: list[str], text_col: str = "text", measure: Measure | None = None) -> DataFrame:
    """(keep, node, n, bands, text_key): name, size and postings of the shingle set of each row (none: no postings), and a hash of its text.

    measure: a further column made of another column in the same worker, so that a task keeps one.
    """
    more = [measure.name] if measure else []

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for whole in slices(batches, "__text", measure.size if measure else 1_500_000):
            own, at = [pa.array(measure.of(whole.column("__measured")))] if measure else [], 0
            for b in slices([whole], "__text", 1_500_000):
                yield b, [x.slice(at, b.num_rows) for x in own]
                at += b.num_rows

    @task(*(measure.tables if measure else ()))
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in parts(batches):
            rows, node, n, bands = [], [], [], []
            for s in shingle_sets(b.column("__text")):
                node.append(node_of(s))
                n.append(len(s))
                rows.append(s)
                if len(rows) == 256:
                    bands.append(bands_of(rows))
                    rows.clear()
            bands = np.concatenate([*bands, bands_of(rows)])
            held = np.array(n, np.int32) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(BANDS * held)]), pa.int32()), pa.array(bands[held].ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *own, pa.array(node, pa.int64()), pa.array(n, pa.int32()), bands, pa.array(text_keys(b.column("__text")).view(np.int64))], [*keep, *more, "node", "n", "bands", "text_key"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` long" for c in more)])
    measured = [F.col(measure.column).alias("__measured")] if measure else []
    return docs.select(*keep, F.col(text_col).alias("__text"), *measured).mapInArrow(mark, f"{fields}, node long, n int, bands array<long>, text_key long")


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles, sketch) of the nodes given, each with the hash of a text of its. A sieve of fixed size on these hashes leaves
    most other texts alone; the join decides."""
    slot = F.col("text_key").bitwiseAND(F.lit((1 << SIEVE_LOG2) - 1))
    some = nodes.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(text_key & 63))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << (SIEVE_LOG2 - 6), np.int64)
    sieve[some.column("at").to_numpy()] = some.column("bits").to_numpy()
    blob = sieve.tobytes()

    @task()
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(blob, np.uint64)
        for b in slices(batches, "text", 1_500_000):
            x = text_keys(b.column("text")) & np.uint64((1 << SIEVE_LOG2) - 1)
            some = np.flatnonzero(held[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1))
            rows = list(shingle_sets(b.column("text").take(pa.array(some))))
            node = list(map(node_of, rows))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), _lists(rows), *map(pa.array, np.ascontiguousarray(sketches(rows).T))], ["node", "shingles", *SKETCH])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(pick, f"node long, shingles array<long>, {', '.join(s + ' long' for s in SKETCH)}")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _long_enough(n: Column, m: Column) -> Column:
    """Sets of these sizes can be alike by 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets (node, shingles) have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(5 * F.col("shared") >= 4 * (F.col("total") - F.col("shared"))).select("a", "b")


def linked_by_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """(a, b): candidates of (node, bits): nodes of one SimHash with the least of them, and the least ones of two that operator 2 links."""
    least = stored(fingerprints.groupBy("bits").agg(F.min("node").alias("least")), "near-fingerprints")
    found = links(least.select("bits"))
    a, b = (least.withColumnsRenamed({"bits": i, "least": f"{i}_node"}) for i in "ab")
    apart = found.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = apart.union(fingerprints.join(least, "bits").select("least", "node")).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, keep: list[str], text_col: str = "text", fingerprints: bool = False, measure: Measure | None = None) -> DataFrame:
    """(keep, component): one row per input row; rows have one component if verified links lead from one to the other.

    Null and empty texts are one group. ``fingerprints``: operator 2's links are candidates too. ``measure``: a column more, after ``keep``.
    """
    keep_, texts = keep, docs
    if fingerprints:
        bits = Measure("__bits", text_col, lambda x: fingerprints_of(x).view(np.int64), size=1_500_000)
        marks = stored(marked(docs, keep, text_col, bits), "near-marks")
        near = stored(linked_by_fingerprint(marks.where("n > 0").select("node", F.col("__bits").alias("bits")).distinct()), "near-fingerprints")
    else:
        marks = stored(marked(docs, keep, text_col, measure), "near-marks")
        keep_ = [*keep, *([measure.name] if measure else [])]
    nodes = marks.where("n > 0").select("node", "n", "bands").dropDuplicates(["node"])
    index = nodes.select("node", "n", F.explode("bands").alias("key"))
    size = index.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    index = index.join(size, "key")
    # the set that most others meet stands nearest to the middle of its near copies
    met = index.groupBy("node").agg(F.sum("members").alias("met"))
    index = stored(index.join(met, "node"), "near-index")
    held = index.select("node")
    if fingerprints:
        held = held.union(near.select("a")).union(near.select("b"))
    names = marks.groupBy("node").agg(F.min("text_key").alias("text_key")).join(held, "node", "left_semi")
    sets = stored(_sets(texts, stored(names, "near-names"), text_col), "near-sets")
    middle = index.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("middle"))
    stars = index.join(middle, "key").where("node != middle.node").where(_long_enough(F.col("n"), F.col("middle.n")))
    stars = stars.select(F.least("node", "middle.node").alias("a"), F.greatest("node", "middle.node").alias("b"))
    if fingerprints:
        stars = stars.union(near)
    stars = stored(stars.distinct(), "near-stars")
    alike = stored(verified(stars, sets), "near-links")
    of = stored(components(alike), "near-groups")

    rooted = index.join(of, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    rest = stored(rooted.join(mixed, "key", "left_semi"), "near-rest")
    own = rest.groupBy("node").agg(F.collect_list("key").alias("keys")).join(sets.drop("shingles"), "node")  # BANDS keys at most
    rest = rest.join(own, "node")
    x, y = (rest.select("key", F.col("node").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in ("n", "root", "keys", *SKETCH))) for i in "ab")
    pairs = x.join(y, "key").where("a < b and a_root != b_root").where(_long_enough(F.col("a_n"), F.col("b_n"))).where(_near_enough("a", "b"))
    pairs = pairs.where("key = array_min(array_intersect(a_keys, b_keys))").select("a", "b")
    pairs = stored(pairs.join(stars, ["a", "b"], "left_anti"), "near-pairs")
    if not pairs.isEmpty():
        of = stored(components(alike.union(verified(pairs, sets))), "near-groups")
    return marks.join(of, "node", "left").select(*keep_, F.coalesce("component", "node").alias("component"))
