"""Operator 8: token ids in files, compressed by Re-Pair per shard.

A shard holds whole documents in ascending order of id. Frequent adjacent symbol pairs are
replaced by nonterminals, again and again; the file stores the rules, each nonterminal's expansion
length and, per document, its counts of symbols and ids, so that a document or a part of one is
expanded without the rest of its shard. No symbol reaches past the end of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.pretoken import binary_rows, encoder, ragged, slices
from graphloom.llm.workers import task

SHARD_IDS = 1_000_000
MIN_COUNT = 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(code: np.ndarray) -> np.ndarray:
    return ((code.view(np.uint64) * _SPREAD) >> np.uint64(44)).view(np.int64)


def _frequent(code: np.ndarray, slot: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that may have a pair found ``min_count`` times; the pairs that are, and their counts."""
    may = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= min_count)[slot])
    ordered = np.sort(code[may])  # a slot may hold several pairs, so they are counted themselves
    at = np.flatnonzero(np.diff(ordered, prepend=-1))
    counts = np.diff(at, append=len(ordered))
    often = counts >= min_count
    return may, ordered[at[often]], counts[often]


def _found(code: np.ndarray, slot: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose pair is in the table, and which it is; the table's pairs have different slots."""
    own = _slots(table)
    some = np.zeros(1 << 20, bool)
    some[own] = True
    hit = np.flatnonzero(some[slot])
    number = np.zeros(1 << 20, np.int32)
    number[own] = np.arange(len(table))
    which = number[slot[hit]]
    same = table[which] == code[hit]
    return hit[same], which[same]


def _first(symbols: np.ndarray, size: int) -> np.ndarray:
    """Of each symbol below ``size``, its first place among these; their number if none."""
    out = np.full(size, len(symbols), np.int32)
    out[symbols[::-1]] = np.arange(len(symbols) - 1, -1, -1, dtype=np.int32)
    return out


def _without_overlap(pairs: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent pairs none of which can overlap with another, at most ``limit``, ascending.

    A pair is taken if no pair taken before it ends in its left or starts with its right symbol. All pairs that no
    undecided one before them can hinder are taken at once, and those that they hinder go, until all are decided.
    """
    pairs = pairs[np.lexsort((pairs, -counts))]
    pairs = pairs[np.sort(np.unique(_slots(pairs), return_index=True)[1])]  # one of each slot; another's turn is next round
    left, right = pairs >> 32, pairs & 0xFFFFFFFF
    size = 1 + int(max(left.max(), right.max())) if len(pairs) else 0
    starts, ends = np.zeros(size, bool), np.zeros(size, bool)  # symbols that start or end a pair taken
    taken = np.zeros(len(pairs), bool)
    for some in np.array_split(np.arange(len(pairs)), max(1, len(pairs) // (2 * limit))):
        while len(some):
            a, b = left[some], right[some]
            some = some[~(ends[a] | starts[b] | ((a == b) & (starts[a] | ends[b])))]
            a, b = left[some], right[some]
            place = np.arange(len(some))
            sure = (_first(b, size)[a] >= place) & (_first(a, size)[b] >= place)
            taken[some[sure]] = True
            starts[a[sure]] = True
            ends[b[sure]] = True
            some = some[~sure]
        if taken.sum() >= limit:
            break
    return np.sort(pairs[np.flatnonzero(taken)[:limit]])


def compress(seq: np.ndarray, end_id: int, first: int, min_count: int = MIN_COUNT, per_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): nonterminal ``first + i`` stands for the pair rules[i] and lengths[i] ids.

    Each round replaces the most frequent pairs, at most ``per_round`` of them and none that could
    overlap with another; it ends when no pair is found ``min_count`` times. Only places whose pair
    may be frequent are counted again: those of frequent pairs that were not replaced, and those
    beside a new nonterminal. A pair never starts with a symbol that ends in ``end_id``.
    """
    seq = seq.astype(np.int32)
    rules = [np.zeros((0, 2), np.int64)]
    n_rules = 0
    length, closed = np.ones(first, np.int64), np.zeros(first, bool)
    closed[end_id] = True
    live = np.flatnonzero(~closed[seq[:-1]])
    while len(live):
        code = (seq[live].astype(np.int64) << 32) | seq[live + 1]
        slot = _slots(code)
        may, pairs, counts = _frequent(code, slot, min_count)
        table = _without_overlap(pairs, counts, per_round)
        if not len(table):
            break
        live = live[may]
        hit, which = _found(code[may], slot[may], table)
        at = live[hit]
        # in a run of one symbol, every other pair
        new_run = np.diff(at, prepend=-2) != 1
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
        at, which = at[even], which[even]
        pair = np.stack([table >> 32, table & 0xFFFFFFFF], axis=1)
        rules.append(pair)
        closed = np.concatenate([closed, closed[pair[:, 1]]])
        length = np.concatenate([length, length[pair[:, 0]] + length[pair[:, 1]]])
        seq[at] = first + n_rules + which
        n_rules += len(table)
        again = np.zeros(len(seq), bool)
        again[live] = True
        again[at] = True
        again[at[at > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, again = seq[keep], again[keep]
        live = np.flatnonzero(again[:-1])
        live = live[~closed[seq[live]]]
    return seq.astype(np.uint32), np.concatenate(rules).astype(np.uint32), length[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids ``start`` to ``stop`` of the symbols' expansion. By the lengths, each symbol is placed at once; what lies outside is not expanded."""
    own = lambda s: np.where(s < first, 1, lengths[np.maximum(s.astype(np.int64) - first, 0)]) if len(lengths) else np.ones(len(s), np.int64)
    work = symbols.astype(np.int64)
    size = own(work).astype(np.int64)
    ends = np.cumsum(size)
    stop = (int(ends[-1]) if len(ends) else 0) if stop is None else stop
    place, out = ends - size, np.empty(max(0, stop - start), np.uint32)
    while len(work):
        inside = (place < stop) & (place + size > start)
        work, place = work[inside], place[inside]
        whole = work < first
        out[place[whole] - start] = work[whole]
        pair, place = rules[work[~whole] - first].astype(np.int64), place[~whole]
        left = own(pair[:, 0])
        work = np.concatenate([pair[:, 0], pair[:, 1]])
        place = np.concatenate([place, place + left])
        size = own(work)
    return out


def document(shard: dict, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids of the i-th document of a shard row, or a part of them, from the symbols and rules that reach into it."""
    n = np.asarray(shard["n_symbols"])
    symbols = np.frombuffer(shard["symbols"], "<u4")[n[:i].sum() : n[: i + 1].sum()]
    return expand(symbols, np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), np.frombuffer(shard["lengths"], "<u4"), shard["n_terminals"], start, stop)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes shards of about ``shard_ids`` ids, documents in ascending order of id.

    Null ids come first; a null or empty text is its end id alone; repeated ids stand side by side.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @task(encoder)
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        first, part, seq, before = len(e.table.pieces), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size, before
            ids = np.concatenate([x[1] for x in held])
            counts = np.concatenate([x[2] for x in held])
            symbols, rules, lengths = compress(ids, end_id, first)
            sizes = np.ones(len(symbols), np.int64)
            sizes[symbols >= first] = lengths[symbols[symbols >= first].astype(np.int64) - first]
            ends = np.searchsorted(np.cumsum(sizes), np.cumsum(counts)) + 1
            row = {
                "part": part, "seq": seq, "n_before": before, "n_ids": len(ids), "n_terminals": first, "doc_ids": pa.concat_arrays([x[0] for x in held]).to_pylist(), "n_tokens": counts.astype(np.int64),
                "n_symbols": np.diff(ends, prepend=0), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
            }
            held.clear()
            seq, size, before = seq + 1, 0, before + len(ids)
            return pa.RecordBatch.from_pylist([row])

        for b in slices(batches, "text"):
            ids, offsets = e.encode(b.column("text"))
            offsets = offsets + np.arange(len(offsets))
            out = np.full(offsets[-1], end_id, np.uint32)
            out[ragged(offsets[:-1], np.diff(offsets) - 1)] = ids
            cut = 0
            for i in [*(1 + np.flatnonzero(np.diff((size + offsets[1:]) // shard_ids))).tolist(), b.num_rows]:
                held.append((b.column("id").slice(cut, i - cut), out[offsets[cut] : offsets[i]], np.diff(offsets[cut : i + 1])))
                size += int(offsets[i] - offsets[cut])
                cut = i
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    fields = f"part long, seq long, n_before long, n_ids long, n_terminals long, doc_ids array<{kind}>, n_tokens array<long>, n_symbols array<long>, rules binary, lengths binary, symbols binary"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(shards, fields).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids): start counts the ids of all documents before it."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    @task()
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = {n: b.column(n)[i] for n in b.schema.names}
                n = s["n_tokens"].values.to_numpy()
                rules = np.frombuffer(s["rules"].as_py(), "<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(s["symbols"].as_py(), "<u4"), rules, np.frombuffer(s["lengths"].as_py(), "<u4"), s["n_terminals"].as_py())
                at = np.concatenate([[0], np.cumsum(n)])
                doc_ids = s["doc_ids"].values
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at[:-1] + s["start"].as_py()), pa.array(n), binary_rows(ids, at).cast(pa.binary())], [id_col, "start", "n_tokens", "ids"])

    whole = files.join(F.broadcast(before), "part").select("doc_ids", "n_tokens", "n_terminals", "rules", "lengths", "symbols", (F.col("part_start") + F.col("n_before")).alias("start"))
    return whole.mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
