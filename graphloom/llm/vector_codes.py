"""Operator 13: vectors as codes of their parts, by weighted Lloyd rounds over distinct integer parts.

Equal parts of one position become one row with a weight. Each round assigns the distinct parts to the entries of their
position's codebook inside tasks, with exact arithmetic, and sums them there; only the sums of entries come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored
from graphloom.llm.workers import task

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = (1 << 63) - 1
_ROWS = 4096  # parts whose distances are held together


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts (n, p) to all entries (m, p): as floats where these are exact, else in 64 bits, else in Python's integers."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * parts.shape[1] * most * most
    kind = np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object
    a, b = parts.astype(kind), entries.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least entry at the least distance of each part, and that distance, ``LARGEST`` at most."""
    code, dist = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), _ROWS):
        d = distances(parts[at : at + _ROWS], entries)
        code[at : at + _ROWS] = best = d.argmin(1)
        dist[at : at + _ROWS] = np.minimum(d[np.arange(len(best)), best], LARGEST).astype(np.int64) if d.dtype == object else d[np.arange(len(best)), best]
    return code, dist


def _parts_of(b: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    values = b.column("part").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(at), -1)


def entry_sums(distinct: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(place, entry, i, n, total): how many parts each entry has, and the sum of their i-th numbers."""

    @task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros(c.shape, object) for c in codebooks], [np.zeros(len(c), object) for c in codebooks]
        for b in batches:
            place, weight = b.column("place").to_numpy(), b.column("weight").to_numpy()
            for p in np.unique(place):
                at = np.flatnonzero(place == p)
                parts, w = _parts_of(b, at), weight[at]
                code, _ = nearest(parts, codebooks[p])
                kind = np.int64 if max(1, int(np.abs(parts).max(initial=0))) * int(w.astype(object).sum()) < 1 << 62 else object
                used, back = np.unique(code, return_inverse=True)
                total, n = np.zeros((len(used), parts.shape[1]), kind), np.zeros(len(used), np.int64)
                np.add.at(total, back, parts.astype(kind) * w.astype(kind)[:, None])
                np.add.at(n, back, w)
                totals[p][used] += total.astype(object)
                counts[p][used] += n
        for p, (total, n) in enumerate(zip(totals, counts, strict=True)):
            used, width = np.flatnonzero(n), total.shape[1]
            columns = [np.full(len(used) * width, p, np.int32), np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(n[used].astype(np.int64), width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([str(x) for x in total[used].reshape(-1)], pa.string())], ["place", "entry", "i", "n", "total"])

    each = distinct.mapInArrow(run, "place int, entry long, i long, n long, total string")
    return each.groupBy("place", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def updated(distinct: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: entries become the floor of the mean of their parts; unused ones stay. Only entries' sums come to the driver."""
    out = [c.copy() for c in codebooks]
    for r in entry_sums(distinct, codebooks).collect():
        out[r.place][r.entry, r.i] = int(r.total) // r.n
    return out


def coded(distinct: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(place, part, entry, dist) of each distinct part."""

    @task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy()
            entry, dist = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            for p in np.unique(place):
                at = np.flatnonzero(place == p)
                entry[at], dist[at] = nearest(_parts_of(b, at), codebooks[p])
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("part"), pa.array(entry), pa.array(dist)], ["place", "part", "entry", "dist"])

    return distinct.select("place", "part").mapInArrow(run, "place int, part array<long>, entry long, dist long")


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vector): whole numbers floor(1024 x), of vectors without nulls and non-finite components.

    A number beyond 62 bits is cut to them. Empty vectors go.
    """
    v = F.col("vector")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-(2.0**61))), F.lit(2.0**61))))
    plain = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(v.isNotNull() & (F.size(v) > 0) & fine)
    return plain.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vector"))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): a row per kept vector; null and repeated ids are rows by themselves.

    Vectors with nulls or non-finite components go, as do empty ones, those whose length isn't a multiple of four and those of another length
    than the first by id. First are the least ids, nulls last, equal ones by their numbers. With fewer than ``entries`` vectors a codebook has as
    many entries; without any there are no rows. Sums of errors over 2^63 - 1 stay there. Labels are compared with nulls together.
    """
    kept = stored(kept_vectors(rows, id_col, vector_col, label_col).where(F.size("vector") % PARTS == 0), "vectors")
    by = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*by).select(F.size("vector").alias("n")).first()
    width = (first.n if first else PARTS) // PARTS
    kept = kept.where(F.size("vector") == PARTS * width)
    start = [r.vector for r in kept.orderBy(*by).limit(entries).select("vector").collect()]  # ``entries`` rows
    codebooks = [np.array([v[p * width : (p + 1) * width] for v in start], np.int64).reshape(-1, width) for p in range(PARTS)]
    cut = F.array(*(F.slice("vector", p * width + 1, width) for p in range(PARTS)))
    parts = kept.select("row", F.posexplode(cut).alias("place", "part"))
    distinct = stored(parts.groupBy("place", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds if start else 0):
        codebooks = updated(distinct, codebooks)
    numbers = ",".join(str(x) for c in codebooks for x in c.reshape(-1).tolist())
    found = stored(coded(distinct, codebooks), "part-codes")
    hex_code = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", hex_code.alias("hex")))), lambda x: x.hex), "")
    of_row = parts.join(found, ["place", "part"]).groupBy("row").agg(code.alias("code"), _capped(F.sum(F.col("dist").cast("decimal(38,0)"))).alias("error"))
    out = stored(kept.select("row", "id", "label").join(of_row, "row"), "vector-codes")
    labels = out.groupBy(F.col("label").alias("of_label")).agg(_capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    out = out.join(labels, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))
