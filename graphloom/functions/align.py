"""Edit distance with free ends and IUPAC equalities, for pandas UDFs; numpy rows, one per letter of the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases that each ambiguous letter equals; two different ambiguous letters are never equal.
EQUAL = {"M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def _equal_table() -> np.ndarray:
    table = np.eye(256, dtype=bool)
    for code, bases in EQUAL.items():
        for b in bases:
            table[ord(code), ord(b)] = table[ord(b), ord(code)] = True
    return table


_EQUAL = _equal_table()


def matrix(query: str, target: str, free_start: bool = False) -> np.ndarray:
    """All prefix distances: rows by letters of the query, columns by letters of the target."""
    q, t = (np.frombuffer(x.encode("ascii", "replace"), np.uint8) for x in (query, target))
    kind = np.int16 if len(q) + len(t) < 1 << 15 else np.int32
    step = np.arange(len(t) + 1, dtype=kind)
    rows = np.empty((len(q) + 1, len(t) + 1), kind)
    rows[0] = 0 if free_start else step
    for i, c in enumerate(q):
        best = np.empty(len(t) + 1, kind)
        best[0] = i + 1
        best[1:] = np.minimum(rows[i, :-1] + ~_EQUAL[c, t], rows[i, 1:] + 1)
        rows[i + 1] = np.minimum.accumulate(best - step) + step  # then insertions, from left to right
    return rows


def matrices(pairs: list[tuple[str, str]], free_start: bool = False, cells: int = 1 << 21) -> Iterator[np.ndarray]:
    """``matrix`` of each pair; pairs are laid side by side, up to ``cells`` numbers at a time."""
    a = 0
    while a < len(pairs):
        z, width, height = a, 0, 0
        while z < len(pairs):
            w, h = max(width, len(pairs[z][1]) + 1), max(height, len(pairs[z][0]) + 1)
            if z > a and (z + 1 - a) * w * h > cells:
                break
            z, width, height = z + 1, w, h
        some = pairs[a:z]
        kind = np.int16 if width + height < 1 << 15 else np.int32
        q, t = np.zeros((len(some), height - 1), np.uint8), np.zeros((len(some), width - 1), np.uint8)
        for own_q, own_t, (x, y) in zip(q, t, some, strict=True):
            own_q[: len(x)] = np.frombuffer(x.encode("ascii", "replace"), np.uint8)
            own_t[: len(y)] = np.frombuffer(y.encode("ascii", "replace"), np.uint8)
        step = np.arange(width, dtype=kind)
        rows = np.empty((height, len(some), width), kind)
        rows[0] = 0 if free_start else step
        for i in range(height - 1):
            best = np.empty((len(some), width), kind)
            best[:, 0] = i + 1
            best[:, 1:] = np.minimum(rows[i, :, :-1] + ~_EQUAL[q[:, i, None], t], rows[i, :, 1:] + 1)
            rows[i + 1] = np.minimum.accumulate(best - step, axis=1) + step  # then insertions, from left to right
        for n, (x, y) in enumerate(some):
            yield rows[: len(x) + 1, n, : len(y) + 1]
        a = z


def mismatches(target: str) -> dict[str, np.ndarray]:
    """For each base, which letters of the target differ from it."""
    t = np.frombuffer(target.encode("ascii", "replace"), np.uint8)
    return {c: (~_EQUAL[ord(c), t]).astype(np.int32) for c in "ACGT"}


def next_row(row: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """The row of the distance matrix one letter of the query on."""
    at = np.arange(len(row), dtype=row.dtype)
    new = np.empty_like(row)
    new[0] = row[0] + 1
    np.minimum(row[1:] + 1, row[:-1] + differs, out=new[1:])
    return np.minimum.accumulate(new - at) + at


def last_row(query: str, target: str) -> np.ndarray:
    """Distances of the whole query to all prefixes of the target."""
    t = np.frombuffer(target.encode("ascii", "replace"), np.uint8)
    row = np.arange(len(t) + 1, dtype=np.int32)
    for c in query.encode("ascii", "replace"):
        row = next_row(row, ~_EQUAL[c, t])
    return row


def operations(query: str, target: str, mode: str = "NW") -> str:
    """The CIGAR with a letter for each column."""
    import re

    return "".join(op * int(n) for n, op in re.findall(r"(\d+)(.)", align(query, target, mode)["cigar"]))


def align(query: str, target: str, mode: str = "NW") -> dict:
    """Distance, all ends of the best alignments, and the CIGAR of the first; NW whole, SHW suffix and HW both ends of the target free."""
    if not query or not target:
        n = max(len(query), len(target)) if mode == "NW" else len(query)
        return {"dist": n, "ends": [len(target) - 1 if mode == "NW" else -1], "start": 0, "cigar": ""}
    return _traced(query, target, mode, matrix(query, target, mode == "HW"))


def _best(d: np.ndarray, mode: str) -> tuple[int, list[int]]:
    """Distance, and the letters of the target up to each end."""
    dist = int(d[-1, -1] if mode == "NW" else d[-1].min())
    return dist, [d.shape[1] - 1] if mode == "NW" else np.flatnonzero(d[-1] == dist).tolist()


def _traced(query: str, target: str, mode: str, d: np.ndarray) -> dict:
    dist, ends = _best(d, mode)
    i, j, ops = len(query), ends[0], []
    while i > 0 or (j > 0 and mode != "HW"):
        if i and j and d[i, j] == d[i - 1, j - 1] + (not _EQUAL[ord(query[i - 1]) & 255, ord(target[j - 1]) & 255]):
            ops.append("=" if d[i, j] == d[i - 1, j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    ops.reverse()
    cuts = [k for k in range(len(ops)) if k == 0 or ops[k] != ops[k - 1]] + [len(ops)]
    return {"dist": dist, "ends": [e - 1 for e in ends], "start": j, "cigar": "".join(f"{b - a}{ops[a]}" for a, b in zip(cuts, cuts[1:], strict=False))}


def standard_cigar(cigar: str) -> str:
    """= and X as M."""
    import re

    out: list[list] = []
    for n, op in re.findall(r"(\d+)(.)", cigar):
        op = "M" if op in "=X" else op
        if out and out[-1][1] == op:
            out[-1][0] += int(n)
        else:
            out.append([int(n), op])
    return "".join(f"{n}{op}" for n, op in out)


def slice_cigar(cigar: str, start: int, end: int) -> tuple[int, int]:
    """Where [start, end) of the target lies in the query."""
    import re

    q = t = 0
    first = last = None
    for n, op in re.findall(r"(\d+)(.)", cigar):
        for _ in range(int(n)):
            if op != "I":
                if t == start and first is None:
                    first = q
                if t == end and last is None:
                    last = q
            q, t = q + (op != "D"), t + (op != "I")
    return (q if first is None else first), (q if last is None else last)


def _each(q: pd.Series, t: pd.Series, mode: str, of: Callable[[str, str, np.ndarray], dict]) -> list:
    """What ``of`` makes of each pair and its matrix, each distinct pair once; None for a null, ``align`` for an empty string."""
    pairs = list(zip(q, t, strict=True))
    distinct = [p for p in dict.fromkeys(pairs) if p[0] and p[1]]
    found = {p: of(*p, d) for p, d in zip(distinct, matrices(distinct, mode == "HW"), strict=True)}
    return [None if p[0] is None or p[1] is None else found[p] if p in found else align(*p, mode) for p in pairs]


def alignment(query: Column, target: Column, mode: str = "NW") -> Column:
    """STRUCT<dist, ends, start, cigar>; null if either is null."""

    @F.pandas_udf("dist int, ends array<int>, start int, cigar string")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        names = ["dist", "ends", "start", "cigar"]
        rows = _each(q, t, mode, lambda a, b, d: _traced(a, b, mode, d))
        return pd.DataFrame([[None] * 4 if r is None else [r[c] for c in names] for r in rows], columns=names)

    return run(query, target)


def distance(query: Column, target: Column, mode: str = "NW") -> Column:
    """STRUCT<dist, ends> as in ``alignment``, without the way there."""

    @F.pandas_udf("dist int, ends array<int>")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        def ends(a: str, b: str, d: np.ndarray) -> dict:
            dist, at = _best(d, mode)
            return {"dist": dist, "ends": [e - 1 for e in at]}

        rows = _each(q, t, mode, ends)
        return pd.DataFrame([[None] * 2 if r is None else [r["dist"], r["ends"]] for r in rows], columns=["dist", "ends"])

    return run(query, target)


def global_distance(a: Column, b: Column) -> Column:
    """Of plain bases; with ambiguous letters use alignment()."""
    return F.levenshtein(a, b)


def best_candidate(candidates, group: list[str], text: str, reference: str, order: str):
    """The candidate of least distance by the longer length; the first of equal ones."""
    share = F.levenshtein(text, reference) / F.greatest(F.length(text), F.length(reference), F.lit(1))
    return candidates.groupBy(*group).agg(F.min(F.struct(share.alias("score"), F.col(order).alias("order"), F.col(text).alias("text"))).alias("best")).select(*group, "best.score", "best.order", "best.text")


def best_aligned(candidates, group: list[str], text: str, reference: str, order: str, mode: str = "SHW", cut: float | None = None):
    """The candidate that lies best at the start of the reference (SHW) or anywhere in it (HW); the first of equal ones.

    score = distance / the candidate's length. Empty and null candidates are left out, and with a
    ``cut`` those of a higher score, so a group may have no row.
    """
    share = distance(F.col(text), F.col(reference), mode)["dist"] / F.length(text)
    scored = candidates.where(F.length(text) > 0).select(*group, share.alias("score"), F.col(order).alias("order"), F.col(text).alias("text"))
    scored = scored if cut is None else scored.where(F.col("score") <= cut)
    return scored.groupBy(*group).agg(F.min(F.struct("score", "order", "text")).alias("best")).select(*group, "best.*")
