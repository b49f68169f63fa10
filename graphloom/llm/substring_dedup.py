"""Operator 6: removal of bytes in strings of 50 bytes that an earlier document has too.

Every window of 50 bytes is found by its least-hashed 20-byte piece, its anchor; equal windows
have equal anchors at equal places. So only anchors, about one for 16 bytes, are compared:

1. A block of documents (dealt by a hash of id and text) sends its anchors, as hashes of the piece
   and of the whole neighbourhood (30 bytes before, 50 from it), to a bucket of the piece: for each
   neighbourhood the least document that has it. So a passage that many documents share meets
   once for each block, not once for each document.
2. A bucket tells which anchors stand in a neighbourhood that a smaller document has too: all
   their windows go. Others whose piece other documents have in other neighbourhoods are sent on.
3. Their neighbourhoods' bytes meet by bucket. There the strings from the anchors on, and those
   before them read backwards, are put in order by deep-shallow sorting (suffixes.py); common
   prefixes of neighbours in both orders show which windows are equal, byte by byte, and which
   document is the least to have them.
4. Blocks gather what was found and cut their documents.

Texts are shuffled once (one exchange that steps 1, 3 and 4 read) and anchors as packed arrays.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.suffixes import common_prefixes, deep_shallow
from graphloom.llm.workers import give_back, hold

LENGTH = 50
PIECE = 20
BEFORE = LENGTH - PIECE
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 32_000_000
PART_BYTES = 400_000
JUDGED, COMPARED = 200_000, 50_000
NULL_ID = np.iinfo(np.int64).max
WHOLE, COMPARE = 1, 2
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROW = "bucket long, block long, kind int, doc_ids binary, counts binary, pieces binary, around binary, at binary, lens binary, bytes binary"
_EMPTY = {n: b"" for n in ("doc_ids", "counts", "pieces", "around", "at", "lens", "bytes")}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every run of ``width`` values."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = f(out[:-step], out[step:]) if step else out
        done += step
    return out


def _part_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, piece hashes and neighbourhood hashes of the anchors of some documents that lie side by side in data."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < LENGTH:
        return none
    power = [pow(_BASE, k, 1 << 64) for k in (1, 2, 4, 8, 4)]
    h = _mix(data.astype(np.uint64) + np.uint64(1))
    by = {1: h}
    for k, p in zip((1, 2, 4, 8), power, strict=False):
        by[2 * k] = by[k][:-k] * np.uint64(p) + by[k][k:]
    h16, h4 = by[16], by[4]
    piece = h16[: n - PIECE + 1] * np.uint64(power[4]) + h4[16 : 16 + n - PIECE + 1]
    piece = _mix(piece) | np.uint64(1)
    least = _slide(piece, LENGTH - PIECE + 1, np.minimum)  # of the window that starts here
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    inside[starts[long]] += 1
    inside[(ends - LENGTH + 1)[long]] -= 1
    least[np.cumsum(inside[: len(least)]) == 0] = 0
    pad = np.zeros(LENGTH - PIECE, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), LENGTH - PIECE + 1, np.maximum)
    at = np.flatnonzero(most[: len(piece)] == piece)
    if not len(at):
        return none
    doc = np.searchsorted(starts, at, "right") - 1
    first, last = starts[doc], ends[doc]
    clipped = (at - BEFORE < first) | (at + LENGTH > last)
    around = np.zeros(len(at), np.uint64)
    p = at[~clipped]
    mixed = np.zeros(len(p), np.uint64)
    for shift in (-BEFORE, -BEFORE + 16, -BEFORE + 32, -BEFORE + 48, LENGTH - 16):
        mixed = _mix(mixed ^ h16[p + shift]) + np.uint64(_BASE)
    around[~clipped] = mixed
    raw = data.tobytes()
    for i in np.flatnonzero(clipped).tolist():
        a, b = max(int(first[i]), int(at[i]) - BEFORE), min(int(last[i]), int(at[i]) + LENGTH)
        around[i] = xxhash.xxh64_intdigest(raw[a:b], int(at[i]) - a + 1)
    return at, piece[at], around


class Block:
    """The documents of a block in order of id, as one row of bytes, and their anchors."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        text = table.column("text").combine_chunks().cast(pa.large_binary()) if table.num_rows else pa.array([], pa.large_binary())
        text = pc.fill_null(text, b"")
        ids = pc.fill_null(table.column("id").combine_chunks().cast(pa.int64()), NULL_ID).to_numpy()
        null = table.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((np.fromiter((xxhash.xxh64_intdigest(t.as_buffer() or b"") for t in text), np.uint64, len(text)), null, ids))
        self.order = order
        self.text, self.ids, self.null = text.take(pa.array(order)), ids[order], null[order]
        bounds = np.frombuffer(self.text.buffers()[1], np.int64)[self.text.offset : self.text.offset + len(self.text) + 1]
        whole = self.text.buffers()[2]
        self.data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None and len(ids) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.starts, self.ends = bounds[:-1], bounds[1:]
        parts, a = [], 0
        cut = np.flatnonzero(np.diff(self.ends // PART_BYTES)) + 1
        for b in [*cut.tolist(), len(ids)]:
            if b > a:
                lo, hi = self.starts[a], self.ends[b - 1]
                at, piece, around = _part_anchors(self.data[lo:hi], self.starts[a:b] - lo, self.ends[a:b] - lo)
                parts.append((at + lo, piece, around))
                a = b
        self.at, self.piece, self.around = (np.concatenate(x) if parts else np.zeros(0, np.uint64) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        self.at = self.at.astype(np.int64)
        self.doc = np.searchsorted(self.starts, self.at, "right") - 1
        # an empty document starts where the next does: take the one that holds the place
        self.before = np.minimum(self.at - self.starts[self.doc], BEFORE) if len(self.at) else self.at
        self.after = np.minimum(self.ends[self.doc] - self.at, LENGTH) if len(self.at) else self.at

        # of equal neighbourhoods the first anchor of the least document stands for all
        order = np.lexsort((self.at, self.ids[self.doc], self.around, self.piece))
        p, a = self.piece[order], self.around[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (a[1:] != a[:-1])
        self.stands = np.empty(len(order), np.int64)
        self.stands[order] = order[fresh][np.cumsum(fresh) - 1]
        self.later = self.ids[self.doc] > self.ids[self.doc[self.stands]]

    def of_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Which anchors each bucket gets, in order of place: those that stand for a neighbourhood."""
        own = np.flatnonzero(self.stands == np.arange(len(self.at)))
        bucket = ((self.piece[own] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, own = bucket[order], own[order]
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        for b, some in zip(bucket[start].tolist(), np.split(own, start[1:]), strict=True) if len(own) else ():
            yield b, some

    def for_all(self, mark: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the anchors that stand for others were told, for all anchors."""
        return np.where(self.later, WHOLE, mark[self.stands]), found[self.stands]


def _rows(rows: list[dict]) -> pa.Table:
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in ROW.split(", "))])
    return pa.Table.from_pylist([_EMPTY | r for r in rows], schema)


def _send_anchors(buckets: int):
    def send(key: tuple, docs: pa.Table) -> pa.Table:
        block = Block(docs)
        out = []
        for bucket, which in block.of_bucket(buckets):
            doc, counts = np.unique(block.doc[which], return_counts=True)
            out.append({
                "bucket": bucket, "block": key[0].as_py(), "kind": 0, "doc_ids": block.ids[doc].astype("<i8").tobytes(), "counts": counts.astype("<u4").tobytes(),
                "pieces": (block.piece[which] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), "around": block.around[which].astype("<u8").tobytes(),
            })
        return _rows(out)

    return send


def _lean(f: Callable) -> Callable:
    """f of a group (of two tables, if it takes three arguments), which gives the worker's memory back when it ends."""

    def run(*given) -> pa.Table:
        hold()
        try:
            return f(*given)
        finally:
            give_back()

    two = len(inspect.signature(f).parameters) == 2
    return (lambda key, rows: run(key, rows)) if two else (lambda key, left, right: run(key, left, right))  # Spark counts arguments


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, one after another, and how many each row has."""
    column = column.combine_chunks().cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].view(kind)
    return data, np.diff(bounds) // data.itemsize


def _parts(piece: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places of the anchors in runs of about ``most``, those of a piece in one."""
    parts = -(-len(piece) // most)
    if parts < 2:
        yield np.arange(len(piece))
        return
    part = ((piece >> piece.dtype.type(1)) % piece.dtype.type(parts)).astype(np.int32)  # the last bit is always set
    for i in range(parts):
        yield np.flatnonzero(part == i)


def _marked(doc: np.ndarray, piece: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Step 2: a mark for each anchor. Anchors of a piece are all there."""
    if not len(doc):
        return np.zeros(0, np.uint8)
    order = np.lexsort((doc, around, piece))
    d, p, a = doc[order], piece[order], around[order]
    new_piece = np.concatenate([[True], p[1:] != p[:-1]])
    new_around = new_piece | np.concatenate([[True], a[1:] != a[:-1]])
    piece_of, around_of = np.cumsum(new_piece) - 1, np.cumsum(new_around) - 1
    at = np.flatnonzero(new_piece)
    several = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)) & (np.add.reduceat(new_around.astype(np.int64), at) > 1)
    first = d[np.flatnonzero(new_around)][around_of]
    back = np.empty(len(d), np.uint8)
    back[order] = np.where(d > first, WHOLE, np.where(several[piece_of], COMPARE, 0))
    return back


def _judge(key: tuple, anchors: pa.Table) -> pa.Table:
    """Step 2 on a bucket, some pieces at a time; the marks go back to the anchors' blocks."""
    ids, (counts, _), (piece, n), (around, _) = _joined(anchors.column("doc_ids"), "<i8")[0], *(_joined(anchors.column(c), t) for c, t in (("counts", "<u4"), ("pieces", "<u4"), ("around", "<u8")))
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    back = np.empty(len(piece), np.uint8)
    for some in _parts(piece, JUDGED):
        back[some] = _marked(ids[doc[some]], piece[some], around[some])
    cut = np.cumsum([0, *n])
    return _rows([{"bucket": key[0].as_py(), "block": r, "kind": 0, "at": back[cut[i] : cut[i + 1]].tobytes()} for i, r in enumerate(anchors.column("block").to_pylist())])


def _marks(block: Block, table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor: its mark, and the windows (bits) found by comparing."""
    mark, found = np.zeros(len(block.at), np.uint8), np.zeros(len(block.at), np.uint64)
    which = dict(block.of_bucket(buckets))
    for r in table.to_pylist():
        if r["kind"] == 0:
            mark[which[r["bucket"]]] = np.frombuffer(r["at"], np.uint8)
    for r in table.to_pylist():
        if r["kind"] == 1:
            i = which[r["bucket"]]
            found[i[mark[i] == COMPARE]] = np.frombuffer(r["at"], "<u8")
    return mark, found


def _send_bytes(buckets: int):
    def send(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        """Step 3: the neighbourhoods to compare; the marks travel on with them."""
        if not docs.num_rows or not marks.num_rows:
            return _rows([])
        block = Block(docs)
        mark, _ = _marks(block, marks, buckets)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), block.data, np.zeros(LENGTH, np.uint8)])
        out = []
        for bucket, which in block.of_bucket(buckets):
            which = which[mark[which] == COMPARE]
            if len(which):
                rows = padded[block.at[which][:, None] + np.arange(BEFORE + LENGTH)]
                rows[:, :BEFORE][np.arange(BEFORE) < (BEFORE - block.before[which])[:, None]] = 0
                rows[:, BEFORE:][np.arange(LENGTH) >= block.after[which][:, None]] = 0
                lens = np.stack([block.before[which], block.after[which]], axis=1).astype(np.uint8)
                out.append({"bucket": bucket, "block": key[0].as_py(), "kind": 1, "doc_ids": block.ids[block.doc[which]].astype("<i8").tobytes(), "pieces": block.piece[which].astype("<u8").tobytes(), "lens": lens.tobytes(), "bytes": rows.tobytes()})
        for r in marks.to_pylist():
            out.append({"bucket": r["bucket"], "block": r["block"], "kind": 0, "at": r["at"]})
        return _rows(out)

    return send


def equal_windows(piece: np.ndarray, doc: np.ndarray, rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bits of the windows, by bytes before the anchor, that a smaller document has at the same piece.

    rows: BEFORE bytes before each anchor and LENGTH from it, zeros where the document ends.
    """
    n = len(piece)
    left, right = np.ascontiguousarray(rows[:, BEFORE - 1 :: -1] if BEFORE else rows[:, :0]), rows[:, BEFORE:]
    sides = []
    for side, lens, shallow in ((left, before, 16), (right, after, 32)):
        order = deep_shallow(piece, side, lens, shallow)
        common = common_prefixes(order, side, lens)
        common[np.concatenate([[True], piece[order[1:]] != piece[order[:-1]]])] = -1
        sides.append((order, common))
    found = np.zeros(n, np.uint64)
    for o in range(BEFORE + 1):
        able = (before >= o) & (after >= LENGTH - o)
        if able.sum() < 2:
            continue
        ids = []
        for (order, common), depth in zip(sides, (o, LENGTH - o), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(common < depth)
            ids.append(own)
        which = np.flatnonzero(able)
        cell = ids[0][which] * np.int64(n + 1) + ids[1][which]
        order = np.lexsort((doc[which], cell))
        c, d = cell[order], doc[which][order]
        fresh = np.concatenate([[True], c[1:] != c[:-1]])
        least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        found[which[order[d > least]]] |= np.uint64(1 << o)
    return found


def _compare(key: tuple, near: pa.Table) -> pa.Table:
    told = near.select(["bucket", "block", "kind", "at"]).to_pylist()
    own = [r for r in told if r["kind"] == 1]  # each with an anchor at least
    out = [r for r in told if r["kind"] == 0]
    if own:
        doc, n = _joined(near.column("doc_ids"), "<i8")
        piece, rows = _joined(near.column("pieces"), "<u8")[0], _joined(near.column("bytes"), "u1")[0].reshape(-1, BEFORE + LENGTH)
        lens = _joined(near.column("lens"), "u1")[0].reshape(-1, 2)
        found = np.zeros(len(piece), np.uint64)
        for some in _parts(piece, COMPARED):
            if len(some):
                found[some] = equal_windows(piece[some], doc[some], rows[some], *lens[some].astype(np.int64).T)
        cut = np.cumsum([0, *n[n > 0]])
        out += [{"bucket": r["bucket"], "block": r["block"], "kind": 1, "at": found[cut[i] : cut[i + 1]].astype("<u8").tobytes()} for i, r in enumerate(own)]
    return _rows(out)


def _covered(first: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a window; first: whether one starts there."""
    place = np.arange(len(first), dtype=np.int32)
    last = np.where(first, place, np.int32(-LENGTH))
    np.maximum.accumulate(last, out=last)
    np.subtract(place, last, out=last)
    return last < LENGTH


def _whole_characters(data: np.ndarray, gone: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte's UTF-8 character has lost a byte; starts, ends: the runs of lost bytes."""
    inner, gone = (data & 0xC0) == 0x80, gone.copy()
    for _ in range(3):
        starts = starts[inner[starts]] - 1
        ends = ends[ends < len(data)]
        ends = ends[inner[ends]]
        gone[starts] = gone[ends] = True
        ends = ends + 1
    return gone


def _cut(buckets: int, id_type: pa.DataType, carried: list[str], as_text: bool):
    def cut(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        """Step 4: documents without the bytes of found windows, and the runs that went."""
        block = Block(docs)
        gone = np.zeros(len(block.data), bool)
        if marks.num_rows:
            mark, found = block.for_all(*_marks(block, marks, buckets))
            for o in range(BEFORE + 1):
                able = (block.before >= o) & (block.after >= LENGTH - o)
                gone[block.at[able & ((mark == WHOLE) | ((found >> np.uint64(o)) & np.uint64(1) > 0))] - o] = True
            gone = _covered(gone)
        before = np.concatenate([[False], gone[:-1]])[: len(gone)]
        before[block.starts[block.starts < len(gone)]] = False
        after = np.concatenate([gone[1:], [False]])[: len(gone)]
        after[block.ends[block.ends > 0] - 1] = False
        starts, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        runs = np.searchsorted(starts, np.append(block.starts, len(gone)))
        base = np.repeat(block.starts, np.diff(runs))
        gone = _whole_characters(block.data, gone, starts, ends) if as_text else gone
        left = np.append(np.cumsum(~gone, dtype=np.int32), 0)  # of the bytes up to each; the last place stands for none
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(left[np.append(block.starts, len(gone)) - 1].astype(np.int64)), pa.py_buffer(block.data[~gone])])
        spans = [pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(x - base, pa.int64())) for x in (starts, ends)]
        ids = pa.array(np.where(block.null, 0, block.ids), mask=block.null).cast(id_type)
        return pa.Table.from_arrays([ids, pa.array(block.ends - block.starts, pa.int64()), kept.cast(pa.string() if as_text else pa.binary()), *spans, *(docs.column(c).take(pa.array(block.order)) for c in carried)], ["id", "n_bytes", "kept", "starts", "ends", *carried])

    return cut


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, n_bytes, kept, starts, ends, keep): the remaining bytes, and the maximal runs of removed ones.

    One row per input row, with its columns ``keep``. A byte goes if it lies in a 50-byte string that also starts in a row of
    smaller id; rows of equal id take nothing from each other. Null texts are empty, texts of under
    50 bytes stay whole. A null id counts as greater than all others. Ids are integers, others are an
    error. ``as_text``: kept is a string, without the characters that lost a byte.

    Blocks and buckets grow with the bytes of all texts: a block holds about ``block_bytes`` of text,
    a bucket the anchors, 12 bytes each, of ``bucket_bytes``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind)
    if id_type is None:
        raise ValueError(f"{id_col} must be an integer, not {kind}")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = -(-size // block_bytes) or 1, -(-size // bucket_bytes) or 1
    carried = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for n, c in zip(carried, keep, strict=True)))
    texts = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long").alias("block"), "id", "text", *carried)
    anchors = texts.groupBy("block").applyInArrow(_lean(_send_anchors(buckets)), ROW)
    marks = anchors.groupBy("bucket").applyInArrow(_lean(_judge), ROW)
    near = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_lean(_send_bytes(buckets)), ROW)
    found = near.groupBy("bucket").applyInArrow(_lean(_compare), ROW)
    fields = ", ".join([f"id {kind}, n_bytes long, kept {'string' if as_text else 'binary'}, starts array<long>, ends array<long>", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(carried, keep, strict=True))])
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_lean(_cut(buckets, id_type, carried, as_text)), fields)
    return out.select(F.col("id").alias(id_col), "n_bytes", "kept", "starts", "ends", *(F.col(n).alias(c) for n, c in zip(carried, keep, strict=True)))
