"""k-mers of up to 31 letters as longs, two bits a letter, counted by slots of their minimizers.

Neighbouring k-mers mostly have their least m-mer in common. Runs of such k-mers, super-k-mers, are shuffled whole by a hash of it:
a third of the letters' bytes and no row per k-mer. Both strands of a k-mer have one minimizer, so a slot has all places of
its k-mers, and what is asked of a k-mer is answered slot by slot in sorted arrays.
k-mers with other letters than ACGT are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
NO_KEY = -(1 << 63)  # stands for null
SLICE = 1 << 17  # letters, or k-mers, that are worked on together
LOT = SLICE // 16  # super-k-mers of whole slots that are worked on together
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_U = np.uint64


def minimizer_length(k: int) -> int:
    return min(11, (k + 1) // 2)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _windows(one: np.ndarray, size: int, join: Callable) -> np.ndarray:
    """At each place what ``join(left, right, letters of the left, of the right)`` makes of ``size`` places from there on, by doubling."""
    done, n, power, width = None, 0, one, 1
    while size:
        if size & 1:
            done, n = (power, width) if done is None else (join(done[: len(power) - n], power[n:], n, width), n + width)
        size >>= 1
        if size:
            power = join(power[:-width], power[width:], width, width)
            width *= 2
    return done


def _forward(kind: type) -> Callable:
    def join(a, b, n, m):
        b = b[: len(a)]
        return (a[: len(b)] << kind(2 * m)) | b

    return join


def _backward(kind: type) -> Callable:
    def join(a, b, n, m):
        b = b[: len(a)]
        return a[: len(b)] | (b << kind(2 * n))

    return join


def _least(a, b, n, m):
    b = b[: len(a)]
    return np.minimum(a[: len(b)], b)


def reverse_complement(x: np.ndarray, k: int) -> np.ndarray:
    """Of packed k-mers."""
    x = ~x
    x = ((x >> _U(2)) & _U(0x3333333333333333)) | ((x & _U(0x3333333333333333)) << _U(2))
    x = ((x >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) | ((x & _U(0x0F0F0F0F0F0F0F0F)) << _U(4))
    return x.byteswap() >> _U(64 - 2 * k)


def rc(x: Column, k: int) -> Column:
    """Of a packed k-mer in a column."""
    x = F.bitwise_not(x)
    for by, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, by).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), by))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def named() -> Column:
    """The key, null where the read had none."""
    return F.nullif(F.col("key"), F.lit(NO_KEY)).alias("key")


def letters(x: Column, k: int) -> Column:
    """A packed k-mer as text."""
    return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed(kmer: Column) -> Column:
    """A k-mer as text, of up to 31 plain bases, as a long."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def _super(flat: np.ndarray, own: np.ndarray, lead: np.ndarray, tail: np.ndarray, k: int, flank: int) -> tuple[np.ndarray, ...]:
    """(start, n, slot, hi, lo, none before, none after): super-k-mers of reads laid end to end, which begin at ``own``.

    hi and lo are the 64 letters from ``flank`` before the start on. ``lead`` and ``tail`` letters of a read are flanks alone.
    """
    m, n = minimizer_length(k), len(flat)
    code = np.concatenate([np.zeros(flank, np.uint8), _CODE[flat], np.zeros(64, np.uint8)])
    bad = code > 3
    other = bad.any()
    if other:
        wrong = np.concatenate([[0], np.cumsum(bad)])
        code[bad] = 0
    one = code[flank:].astype(np.uint32)
    ahead = _windows(one, m, _forward(np.uint32))
    back = _windows(one ^ np.uint32(3), m, _backward(np.uint32))
    least = _windows(_mix(np.minimum(ahead[: n + 32], back[: n + 32])), k - m + 1, _least)[:n]
    place, length = np.arange(n), np.diff(own)
    valid = (place >= np.repeat(own[:-1] + lead, length)) & (place <= np.repeat(own[1:] - tail - k, length))
    if other:
        valid &= wrong[flank + k : flank + k + n] == wrong[flank : flank + n]
    fresh = np.zeros(n, bool)
    fresh[own[:-1][length > 0]] = True
    fresh[1:] |= (least[1:] != least[:-1]) | ~valid[:-1]
    at = np.flatnonzero(fresh & valid)
    stop = np.append(np.flatnonzero(fresh | ~valid), n)
    count = stop[np.searchsorted(stop, at, "right")] - at
    most = 64 - 2 * flank - k + 1
    if len(count) and count.max() > most:  # the same minimizer again and again
        parts = -(-count // most)
        of = np.repeat(np.arange(len(at)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, count = at[of] + nth * most, np.minimum(count[of] - nth * most, most)
    wide = _windows(code.astype(np.uint64), 32, _forward(np.uint64))
    hi, lo = wide[at], wide[at + 32]
    rest = np.clip(64 - (count + k - 1 + 2 * flank), 0, 31).astype(np.uint64) * _U(2)
    slot = (_mix(least[at] ^ np.uint32(0x9E3779B9)) % np.uint32(SLOTS)).astype(np.int32)
    of = np.searchsorted(own, at, "right") - 1
    open_, shut = at == own[of], at + count + k - 1 == own[of + 1]
    if other:
        open_ |= bad[at + flank - 1]
        shut |= bad[at + count + k - 1 + flank]
    return at, count, slot, hi, (lo >> rest) << rest, open_, shut


def super_kmers(reads: DataFrame, k: int, key: str | None = None, side: int = 0, seq_col: str = "seq", flank: int = 0) -> DataFrame:
    """(slot, hi, lo, n, key, pos): the super-k-mers of reads, each of n k-mers from pos on. key: a whole number, 0 where none is named.

    With a ``flank`` of 1 the letters hold one more before and after, and n has two more bits: 128 where there is no letter
    before the first k-mer, 256 where there is none after the last. ``side`` stands in the bits from 1024 on.
    """
    if k > 31:
        raise ValueError("k-mers of over 31 letters don't fit in a long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column("seq").cast(pa.large_binary())
            keys, base, lead, tail = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "base", "lead", "tail"))
            offsets = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(keys):
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
                flat, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                at, n, slot, hi, lo, open_, shut = _super(flat, own, lead[a:z], tail[a:z], k, flank)
                of = np.searchsorted(own, at, "right") - 1
                pos = (base[a:z][of] + at - own[of] - lead[a:z][of]).astype(np.int32)
                n = (n + 128 * open_ + 256 * shut + 1024 * side).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n), pa.array(keys[a:z][of]), pa.array(pos)], ["slot", "hi", "lo", "n", "key", "pos"])
                a = z

    # a long read is cut in stretches that overlap by what k-mers and flanks need
    whole = reads.where(F.length(seq_col) >= k).select(F.col(seq_col).alias("__s"), (F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)) if key else F.lit(0).cast("long")).alias("key"), F.explode(F.sequence(F.lit(0), F.length(seq_col) - k, F.lit(SLICE))).alias("base"))
    lead, tail = F.least(F.col("base"), F.lit(flank)), F.least(F.greatest(F.length("__s") - F.col("base") - SLICE - k + 1, F.lit(0)), F.lit(flank))
    rows = whole.select("__s", "key", "base", lead.alias("lead"), tail.alias("tail"))
    rows = rows.select(F.col("__s").substr(F.col("base") - F.col("lead") + 1, F.lit(SLICE + k - 1) + F.col("lead") + F.col("tail")).alias("seq"), "key", "base", "lead", "tail")
    return rows.mapInArrow(run, "slot int, hi long, lo long, n int, key long, pos int")


def _kmers(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, k: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, k-mer) of all k-mers of super-k-mers, ``skip`` letters on."""
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    by = ((i + skip) * 2).astype(np.uint64)
    over = by >= 64
    by &= _U(63)
    low = lo[of]
    x = np.where(over, low, hi[of]) << by
    x |= np.where(over, _U(0), (low >> _U(1)) >> (_U(63) - by))
    return of, i, x >> _U(64 - 2 * k)


class Slots:
    """The super-k-mers of some whole slots, in order of key."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        t = pa.Table.from_batches(parts).combine_chunks()
        self.k = k
        self.cols = {c: t.column(c).to_numpy() for c in t.column_names}
        n = self.cols["n"]
        self.flags, self.side, self.n = n & 384, n >> 10, n & 127

    def stretches(self, side: int | None = None, by_key: bool = False) -> Iterator[np.ndarray]:
        """Rows, in stretches of about ``SLICE`` k-mers; with by_key all rows of one key in a slot are in one."""
        rows = np.arange(len(self.n)) if side is None else np.flatnonzero(self.side == side)
        if not len(rows):
            return
        total = np.cumsum(self.n[rows])
        if by_key:
            slot, key = self.cols["slot"][rows], self.cols["key"][rows]
            ends = np.append(np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1, len(rows))
        else:
            ends = np.arange(1, len(rows) + 1)
        a = done = 0
        while a < len(rows):
            i = np.searchsorted(total[ends - 1], done + SLICE, "right") - 1
            z = int(ends[max(i, np.searchsorted(ends, a, "right"))])
            yield rows[a:z]
            a, done = z, total[z - 1]

    def canonical(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, canonical k-mer, whether it stands as it is) of the rows."""
        of, i, x = _kmers(self.cols["hi"].view(np.uint64)[rows], self.cols["lo"].view(np.uint64)[rows], self.n[rows], self.k)
        y = reverse_complement(x, self.k)
        return rows[of], i, np.minimum(x, y), x <= y


def tally(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct values in order and their number, or the sums of n over them (a row per measure)."""
    if n is None:
        x = np.sort(x)
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        return x[at], np.diff(np.append(at, len(x)))
    order = np.argsort(x, kind="stable")
    x = x[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.add.reduceat(n[..., order], at, axis=-1) if len(x) else n


def totals(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The tallies of stretches put together; no more than the distinct values and one stretch are held."""
    x = n = None
    for y, m in parts:
        x, n = (y, m) if x is None else tally(np.concatenate([x, y]), np.concatenate([n, m], axis=-1))
    return x, n


def by_slots(pieces: DataFrame, k: int, fold: Callable[[Slots], Iterator[list]], schema: str, ordered: bool = False) -> DataFrame:
    """What ``fold`` makes of each lot of whole slots, as columns of the schema."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(p.num_rows for p in parts):
                for out in fold(Slots(parts, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column("slot").to_numpy()
            change = np.flatnonzero(slot[1:] != slot[:-1]) + 1
            cut = int(change[-1]) if len(change) else 0
            if rows and slot[0] != held[-1].column("slot")[held[-1].num_rows - 1].as_py() and rows >= LOT:
                yield from done(held)
                held, rows = [], 0
            if cut and rows + cut >= LOT:
                yield from done([*held, b.slice(0, cut)])
                held, rows = [b.slice(cut)], b.num_rows - cut
            else:
                held.append(b)
                rows += b.num_rows
        yield from done(held)

    by = ["slot", "key"] if ordered else ["slot"]
    return pieces.repartition("slot").sortWithinPartitions(*by).mapInArrow(run, schema)


def counts(reads: DataFrame, k: int, least: int = 1, seq_col: str = "seq") -> DataFrame:
    """(rep, n): places of each canonical k-mer, packed, that has ``least`` or more."""

    def fold(s: Slots) -> Iterator[list]:
        x, n = totals(tally(s.canonical(r)[2]) for r in s.stretches())
        some = n >= least
        yield [x[some].view(np.int64), n[some]]

    return by_slots(super_kmers(reads, k, seq_col=seq_col).drop("key", "pos"), k, fold, "rep long, n long")


def least_kmers(reads: DataFrame, k: int, keep: list[str], seq_col: str = "seq") -> DataFrame:
    """(keep, head): the least canonical k-mer of each read, packed; reads without any have no row. Nothing is shuffled."""
    if k > 31:
        raise ValueError("k-mers of over 31 letters don't fit in a long")

    def least(flat: np.ndarray) -> np.ndarray:
        """At each place the canonical k-mer, the greatest number where there is none."""
        code = _CODE[flat]
        wrong = np.concatenate([[0], np.cumsum(code > 3)])
        one = np.where(code > 3, 0, code).astype(np.uint64)
        x = np.minimum(_windows(one, k, _forward(np.uint64)), _windows(one ^ _U(3), k, _backward(np.uint64)))[: len(flat) - k + 1]
        return np.where(wrong[k:] == wrong[:-k], x, ~_U(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column("seq").cast(pa.large_binary())
            offsets = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)
            head = np.full(len(seq), ~_U(0))
            a = 0
            while a < len(seq):
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
                for start in range(offsets[a], offsets[z], SLICE):  # a read of over a slice is gone through in stretches
                    flat = data[start : min(start + SLICE + k - 1, offsets[z])]
                    if len(flat) < k:
                        continue
                    x, own = least(flat), offsets[a : z + 1] - start
                    of = np.repeat(np.arange(a, z), np.diff(np.clip(own, 0, len(x))))
                    whole = np.arange(len(x)) + k <= own[of - a + 1]
                    np.minimum.at(head, of[whole], x[whole])
                a = z
            some = pa.array(head != ~_U(0))
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(some) for c in keep), pa.array(head[head != ~_U(0)].view(np.int64))], [*keep, "head"])

    fields = ", ".join(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in keep)
    return reads.where(F.length(seq_col) >= k).select(*keep, F.col(seq_col).alias("seq")).mapInArrow(run, f"{fields}, head long")


def spectrum(reads: DataFrame, k: int) -> DataFrame:
    """(n, n_kmers): how many canonical k-mers are found n times."""

    def fold(s: Slots) -> Iterator[list]:
        n, m = tally(totals(tally(s.canonical(r)[2]) for r in s.stretches())[1])
        yield [n, m]

    parts = by_slots(super_kmers(reads, k).drop("key", "pos"), k, fold, "n long, n_kmers long")
    return parts.groupBy("n").agg(F.sum("n_kmers").alias("n_kmers"))


def counts_by_reads(reads: DataFrame, k: int, key: str, least: int = 1) -> DataFrame:
    """(rep, n, d): places of each canonical k-mer and the reads that they are in. key: a whole number."""

    def one(s: Slots, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, _, x, _ = s.canonical(r)
        key = s.cols["key"][row]
        order = np.lexsort((key, x))
        x, key = x[order], key[order]
        fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])]) & (key != NO_KEY)
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[at], np.stack([np.diff(np.append(at, len(x))), np.add.reduceat(fresh.astype(np.int64), at)])

    def fold(s: Slots) -> Iterator[list]:
        x, n = totals(one(s, r) for r in s.stretches(by_key=True))
        some = n[0] >= least
        yield [x[some].view(np.int64), n[0][some], n[1][some]]

    return by_slots(super_kmers(reads, k, key).drop("pos"), k, fold, "rep long, n long, d long", True)


def coverage(reads: DataFrame, k: int, key: str, least: int = 2) -> DataFrame:
    """(key, n_solid, total): of each read the places of k-mers found ``least`` times or more, and the sum of how often these are found."""

    def fold(s: Slots) -> Iterator[list]:
        x, n = totals(tally(s.canonical(r)[2]) for r in s.stretches())
        for r in s.stretches():
            row, _, y, _ = s.canonical(r)
            found = n[np.searchsorted(x, y)]
            some = found >= least
            keys, sums = tally(s.cols["key"][row[some]], np.stack([np.ones(int(some.sum()), np.int64), found[some]]))
            yield [keys, sums[0], sums[1]]

    parts = by_slots(super_kmers(reads, k, key).drop("pos"), k, fold, "key long, n_solid long, total long")
    return parts.groupBy(named()).agg(F.sum("n_solid").alias("n_solid"), F.sum("total").alias("total"))


def shared(reads: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(rep, n, m): canonical k-mers of ``other``, their places in ``reads``, 0 if none, and in ``other``."""

    def fold(s: Slots) -> Iterator[list]:
        theirs = totals(tally(s.canonical(r)[2]) for r in s.stretches(1))
        x, m = theirs
        if x is None:
            return
        n = np.zeros(len(x), np.int64)
        for r in s.stretches(0):
            y = s.canonical(r)[2]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            n += np.bincount(at[x[at] == y], minlength=len(x))
        yield [x.view(np.int64), n, m]

    both = super_kmers(reads, k).union(super_kmers(other, k, side=1)).drop("key", "pos")
    return by_slots(both, k, fold, "rep long, n long, m long")


def places(reads: DataFrame, other: DataFrame, k: int, key: str, most: int | None = None) -> DataFrame:
    """(rep, key, pos, fwd): places of reads whose k-mer ``other`` has; fwd: the k-mer stands there as the canonical one. With ``most`` only of k-mers that reads have so often at most."""

    def fold(s: Slots) -> Iterator[list]:
        x, _ = totals(tally(s.canonical(r)[2]) for r in s.stretches(1))
        if x is None:
            return
        if most is not None:
            n = np.zeros(len(x), np.int64)
            for r in s.stretches(0):
                y = s.canonical(r)[2]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                n += np.bincount(at[x[at] == y], minlength=len(x))
            x = x[n <= most]
            if not len(x):
                return
        for r in s.stretches(0):
            row, i, y, fwd = s.canonical(r)
            some = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            row, i = row[some], i[some]
            yield [y[some].view(np.int64), s.cols["key"][row], s.cols["pos"][row] + i.astype(np.int32), fwd[some]]

    both = super_kmers(reads, k, key).union(super_kmers(other, k, side=1))
    return by_slots(both, k, fold, "rep long, key long, pos int, fwd boolean").withColumn("key", named())


def colored(reads: DataFrame, tigs: DataFrame, k: int, key: str) -> DataFrame:
    """(unitig_id, key, n): how many places of a read have a k-mer of a unitig, where any. tigs: (unitig_id, seq), no k-mer in two of them."""

    def fold(s: Slots) -> Iterator[list]:
        x, there = _owned(s, lambda row, i, fwd: (s.cols["key"][row],))
        if x is None:
            return
        tig = there[0]
        for r in s.stretches(0):
            row, _, y, _ = s.canonical(r)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            some = x[at] == y
            own, key = tig[at[some]], s.cols["key"][row[some]]
            order = np.lexsort((own, key))
            own, key = own[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])) if len(own) else np.zeros(0, np.int64)
            yield [own[first], key[first], np.diff(np.append(first, len(own)))]

    both = super_kmers(reads, k, key).union(super_kmers(tigs, k, "unitig_id", side=1)).drop("pos")
    parts = by_slots(both, k, fold, "unitig_id long, key long, n long", True)
    return parts.groupBy("unitig_id", named()).agg(F.sum("n").alias("n"))


def located(wanted: DataFrame, tigs: DataFrame, k: int) -> DataFrame:
    """(kmer, unitig_id, dist, strand): where the k-mers (kmer, as text, each once) lie that unitigs have. tigs: (unitig_id, seq), no k-mer in two places."""

    def fold(s: Slots) -> Iterator[list]:
        x, there = _owned(s, lambda row, i, fwd: (s.cols["key"][row], s.cols["pos"][row] + i, fwd))
        if x is None:
            return
        for r in s.stretches(0):
            _, _, y, fwd = s.canonical(r)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            some = x[at] == y
            at, fwd = at[some], fwd[some]
            own = np.where(fwd, x[at], reverse_complement(x[at], k))
            yield [own.view(np.int64), there[0][at], there[1][at].astype(np.int32), there[2][at] == fwd]

    both = super_kmers(wanted, k, seq_col="kmer").union(super_kmers(tigs, k, "unitig_id", side=1))
    found = by_slots(both, k, fold, "kmer long, unitig_id long, dist int, strand boolean")
    return found.withColumn("kmer", letters(F.col("kmer"), k))


def _owned(s: Slots, of: Callable) -> tuple[np.ndarray | None, tuple]:
    """The k-mers of side 1 in order, each once, and what ``of(row, place, whether it stands as it is)`` says of them."""
    x, there = None, ()
    for r in s.stretches(1):
        row, i, y, fwd = s.canonical(r)
        new = of(row, i, fwd)
        if x is not None:
            y, new = np.concatenate([x, y]), tuple(np.concatenate(c) for c in zip(there, new, strict=True))
        x, at = np.unique(y, return_index=True)
        there = tuple(c[at] for c in new)
    return x, there


def rescued(reads: DataFrame, wanted: DataFrame, common: DataFrame, k: int, key: str, least: int = 31, often: int = 2) -> DataFrame:
    """(key, n): reads with ``least`` or more k-mers that ``wanted`` has and ``common`` hasn't ``often`` times. key: a whole number."""

    def fold(s: Slots) -> Iterator[list]:
        x, _ = totals(tally(s.canonical(r)[2]) for r in s.stretches(2))
        if x is None:
            return
        good = np.zeros(len(x), bool)
        for r in s.stretches(0):
            y = s.canonical(r)[2]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            good[at[x[at] == y]] = True
        y, n = totals(tally(s.canonical(r)[2]) for r in s.stretches(1))
        if y is not None:
            y = y[n >= often]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            good[at[x[at] == y]] = False
        for r in s.stretches(2):
            row, _, y, _ = s.canonical(r)
            yield list(tally(s.cols["key"][row[good[np.searchsorted(x, y)]]]))

    all_ = super_kmers(wanted, k).union(super_kmers(common, k, side=1)).union(super_kmers(reads, k, key, side=2)).drop("pos")
    return by_slots(all_, k, fold, "key long, n long").groupBy(named()).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _edits(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, k-mer): the distinct k-mers one substitution, insertion or deletion away from each, k letters of them, without itself."""
    full = (1 << 2 * k) - 1
    out = []
    for i in range(k):
        left, after = _U(full ^ ((1 << 2 * (k - i)) - 1)), 2 * (k - 1 - i)  # before letter i; bits after it
        right = _U((1 << after) - 1)
        for b in range(4):
            out.append((x & ~(_U(3) << _U(after))) | (_U(b) << _U(after)))
            out.append((x & left) | ((x & right) << _U(2)) | _U(b))
            if i < k - 1:  # one more letter after letter i, and the last one goes
                upto = _U(full ^ ((1 << after) - 1))
                out.append((x & upto) | (_U(b) << _U(after - 2)) | ((x & right) >> _U(2) & _U((1 << max(after - 2, 0)) - 1)))
    near = np.sort(np.stack(out, axis=1), axis=1)
    some = near != x[:, None]
    some[:, 1:] &= near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(some)
    return row, near[row, col]


def near_hits(weak: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(key, n): how many distinct k-mers one edit away from that of each row the reads have, where any.

    weak: (key, kmer), a whole number and text of plain bases. The neighbours, some 330 a k-mer, are made in tasks, dealt to slots
    like the reads, and counted there; a join would take them for as small as weak and broadcast them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = (2 * np.arange(k - 1, -1, -1)).astype(np.uint64)
        for b in batches:
            keys, own = b.column("key").to_numpy(), b.column("kmer").to_numpy().view(np.uint64)
            for a in range(0, len(own), 128):
                row, near = _edits(own[a : a + 128], k)
                flat = np.frombuffer(b"ACGT", np.uint8)[((near[:, None] >> shifts) & _U(3)).astype(np.int64)].ravel()
                none = np.zeros(len(near), np.int64)
                at, n, slot, hi, lo, _, _ = _super(flat, np.arange(0, len(flat) + 1, k), none, none, k, 0)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array((n + 1024).astype(np.int32)), pa.array(keys[a : a + 128][row])], ["slot", "hi", "lo", "n", "key"])

    def fold(s: Slots) -> Iterator[list]:
        x, _ = totals(tally(s.canonical(r)[2]) for r in s.stretches(1))
        if x is None:
            return
        there = np.zeros(len(x), bool)
        for r in s.stretches(0):
            y = s.canonical(r)[2]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            there[at[x[at] == y]] = True
        for r in s.stretches(1):
            row, _, y, _ = s.canonical(r)
            yield list(tally(s.cols["key"][row[there[np.searchsorted(x, y)]]]))

    near = weak.select("key", packed(F.col("kmer")).alias("kmer")).mapInArrow(run, "slot int, hi long, lo long, n int, key long")
    both = super_kmers(reads, k).drop("pos").unionByName(near)
    return by_slots(both, k, fold, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
