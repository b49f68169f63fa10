"""The graph of packed k-mers by its junctions: what the letters before and after each (k-1)-mer are.

Every link of the graph runs through the k - 1 letters that its ends share, so a junction with the letters found before and after it
has all its links, and how often each k-mer there is found. Junctions come slot by slot from super-k-mers of k - 1 letters
(operators/packed.py); a junction and its reverse complement are one, so links are only made double where they are listed. k is odd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.packed import NO_KEY, SLICE, Slots, _kmers, by_slots, rc, reverse_complement, super_kmers, tally, totals
from graphloom.storage import stored

_U = np.uint64


def _odd(k: int) -> None:
    if k % 2 == 0:
        raise ValueError("k must be odd, so that no k-mer is its own reverse complement")


def _sides(s: Slots, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, junction * 8 + code): a letter found before (code 0 to 3) or after (4 to 7) a canonical junction."""
    k, n, flags = s.k, s.n[rows], s.flags[rows]
    hi, lo = s.cols["hi"].view(np.uint64)[rows], s.cols["lo"].view(np.uint64)[rows]
    of, i, wide = _kmers(hi, lo, n, k + 1)  # the letter before and the junction
    x = wide & _U((1 << 2 * k) - 1)
    before = wide >> _U(2 * k)
    after = _kmers(hi, lo, n, 1, k + 1)[2]
    has_before, has_after = (i > 0) | (flags[of] & 128 == 0), (i < n[of] - 1) | (flags[of] & 256 == 0)
    y = reverse_complement(x, k)
    out = []
    for turned in (False, True):
        here = y <= x if turned else x <= y  # one that is its own reverse complement is read both ways
        z = (y if turned else x) << _U(3)
        for letter, has, code in ((before, has_before, 4 * turned), (after, has_after, 4 - 4 * turned)):
            some = here & has
            out.append((rows[of[some]], z[some] | ((_U(3) - letter[some] if turned else letter[some]) + _U(code))))
    return np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])


def _whole(s: Slots, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sides found ``least`` times or more, in order, and how often each is."""
    x, n = totals(tally(_sides(s, r)[1]) for r in s.stretches())
    some = n >= least
    return x[some], n[some]


def _pieces(reads: DataFrame, k: int, key: str | None = None) -> DataFrame:
    _odd(k)
    return super_kmers(reads, k - 1, key, flank=1)


def junctions(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(x, ins, outs, n): junctions of k-mers found ``least`` times or more; ins and outs: the letters before and after as bits A=1, C=2,
    G=4, T=8; n: how often the k-mers with these are found, four before and four after (0: fewer than ``least``)."""

    def fold(s: Slots) -> Iterator[list]:
        x, n = _whole(s, least)
        own, code = x >> _U(3), (x & _U(7)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(own))))
        all_n = np.zeros((len(at), 8), np.int64)
        all_n[of, code] = n
        bits = (all_n > 0) @ np.array([1, 2, 4, 8, 16, 32, 64, 128])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(at) + 1, 8), pa.int32()), pa.array(all_n.ravel()))
        yield [own[at].view(np.int64), (bits & 15).astype(np.int32), (bits >> 4).astype(np.int32), lists]

    return by_slots(_pieces(reads, k).drop("key", "pos"), k - 1, fold, "x long, ins int, outs int, n array<long>")


def _letters(bits: str) -> Column:
    return F.filter(F.array(*(F.lit(i).cast("long") for i in range(4))), lambda i: F.expr(bits).bitwiseAND(F.call_function("shiftleft", F.lit(1), i.cast("int"))) != 0)


def _both(links: DataFrame, k: int) -> DataFrame:
    """Links (x, a, b, …) of letters before and after a junction, as (u, v, …) on both strands."""
    more = [c for c in links.columns if c not in "xab"]
    one = links.select(*more, "x", (F.shiftleft("a", 2 * (k - 1)).bitwiseOR(F.col("x"))).alias("u"), (F.shiftleft("x", 2).bitwiseOR(F.col("b"))).alias("v"))
    other = one.where(rc(F.col("x"), k - 1) != F.col("x")).select(*more, rc(F.col("v"), k).alias("u"), rc(F.col("u"), k).alias("v"))
    return one.drop("x").union(other).select("u", "v", *more)


def links(found: DataFrame, k: int) -> DataFrame:
    """(u, v): the links of junctions; v follows u."""
    each = found.where("ins > 0 and outs > 0").select("x", F.explode(_letters("ins")).alias("a"), "outs").select("x", "a", F.explode(_letters("outs")).alias("b"))
    return _both(each, k)


def degrees(found: DataFrame, k: int) -> DataFrame:
    """(rep, n_in, n_out): the links into and out of each canonical k-mer; its reverse complement has them the other way round."""
    left = F.struct(F.transform(_letters("ins"), lambda a: F.call_function("shiftleft", a, F.lit(2 * (k - 1))).bitwiseOR(F.col("x"))).alias("v"), F.bit_count("outs").alias("n"), F.lit(True).alias("out"))
    right = F.struct(F.transform(_letters("outs"), lambda b: F.shiftleft("x", 2).bitwiseOR(b)).alias("v"), F.bit_count("ins").alias("n"), F.lit(False).alias("out"))
    each = found.select(F.explode(F.array(left, right)).alias("e")).select(F.explode("e.v").alias("v"), "e.n", "e.out")
    back = rc(F.col("v"), k)
    own = each.select(F.least("v", back).alias("rep"), "n", (F.col("out") == (F.col("v") <= back)).alias("out"))
    return own.groupBy("rep").agg(F.max(F.when(~F.col("out"), F.col("n"))).alias("n_in"), F.max(F.when(F.col("out"), F.col("n"))).alias("n_out"))


def supported_links(reads: DataFrame, k: int, key: str, least: int = 2) -> DataFrame:
    """(u, v, shared, both): links of k-mers found ``least`` times or more, and the reads that have both ends; both: u and v as text, one after the other.
    key: a whole number.

    A read with both ends has the letter before and the letter after the junction, somewhere and on either strand, so the slot knows.
    """

    def fold(s: Slots) -> Iterator[list]:
        parts = list(s.stretches(by_key=True))
        once = [_sides(s, parts[0])] if len(parts) == 1 else []  # mostly a lot is one stretch, which is read once
        x, n = tally(once[0][1]) if once else totals(tally(_sides(s, r)[1]) for r in parts)
        solid = x[n >= least]
        own, code = solid >> _U(3), (solid & _U(7)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(1 << code, at) if len(at) else at
        open_ = (bits & 15 > 0) & (bits >> 4 > 0)
        x, bits = own[at][open_], bits[open_]
        shared = np.zeros((len(x), 16), np.int64)
        for row, side in once or (_sides(s, r) for r in parts):
            if not len(x):
                break
            y = side >> _U(3)
            place = np.minimum(np.searchsorted(x, y), len(x) - 1)
            some = (x[place] == y) & (s.cols["key"][row] != NO_KEY) & (bits[place] >> (side & _U(7)).astype(np.int64) & 1 > 0)
            place, key, code = place[some], s.cols["key"][row[some]], (side[some] & _U(7)).astype(np.int64)
            order = np.lexsort((key, place))
            place, key, code = place[order], key[order], code[order]
            if not len(place):
                continue
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (key[1:] != key[:-1])]))
            has, of = np.bitwise_or.reduceat(1 << code, first), place[first]
            for a in range(4):
                for b in range(4):
                    shared[:, 4 * a + b] += np.bincount(of[(has >> a & 1 > 0) & (has >> (4 + b) & 1 > 0)], minlength=len(x))
        a, b = np.arange(16) >> 2, np.arange(16) & 3
        there = (bits[:, None] >> a & 1 > 0) & (bits[:, None] >> (4 + b) & 1 > 0)
        i, j = np.nonzero(there)
        for z in range(0, len(i), SLICE):
            yield _two(x[i[z : z + SLICE]], a[j[z : z + SLICE]].astype(np.uint64), b[j[z : z + SLICE]].astype(np.uint64), shared[i[z : z + SLICE], j[z : z + SLICE]], k)

    return by_slots(_pieces(reads, k, key).drop("pos"), k - 1, fold, "u long, v long, shared long, both string", True)


def _two(x: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, k: int) -> list:
    """The columns of ``supported_links`` for links of the letters a and b before and after the junctions x, on both strands."""
    u, v = (a << _U(2 * (k - 1))) | x, (x << _U(2)) | b
    other = reverse_complement(x, k - 1) != x
    u, v = np.concatenate([u, reverse_complement(v[other], k)]), np.concatenate([v, reverse_complement(u[other], k)])
    by = (2 * np.arange(k - 1, -1, -1)).astype(np.uint64)
    text = np.empty((len(u), 2 * k), np.uint8)
    for at, y in ((0, u), (k, v)):
        for i in range(k):
            text[:, at + i] = _ACGT[(y >> by[i] & _U(3)).astype(np.int64)]
    both = pa.StringArray.from_buffers(len(u), pa.py_buffer(np.arange(0, 2 * k * len(u) + 1, 2 * k, dtype=np.int32)), pa.py_buffer(text))
    return [u.view(np.int64), v.view(np.int64), np.concatenate([shared, shared[other]]), both]


_ACGT = np.frombuffer(b"ACGT", np.uint8)


def stretches(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(id, last, shut, whole, n, low, back, seq): paths of k-mers found ``least`` times or more as far as a slot follows them.

    A slot has all about its junctions, so links with one way in and one way out, not from a k-mer to itself or its reverse complement, are
    followed there, on both strands. A k-mer whose two junctions lie in two slots ends a path in one and begins one in the other. id: the first
    k-mer; with OPENS added if nothing leads to it, and seq begins with it, else seq has what follows it. last: the last k-mer; shut: nothing
    follows it. low, back: the least k-mer, and the least on the other strand. whole: a unitig, with the lesser seq of its
    strands, or a ring, cut at its least k-mer.
    """

    def fold(s: Slots) -> Iterator[list]:
        x, _ = _whole(s, least)
        if len(x):
            yield _paths(x, k)

    return by_slots(_pieces(reads, k).drop("key", "pos"), k - 1, fold, "id long, last long, shut boolean, whole boolean, n int, low long, back long, seq string")


OPENS = 1 << 62


def _paths(sides: np.ndarray, k: int) -> list:
    """The columns of ``stretches`` of a slot's solid sides, in order."""
    own, code = sides >> _U(3), sides & _U(7)
    before = code < _U(4)
    w = np.where(before, (code << _U(2 * (k - 1))) | own, (own << _U(2)) | (code & _U(3)))
    turned = reverse_complement(w, k)
    ends, begins = np.where(before, w, turned), np.where(before, turned, w)  # k-mers with their right, their left junction here
    v = np.unique(np.concatenate([ends, begins]))
    at = lambda y: np.searchsorted(v, y)
    has_left, has_right = np.zeros(len(v), bool), np.zeros(len(v), bool)
    has_left[at(begins)] = has_right[at(ends)] = True
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    first = first[np.diff(np.append(first, len(own))) == 2]
    first = first[before[first] & ~before[first + 1]]
    a, b = w[first], w[first + 1]
    plain = (a != b) & (b != turned[first])
    a, b = a[plain], b[plain]
    prior = np.full(len(v), -1)
    prior[np.concatenate([at(b), at(reverse_complement(a, k))])] = np.concatenate([at(a), at(reverse_complement(b, k))])
    head, hops, _ = _led(prior)
    cut = np.zeros(len(v), bool)
    if (prior[head] >= 0).any():  # rings: each is cut at its least k-mer
        on = np.flatnonzero(prior[head] >= 0)
        cut[on[_led(prior)[2][on] == on]] = True
        prior[cut] = -1
        head, hops, _ = _led(prior)
    order = np.lexsort((hops, head))
    start = np.flatnonzero(np.concatenate([[True], head[order][1:] != head[order][:-1]]))
    n = np.diff(np.append(start, len(order)))
    f, z = order[start], order[start + n - 1]
    low, back = v[np.minimum.reduceat(order, start)], np.minimum.reduceat(reverse_complement(v[order], k), start)
    ring, opens, shut = cut[f], has_left[f], has_right[z]
    opens, shut = opens | ring, shut | ring
    whole = opens & shut
    some = ~whole | np.where(ring, low < back, v[f] < reverse_complement(v[z], k))  # of both strands of a unitig the lesser
    # letters: of each k-mer the last one, of a first one all or none
    width = np.ones(len(order), np.int64)
    width[start] = np.where(opens, k, 0)
    width[~np.repeat(some, n)] = 0
    of = np.repeat(np.arange(len(order)), width)
    place = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
    text = np.frombuffer(b"ACGT", np.uint8)[(v[order][of] >> ((width[of] - 1 - place) * 2).astype(np.uint64) & _U(3)).astype(np.int64)]
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(width, start)[some])])
    seq = pa.LargeStringArray.from_buffers(int(some.sum()), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())
    signed = lambda y: y[some].view(np.int64)
    return [signed(v[f] | np.where(opens, _U(OPENS), _U(0))), signed(v[z]), shut[some], whole[some], n[some].astype(np.int32), signed(low), signed(back), seq]


def _led(prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, hops, least): where each place comes from by ``prior`` (-1: nowhere), by doubling, and the least place on the way; on a ring, of all of it."""
    head = np.where(prior >= 0, prior, np.arange(len(prior)))
    hops, least = (prior >= 0).astype(np.int64), np.minimum(head, np.arange(len(prior)))
    for _ in range(len(prior).bit_length()):
        if (prior[head] < 0).all():
            break
        hops, least, head = hops + hops[head], np.minimum(least, least[head]), head[head]
    return head, hops, least


def bubble_coverage(found: DataFrame, k: int) -> DataFrame:
    """(coverage): of vertices with several successors, none of which branches, that all lead on to one vertex at most.

    found: ``junctions``. The successors' mean coverage, in whole numbers; 0 if there are none. A successor that doesn't branch has one way
    in, so the junction has one letter on that side and several on the other; the one way out of each is looked up at its own next junction.
    """
    found = stored(found, "junctions")
    ahead = found.where("bit_count(ins) = 1 and bit_count(outs) > 1").select("x", F.lit(True).alias("fwd"), F.explode(_letters("outs")).alias("b"), "n")
    ahead = ahead.select("x", "fwd", F.shiftleft("x", 2).bitwiseOR(F.col("b")).alias("v"), F.element_at("n", (F.col("b") + 5).cast("int")).alias("cov"))
    back = found.where("bit_count(outs) = 1 and bit_count(ins) > 1").select("x", F.lit(False).alias("fwd"), F.explode(_letters("ins")).alias("a"), "n")
    back = back.select("x", "fwd", rc(F.shiftleft("a", 2 * (k - 1)).bitwiseOR(F.col("x")), k).alias("v"), F.element_at("n", (F.col("a") + 1).cast("int")).alias("cov"))
    y = F.col("v").bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))
    first = ahead.union(back).withColumn("y", y).withColumn("z", F.least("y", rc(F.col("y"), k - 1)))
    mirrored = sum((F.shiftright(F.col("ins").bitwiseAND(F.lit(1 << i)), i) * (1 << (3 - i)) for i in range(4)), F.lit(0))
    out = F.when(F.col("y") == F.col("z"), F.col("outs")).otherwise(mirrored)
    led = first.join(found.select(F.col("x").alias("z"), "ins", "outs"), "z").withColumn("out", out)
    # one letter out or none: its vertex is v's last k - 1 letters and that letter
    w = F.when(F.col("out") > 0, F.shiftleft("y", 2).bitwiseOR(F.log2(F.col("out")).cast("long")))
    per = led.withColumn("w", w).groupBy("x", "fwd").agg(F.max(F.bit_count("out")).alias("most"), F.min("w").alias("low"), F.max("w").alias("high"), F.sum("cov").alias("cov"), F.count(F.lit(1)).alias("len"))
    good = per.where("most <= 1 and low is not null and low = high")
    return good.agg(F.when(F.sum("len") > 0, F.expr("sum(cov) div sum(len)")).otherwise(0).alias("coverage"))


def snp_candidates(solid: DataFrame, k: int) -> DataFrame:
    """(v, pos, bases): k-mers on both strands that stand with others which differ at one place, and the bases there as bits.

    solid: (rep), packed. Two such k-mers have their first or their second half in common; in the second case their reverse complements
    have the first, so each strand is dealt once, by its first half, and the k masks of a k-mer stay in a task.
    """
    _odd(k)
    h = k // 2
    masks = [(p, _U(3) << _U(2 * (k - 1 - p))) for p in range(h, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for p, mask in masks:
                rest = v & ~mask
                order = np.argsort(rest, kind="stable")
                rest, own = rest[order], v[order]
                at = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
                n = np.diff(np.append(at, len(rest)))
                bit = np.int64(1) << ((own & mask) >> _U(2 * (k - 1 - p))).astype(np.int64)
                bases, n = np.repeat(np.bitwise_or.reduceat(bit, at), n), np.repeat(n, n)
                own, bases = own[n > 1], bases[n > 1]
                place = np.full(len(own), p, np.int32)
                if p > k - 1 - h:  # what the other strand has in its first half
                    mirrored = sum((bases >> i & 1) << (3 - i) for i in range(4))
                    own, bases, place = np.concatenate([own, reverse_complement(own, k)]), np.concatenate([bases, mirrored]), np.concatenate([place, k - 1 - place])
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(place), pa.array(bases.astype(np.int32))], ["v", "pos", "bases"])

        held = np.zeros(0, np.uint64)
        for b in batches:
            held = np.concatenate([held, b.column("v").to_numpy().view(np.uint64)])
            if len(held) < SLICE:
                continue
            half = held >> _U(2 * (k - h))
            change = np.flatnonzero(half[1:] != half[:-1]) + 1
            if len(change):
                yield from done(held[: change[-1]])
                held = held[change[-1] :]
        if len(held):
            yield from done(held)

    nodes = solid.select(F.explode(F.array("rep", rc(F.col("rep"), k))).alias("v"))
    dealt = nodes.withColumn("half", F.shiftrightunsigned("v", 2 * (k - h))).repartition("half").sortWithinPartitions("v")
    return dealt.select("v").mapInArrow(run, "v long, pos int, bases int")
