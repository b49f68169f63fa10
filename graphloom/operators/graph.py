"""De Bruijn graph of solid k-mers: edges, branching, and compaction to unitigs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.align import EQUAL
from graphloom.functions.dna import revcomp
from graphloom.operators import junctions, kmers, packed
from graphloom.sources import store
from graphloom.storage import discard, stored


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that rounds don't pile up plans; what the write shuffled is deleted, as nothing else reads it."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(df, "graph")
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def dealt(rows: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """The rows by key, about ``most`` in a partition: for what grows manifold before it is grouped by the key again, in a task's memory."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)), key)


def oriented(solid: DataFrame) -> DataFrame:
    """(v): both strands of each solid k-mer (rep)."""
    return solid.select(F.explode(F.array("rep", revcomp(F.col("rep")))).alias("v")).distinct()


def edges(nodes: DataFrame, k: int) -> DataFrame:
    """(u, v): v follows u by k - 1 letters, on oriented k-mers. At most four each way."""
    left = nodes.select(F.col("v").alias("u"), F.substring("v", 2, k - 1).alias("overlap"))
    right = nodes.select("v", F.substring("v", 1, k - 1).alias("overlap"))
    return left.join(right, "overlap").select("u", "v")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(v, n_in, n_out, branching)."""
    ends = F.array(F.struct(F.col("v"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("u").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    each = links.select(F.explode(ends).alias("e")).select("e.*").union(nodes.select("v", F.lit(0), F.lit(0)))
    out = each.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return out.withColumn("branching", (F.col("n_in") > 1) | (F.col("n_out") > 1))


def unitigs(solid: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(unitig_id, seq, n_kmers) and the index (kmer, unitig_id, dist, strand) of maximal non-branching paths.

    Links with one way out and one way in are followed by pointer doubling: each round doubles the
    known stretch, so the rounds grow with the logarithm of the longest path. Links from a k-mer to
    itself or to its own reverse complement are not followed. Rings are cut at their least k-mer.
    Of the two strands of a path the smaller sequence is kept.
    """
    nodes = kept(oriented(solid))
    links = kept(edges(nodes, k))
    outs = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u")
    ins = links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    plain = links.join(outs, "u").join(ins, "v").where((F.col("u") != F.col("v")) & (F.col("v") != revcomp(F.col("u")))).select("u", "v")
    return _compacted(nodes, plain, k, revcomp, lambda v: v, lambda v: F.substring(v, k, 1))


def unitigs_of(reads: DataFrame, k: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """``unitigs`` of the k-mers of plain bases that reads (seq) have ``least`` times or more; up to 31 letters, odd, they are packed all the way.

    Links that are followed are junctions with one letter before and one after, so no links are made or counted.
    """
    if k > 31:
        return unitigs(kmers.solid(kmers.kmers(reads, k, [], strict=True), least), k)
    turned = lambda x: packed.rc(x, k)
    nodes = kept(packed.counts(reads, k, least).select(F.explode(F.array("rep", turned(F.col("rep")))).alias("v")))
    found = junctions.junctions(reads, k, least).where("bit_count(ins) = 1 and bit_count(outs) = 1")
    plain = kept(junctions.links(found, k).where((F.col("u") != F.col("v")) & (F.col("v") != turned(F.col("u")))))
    return _compacted(nodes, plain, k, turned, lambda v: packed.letters(v, k), lambda v: F.substring(F.lit("ACGT"), (v.bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)))


def unitigs_by_slots(reads: DataFrame, k: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """As ``unitigs_of``, with the links of a lot of slots followed where its junctions are, so that rounds go over what is left of paths, not over k-mers."""
    if k > 31:
        return unitigs_of(reads, k, least)
    found = kept(junctions.stretches(reads, k, least))
    tigs = kept(_glued(found, k))
    return tigs, store.index_of(tigs, k)


def _glued(found: DataFrame, k: int) -> DataFrame:
    """(unitig_id, seq, n_kmers) of ``junctions.stretches``: one that ends in a k-mer and the one that begins with it have that k-mer in common.

    Pointer doubling goes over stretches, not over k-mers; those that are led back to an open begin are not taken further.
    """
    opens = lambda c: F.col(c) >= junctions.OPENS
    name = lambda seq: F.xxhash64(seq).alias("unitig_id")
    part = found.where("not whole")
    state = kept(part.where("not shut").select(F.col("last").alias("v"), F.col("id").alias("head"), (F.col("n") - 1).alias("hops")))
    seen = None
    while True:
        active = state.where(~opens("head"))
        n = active.count()
        if n == 0 or n == seen:  # each round settles some of every path, so what is left then lies on rings
            break
        seen = n
        far = state.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("hops").alias("n2"))
        further = active.join(far, "head").select("v", F.col("h2").alias("head"), (F.col("hops") + F.col("n2")).alias("hops"))
        before, state = state, kept(state.where(opens("head")).union(further))
        discard(before)
    led = part.select("id", "last", "shut", "n", "seq").join(state.select(F.col("v").alias("id"), "head", "hops"), "id", "left")
    chain = led.where(opens("id") | opens("head")).withColumns({"head": F.coalesce("head", "id"), "hops": F.coalesce("hops", F.lit(0))})
    # a head of one k-mer has the hops of what follows it
    joined = chain.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("hops", (~opens("id")).alias("later"), "seq"))).alias("all"), F.max(F.when(F.col("shut"), F.col("last"))).alias("last"), F.max(F.col("hops") + F.col("n")).alias("n_kmers"))
    lesser = joined.where(F.col("head") - junctions.OPENS < packed.rc(F.col("last"), k))
    out = found.where("whole").select("seq", F.col("n").alias("n_kmers")).union(lesser.select(F.array_join("all.seq", ""), "n_kmers"))
    if n:
        out = out.union(_rings(part.join(active.select(F.col("v").alias("id")), "id", "left_semi")).groupBy("ring").applyInArrow(_ring(k), "seq string, n_kmers int"))
    return out.select(name("seq"), "seq", "n_kmers")


def _rings(part: DataFrame) -> DataFrame:
    """(ring, id, last, seq) of the stretches on rings, of both strands of a ring that of the lesser k-mer; ring: the least k-mer on it."""
    part = kept(part)
    state = kept(part.select("id", F.col("last").alias("to"), "low", "back"))
    seen = None
    while True:  # to: as many stretches on as low and back are the least of
        now = state.agg(F.sum(F.xxhash64("id", "low", "back").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            break
        seen = now
        far = state.select(F.col("id").alias("to"), F.col("to").alias("t2"), F.col("low").alias("l2"), F.col("back").alias("b2"))
        before, state = state, kept(state.join(far, "to").select("id", F.col("t2").alias("to"), F.least("low", "l2").alias("low"), F.least("back", "b2").alias("back")))
        discard(before)
    return part.drop("low", "back").join(state.where("low < back").select("id", F.col("low").alias("ring")), "id").select("ring", "id", "last", "seq")


def _ring(k: int) -> Callable:
    """(seq, n_kmers) of the stretches (ring, id, last, seq) of a ring, from its least k-mer on."""

    def run(t: pa.Table) -> pa.Table:
        own = {i: (z, s) for i, z, s in zip(*(t.column(c).to_pylist() for c in ("id", "last", "seq")), strict=True)}
        least = t.column("ring")[0].as_py()
        first = at = next(iter(own))
        pieces = []
        while True:
            at, piece = own[at]
            pieces.append(piece)
            if at == first:
                break
        text = "".join(pieces)
        n = len(text)
        wide = text * (2 + -(-2 * k // n))
        a = wide.index("".join("ACGT"[least >> 2 * i & 3] for i in range(k - 1, -1, -1)))
        return pa.table({"seq": [wide[a : a + n + k - 1]], "n_kmers": pa.array([n], pa.int32())})

    return run


def _compacted(nodes: DataFrame, plain: DataFrame, k: int, turned: Callable, text: Callable, last: Callable) -> tuple[DataFrame, DataFrame]:
    """``unitigs`` of nodes (v) and the links (u, v) to follow. turned, text, last: the reverse complement of a k-mer, it as text, its last letter."""
    # head: farthest known predecessor; hops: its distance; least: smallest k-mer on the stretch (for rings)
    state = nodes.join(plain.select("v", F.col("u").alias("head")), "v", "left")
    state = kept(state.select("v", F.coalesce("head", "v").alias("head"), F.col("head").isNotNull().cast("int").alias("hops"), F.least("v", F.coalesce("head", "v")).alias("least")))
    seen = None
    while True:
        far = state.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("hops").alias("n2"), F.col("least").alias("l2"))
        before, state = state, kept(state.join(far, "head").select("v", F.col("h2").alias("head"), (F.col("hops") + F.col("n2")).alias("hops"), F.least("least", "l2").alias("least")))
        discard(before)
        starts = nodes.join(plain.select("v"), "v", "left_anti").select(F.col("v").alias("head"))
        unsettled = state.join(starts, "head", "left_anti")
        # on rings heads go round for ever, but their least k-mers settle
        now = unsettled.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "least").cast("decimal(38,0)"))).first()
        n = now[0]
        if n == 0 or now == seen:
            break
        seen = now
    rings = None
    if n:  # what is left lies on rings: cut each at its least k-mer and walk again
        first = unsettled.select("v", F.col("least").alias("ring"))
        other = first.select(turned(F.col("v")).alias("v"), F.col("ring").alias("other"))
        first = kept(first.join(other, "v").where("ring <= other").select("v", "ring"))  # one strand of each ring
        cut = plain.join(first.where("v = ring").select("v"), "v", "left_anti")
        ring_nodes = kept(first.select("v"))
        rings = _walk(ring_nodes, cut.join(ring_nodes, "v", "left_semi"))
    chains = state.join(starts, "head", "left_semi").select("v", "head", "hops", F.lit(False).alias("ring"))
    chains = chains.union(rings.withColumn("ring", F.lit(True))) if rings is not None else chains
    letter = F.struct("hops", F.when(F.col("hops") == 0, text(F.col("v"))).otherwise(last(F.col("v"))).alias("piece"))
    paths = chains.groupBy("head", "ring").agg(F.array_join(F.transform(F.sort_array(F.collect_list(letter)), lambda x: x.piece), "").alias("seq"), F.count(F.lit(1)).cast("int").alias("n_kmers"))
    paths = paths.where(F.col("ring") | (F.col("seq") <= revcomp(F.col("seq"))))
    out = kept(paths.select(F.xxhash64("seq").alias("unitig_id"), "head", "seq", "n_kmers"))
    on_path = chains.join(out.select("head", "unitig_id"), "head").select("v", "unitig_id", F.col("hops").alias("dist"))
    index = on_path.select(F.col("v").alias("kmer"), "unitig_id", "dist", F.lit(True).alias("strand")).union(on_path.select(turned(F.col("v")), "unitig_id", "dist", F.lit(False)))
    # a path that is its own reverse complement has each k-mer twice
    index = index.groupBy("kmer").agg(F.min(F.struct("unitig_id", (~F.col("strand")).alias("back"), "dist")).alias("x")).select(text(F.col("kmer")).alias("kmer"), "x.unitig_id", "x.dist", (~F.col("x.back")).alias("strand"))
    return out.drop("head"), index


def _walk(nodes: DataFrame, plain: DataFrame) -> DataFrame:
    state = nodes.join(plain.select("v", F.col("u").alias("head")), "v", "left")
    state = kept(state.select("v", F.coalesce("head", "v").alias("head"), F.col("head").isNotNull().cast("int").alias("hops")))
    seen = None
    while True:
        far = state.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("hops").alias("n2"))
        before, state = state, kept(state.join(far, "head").select("v", F.col("h2").alias("head"), (F.col("hops") + F.col("n2")).alias("hops")))
        discard(before)
        total = state.agg(F.sum("hops")).first()[0]
        if total == seen:
            return state
        seen = total


def unitig_edges(tigs: DataFrame, k: int) -> DataFrame:
    """(src, src_fwd, dst, dst_fwd, base): unitigs that follow one another on either strand."""
    sides = tigs.select("unitig_id", "seq", F.lit(True).alias("fwd")).union(tigs.select("unitig_id", revcomp(F.col("seq")), F.lit(False)))
    left = sides.select(F.col("unitig_id").alias("src"), F.col("fwd").alias("src_fwd"), F.expr(f"right(seq, {k - 1})").alias("overlap"))
    right = sides.select(F.col("unitig_id").alias("dst"), F.col("fwd").alias("dst_fwd"), F.substring("seq", 1, k - 1).alias("overlap"), F.substring("seq", k, 1).alias("base"))
    return left.join(right, "overlap").drop("overlap")


def bubble_coverage(links: DataFrame, coverage: DataFrame) -> DataFrame:
    """(coverage): of vertices with several successors, none of which branches, that all lead on to one vertex at most.

    links: (u, v). coverage: (v, cov, len, branching). The successors' coverage over their length,
    in whole numbers; 0 if there are none.
    """
    several = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    first = links.join(several, "u").join(coverage, "v")
    onward = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
    per = first.join(onward, "v", "left").groupBy("u").agg(F.max(F.col("branching").cast("int")).alias("b"), F.countDistinct("w").alias("ends"))
    good = first.join(per.where("b = 0 and ends = 1").select("u"), "u").select("v", "cov", "len").distinct()
    return good.agg(F.when(F.sum("len") > 0, F.expr("sum(cov) div sum(len)")).otherwise(0).alias("coverage"))


def snp_candidates(nodes: DataFrame, k: int) -> DataFrame:
    """(v, pos, bases): k-mers that stand with others which differ at one place, and the bases there as bits.

    Two such k-mers have their first or their second half in common: each is dealt twice, by its halves, and letters are left out
    of the other half where it lies, so the k masks of a k-mer are never shuffled.
    """
    h = k // 2
    half = F.array(F.struct(F.lit(True).alias("first"), F.substring("v", 1, h).alias("half")), F.struct(F.lit(False).alias("first"), F.substring("v", h + 1, k).alias("half")))
    dealt = nodes.select("v", F.explode(half).alias("x")).select("v", "x.first", "x.half").repartition("half")
    place = F.explode(F.when(F.col("first"), F.sequence(F.lit(h + 1), F.lit(k))).otherwise(F.sequence(F.lit(1), F.lit(h))))
    masked = dealt.select("v", "first", "half", place.alias("pos"))
    rest = F.concat(F.substring("v", F.lit(1), F.col("pos") - 1), F.substring("v", F.col("pos") + 1, F.lit(k)))
    alike = Window.partitionBy("half", "first", "pos", "rest")
    bit = F.expr("shiftleft(1, instr('ACGT', substring(v, pos, 1)) - 1)")
    found = masked.withColumn("rest", rest).select("v", "pos", F.bit_or(bit).over(alike).alias("bases"), F.count(F.lit(1)).over(alike).alias("n"))
    return found.where("n > 1").select("v", (F.col("pos") - 1).alias("pos"), "bases")


def mapped_ambiguity(snps: DataFrame, mappings: DataFrame, vertex: str) -> DataFrame:
    """(mapping columns, pos, bases): ambiguous places of a vertex that fall in a mapping of it, counted along the mapping.

    snps: (vertex, pos, bases) with bases as bits A=1, C=2, G=4, T=8. mappings: (…, vertex, start, stop, strand);
    on the other strand places run from the end and bases are complemented.
    """
    inside = mappings.join(snps, vertex).where("pos >= start and pos < stop")
    b = F.col("bases")
    mirrored = sum((F.shiftright(b.bitwiseAND(F.lit(1 << i)), i) * (1 << (3 - i)) for i in range(4)), F.lit(0))
    place = F.when(F.col("strand"), F.col("pos") - F.col("start")).otherwise(F.col("stop") - 1 - F.col("pos"))
    return inside.withColumn("bases", F.when(F.col("strand"), b).otherwise(mirrored)).withColumn("pos", place)


def path_ambiguity(steps: DataFrame, snps: DataFrame, path: str, vertex: str, length: str, inner: int = 0) -> DataFrame:
    """(path, pos, bases): ambiguous places along paths, sets of bases united where vertices overlap.

    steps: (path, vertex, offset). Places within ``inner`` of either end of a path of ``length`` go. Steps are dealt by path before they
    meet the places of their vertices; where these are broadcast, nothing but steps is shuffled.
    """
    each = dealt(steps, path).join(snps, vertex).select(path, (F.col("offset") + F.col("pos")).alias("pos"), "bases", length)
    kept = each.where((F.col("pos") >= inner) & (F.col("pos") < F.col(length) - inner))
    return kept.groupBy(path, "pos").agg(F.bit_or("bases").alias("bases"))


def short_cycles(links: DataFrame, longest: int) -> DataFrame:
    """(start, path): simple cycles of up to ``longest`` links, each from each of its vertices. links: supported (u, v)."""
    walk = links.select(F.col("u").alias("start"), F.col("v").alias("last"), F.array("v").alias("path"))
    found = walk.where("start = last").select("start", "path")
    for _ in range(longest - 1):
        step = walk.where("start != last").join(links.select(F.col("u").alias("last"), F.col("v").alias("next")), "last")
        walk = step.where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
        found = found.union(walk.where("start = last").select("start", "path"))
    return found


def ranked_hits(found: DataFrame, read: str) -> DataFrame:
    """Hits of a read by place, equal ones once."""
    return found.dropDuplicates([read, "pos", "unitig_id", "dist", "strand"]).withColumn("ord", F.row_number().over(Window.partitionBy(read).orderBy("pos", "unitig_id", "dist")))


def valid_candidates(candidates: DataFrame, links: DataFrame, readings: DataFrame, pairs: DataFrame, least: int = 2, most: int = 1 << 16) -> DataFrame:
    """The rows (a, b) of candidates from whose a b's reads are reached both ways.

    From both readings of a one goes along links (u, v) to unitigs that share ``least`` colours with a; one of those reached is to share as many with b.
    a itself doesn't count. A walk that has met ``most`` readings stands for having reached everything. readings: (v, unitig_id, fwd); pairs: (unitig_id, color).
    All candidates are walked at once, a link a round; colours are compared by joins, once for each pair of unitigs that share any.
    """
    wanted = candidates.select(F.col("a").alias("x")).union(candidates.select("b")).distinct()
    mine = pairs.join(wanted, F.col("unitig_id") == F.col("x"), "left_semi").withColumnRenamed("unitig_id", "x")
    near = kept(mine.join(pairs, "color").groupBy("x", "unitig_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("x", "unitig_id"))
    of_a = near.withColumnRenamed("x", "a")
    start = candidates.select("a").distinct().join(readings.withColumnRenamed("unitig_id", "a"), "a").select("a", "fwd", "v")
    seen = front = kept(start)
    met = None
    while not front.isEmpty():
        ahead = front.withColumnRenamed("v", "u").join(links, "u").select("a", "fwd", "v").distinct().join(readings.select("v", "unitig_id"), "v")
        fresh = kept(ahead.join(of_a, ["a", "unitig_id"], "left_semi").join(seen, ["a", "fwd", "v"], "left_anti").select("a", "fwd", "v", "unitig_id"))
        met = fresh if met is None else met.union(fresh)
        seen = seen.union(fresh.drop("unitig_id"))
        full = seen.groupBy("a", "fwd").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        front = kept(fresh.select("a", "fwd", "v").join(full, ["a", "fwd"], "left_anti"))
    if met is None:
        return candidates.limit(0)
    everything = seen.groupBy("a", "fwd").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).join(candidates, "a").select("a", "b", "fwd")
    some = met.select("a", "fwd", "unitig_id").distinct().join(candidates, "a").join(near.withColumnRenamed("x", "b"), ["b", "unitig_id"]).select("a", "b", "fwd")
    both = some.union(everything).groupBy("a", "b").agg(F.countDistinct("fwd").alias("n")).where("n = 2")
    return candidates.join(both.select("a", "b"), ["a", "b"], "left_semi")


def settled_bases(reads: DataFrame, nodes: DataFrame, k: int, key: str, most: int = 64) -> DataFrame:
    """(key, pos, base): ambiguous letters that only one base of theirs gives a k-mer of the graph, whatever the other ambiguous letters around stand for.

    reads: (key, seq); nodes: (kmer) on both strands. A letter with ``most`` or more readings of the k - 1 letters on both its sides is left alone.
    """
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    at = reads.where(F.length("seq") >= k).select(key, "seq", F.posexplode(letters).alias("pos", "own")).where(~F.col("own").isin(*"ACGT"))
    window = at.withColumn("low", F.greatest(F.col("pos") - k + 1, F.lit(0))).withColumn("text", F.expr(f"substring(seq, low + 1, pos + {k} - low)"))
    codes = F.create_map(*(F.lit(x) for pair in [(c, b) for c, b in EQUAL.items()] for x in pair))
    size = F.aggregate(F.filter(F.split("text", ""), lambda c: ~c.isin("", *"ACGT")), F.lit(1), lambda n, c: F.least(F.lit(most), n * F.coalesce(F.length(F.element_at(codes, c)), F.lit(most))))
    few = window.where(size < most).select(key, "pos", (F.col("pos") - F.col("low")).alias("i"), "text")
    choice = lambda c: F.coalesce(F.filter(F.split(F.element_at(codes, c), ""), lambda x: x != ""), F.array(c))
    grown = F.aggregate(F.filter(F.split("text", ""), lambda c: c != ""), F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(choice(c), lambda x: F.concat(a, x)))))
    each = few.select(key, "pos", "i", F.explode(grown).alias("text"))
    kmer = each.select(key, "pos", F.expr("substring(text, i + 1, 1)").alias("base"), F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - k + 1), lambda s: F.substring(F.col("text"), s, k))).alias("kmer"))
    found = kmer.join(nodes.select("kmer"), "kmer", "left_semi").select(key, "pos", "base").distinct()
    return found.groupBy(key, "pos").agg(F.count(F.lit(1)).alias("n"), F.min("base").alias("base")).where("n = 1").select(key, "pos", "base")


def settled(reads: DataFrame, nodes: DataFrame, k: int, key: str, most: int = 64) -> DataFrame:
    """reads (key, seq, …) with ambiguous letters replaced by what ``settled_bases`` finds, again and again until none is found."""
    now = reads
    while True:
        fixed = kept(settled_bases(now.select(key, "seq"), nodes, k, key, most))
        if fixed.isEmpty():
            return now
        of = fixed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("__fixed"))
        letters = F.filter(F.split("seq", ""), lambda c: c != "")
        seq = F.array_join(F.transform(letters, lambda c, i: F.coalesce(F.element_at("__fixed", i), c)), "")
        now = kept(now.join(of, key, "left").withColumn("seq", F.when(F.col("__fixed").isNull(), F.col("seq")).otherwise(seq)).drop("__fixed"))
