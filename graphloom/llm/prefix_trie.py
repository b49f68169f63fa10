"""Operator 12: the trie of conversation prefixes, with subtree sums by heavy paths.

A node is a distinct sequence of first turns. Of its children the one with the most conversations is heavy;
nodes joined by heavy links are a path. Sums over subtrees are suffix sums along the arrays of paths, and what the
top of a light path sums to is added to its parent. A light child has at most half of its parent's conversations,
so the rounds, one for each number of light links above a path, grow with the logarithm of the conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import stored
from graphloom.llm.workers import task

WORD = "[^\\x20\\x09-\\x0D]+"
MANY = 1000  # a node is crowded with over so many children and over one in so many of all nodes, so fewer than this are
BLOCK = 256  # turns or nodes that are worked on together
EMPTY_SHA = hashlib.sha256().hexdigest()


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, words): the turns of each conversation from 1, null turns first, equal ones by the SHA-256 of role and text.

    Rows are dealt to ranges in that order, so neither one conversation nor equal rows meet in one task.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words")).where("conv is not null")
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = stored(stored(rows.withColumn("tie", F.monotonically_increasing_id()), "turns").repartitionByRange(*by, F.col("tie")).sortWithinPartitions(*by).select("conv", "digest", "words", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "turns")
    stretch = placed.groupBy("conv", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(stretch.withColumn("before", before), ["conv", "range"]).select("conv", (F.col("before") + F.col("at") - F.col("first") + 1).alias("pos"), "digest", "words")


def running(rows: DataFrame, key: str, pos: str, of: dict[str, tuple]) -> DataFrame:
    """Adds columns that take up all rows of a key up to each row's place.

    of: name -> (aggregate, its column or expression, how two of its results go together). Places of a key are
    numbers from 0 or 1 on; they are worked on in blocks, and what comes before a block is added to it.
    """
    blocked = rows.withColumn("block", F.shiftright(F.col(pos), BLOCK.bit_length() - 1))
    within = Window.partitionBy(key, "block").orderBy(pos)
    out = blocked.select("*", *(agg(c).over(within).alias(name) for name, (agg, c, _) in of.items()))
    whole = blocked.groupBy(key, "block").agg(*(agg(c).alias(f"{name}_all") for name, (agg, c, _) in of.items()))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(key, "block", *(agg(F.col(f"{name}_all")).over(earlier).alias(f"{name}_before") for name, (agg, _, _) in of.items())).where("block > 0")
    out = out.join(before, [key, "block"], "left")
    return out.withColumns({name: join(F.col(name), F.col(f"{name}_before")) for name, (_, _, join) in of.items()}).drop("block", *(f"{name}_before" for name in of))


def rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, depth, n_turns, digest, words): each conversation with its first h turns taken from conversation conv - conv % group.

    h = crc32(decimal conv) % heads. A row of depth 0 stands before the first turn of each.
    """
    of = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own"))
    convs = of.withColumns({"h": F.crc32(F.col("conv").cast("string")) % heads, "base": F.col("conv") - F.col("conv") % group})
    convs = convs.join(of.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    taken = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    own = turns.join(convs.select("conv", "h", "taken", "n_turns"), "conv").where("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "n_turns", "digest", "words")
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "taken", "n_turns"), "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "n_turns", "digest", "words")
    top = convs.select("conv", F.lit(0).cast("long").alias("depth"), "n_turns", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.union(lent).union(top)


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(".", depth.cast("string"), F.hex(a), F.hex(b))


def walks(rows: DataFrame) -> DataFrame:
    """(conv, depth, words, last, node, parent): the node that each conversation has reached after each turn.

    A node's name is its depth and two 64-bit hashes: the exclusive or of hashes of all turns up to there with their depths.
    """
    own = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "digest")) for seed in (1, 2)]
    both = lambda a, b: F.when(b.isNull(), a).otherwise(a.bitwiseXOR(b))
    rows = rows.withColumns({"a": own[0], "b": own[1]})
    out = running(rows, "conv", "depth", {"x": (F.bit_xor, F.col("a"), both), "y": (F.bit_xor, F.col("b"), both)})
    parent = F.when(F.col("depth") > 0, _name(F.col("depth") - 1, F.col("x").bitwiseXOR(F.col("a")), F.col("y").bitwiseXOR(F.col("b"))))
    return out.select("conv", "depth", "words", (F.col("depth") == F.col("n_turns")).alias("last"), _name(F.col("depth"), F.col("x"), F.col("y")).alias("node"), parent.alias("parent"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): of the ids that end at a node, ascending and joined by commas. ends: (node, conv).

    Ids are joined to pieces of 256, these to pieces of 65536 numbers' width; one pass over a node's pieces in their order makes
    the hash, which can only be made in order.
    """
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.piece), ",").alias("piece")
    fine = ends.groupBy("node", F.shiftright("conv", 8).alias("at")).agg(joined(F.struct("conv", F.col("conv").cast("string").alias("piece"))))
    coarse = fine.groupBy("node", F.shiftright("at", 8).alias("part")).agg(joined(F.struct("at", "piece")))

    @task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            names, shas = [], []
            for n, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if n == node:
                    sha.update(b"," + piece.encode())
                    continue
                if node is not None:
                    names.append(node)
                    shas.append(sha.hexdigest())
                node, sha = n, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(shas, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return coarse.repartition("node").sortWithinPartitions("node", "part").select("node", "piece").mapInArrow(run, "node string, ends_sha256 string")


def heavy_paths(walk: DataFrame) -> DataFrame:
    """(node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, words, path, level): a row per node.

    path: the node at the top of its heavy path. level: light links from the root down to it. Of children with as many
    conversations the one of the least is heavy.
    """
    nodes = stored(walk.groupBy("node").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words")), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("back"), "node")).alias("heavy"))
    below = stored(nodes.join(kids.select(F.col("parent").alias("node"), "n_children", F.col("heavy.node").alias("heavy")), "node", "left"), "trie-children")
    above = below.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "heavy", "n_children")
    # children of one node may be a third of all: the few nodes with many reach them by a broadcast, MANY rows at most
    many = F.col("n_children") > max(MANY, nodes.count() // MANY)
    crowded, rest = F.broadcast(above.where(many).drop("n_children")), above.where(~many).drop("n_children")
    child = below.drop("heavy").na.fill(0, ["n_children"])
    tree = child.join(crowded, "parent").unionByName(child.join(crowded.select("parent"), "parent", "left_anti").join(rest, "parent", "left")).withColumn("top", F.coalesce(F.col("node") != F.col("heavy"), F.lit(True))).drop("heavy")
    # a node's least conversation passes all nodes above it, so its walk has the tops of paths
    least = nodes.select(F.col("conv_id").alias("conv")).distinct()
    rows = walk.select("conv", "node").join(least, "conv", "left_semi").join(tree, "node")
    top = F.when(F.col("top"), F.struct("depth", "node"))
    light = (F.col("top") & (F.col("depth") > 0)).cast("long")
    later = lambda a, b: F.greatest(a, b)
    added = lambda a, b: a + F.coalesce(b, F.lit(0))
    out = running(rows, "conv", "depth", {"last_top": (F.max, top, later), "level": (F.sum, light, added)}).where("conv = conv_id")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", F.col("last_top.node").alias("path"), "level")


def suffix_sums(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved): sums of each node and all below it on its path. nodes: (node, path, depth, n_leaves, saved).

    A path is cut in arrays of ``BLOCK`` nodes; what the later arrays sum to is added to an array's own suffix sums.
    """
    block = F.shiftright("depth", BLOCK.bit_length() - 1).alias("block")
    item = F.sort_array(F.collect_list(F.struct("depth", "node", "n_leaves", "saved"))).alias("items")
    arrays = nodes.groupBy("path", block).agg(item)
    later = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = nodes.groupBy("path", block).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rest = whole.select("path", "block", F.sum("leaves").over(later).alias("more_leaves"), F.sum("saved").over(later).alias("more_saved")).where("more_leaves is not null")
    rows = arrays.join(rest, ["path", "block"], "left").na.fill(0, ["more_leaves", "more_saved"]).select("items", "more_leaves", "more_saved")

    @task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            items = b.column("items")
            ends = np.cumsum(np.diff(items.offsets.to_numpy()))
            flat = items.flatten()
            of = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
            sums = []
            for name, more in (("n_leaves", "more_leaves"), ("saved", "more_saved")):
                up_to = np.append(0, np.cumsum(flat.field(name).to_numpy()))
                sums.append(up_to[ends[of]] - up_to[:-1] + b.column(more).to_numpy()[of])
            yield pa.RecordBatch.from_arrays([flat.field("node"), *map(pa.array, sums)], ["node", "n_leaves", "saved"])

    return rows.mapInArrow(run, "node string, n_leaves long, saved long")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per distinct prefix of rebuilt conversations.

    Null roles and texts are empty; null turns come first, equal ones by the SHA-256 of role and text, and repeated rows are turns of their own.
    Rows of a null conversation belong to none and go. No conversations give no nodes, not even the root. Other columns are not looked at.
    """
    walk = stored(walks(stored(rebuilt(numbered(turns, conv, turn, role, text), group, heads), "rebuilt")), "walks")
    paths = stored(heavy_paths(walk), "heavy-paths")
    levels = paths.agg(F.max("level")).first()[0]
    own = paths.select("node", "parent", "path", "depth", "level", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    done: list[DataFrame] = []
    for level in range(levels if levels is not None else -1, -1, -1):
        here = own.where(F.col("level") == level)
        if done:
            tops = done[-1].join(own.where((F.col("level") == level + 1) & (F.col("path") == F.col("node"))).select("node", "parent"), "node")
            more = tops.groupBy("parent").agg(F.sum("n_leaves").alias("light_leaves"), F.sum("saved").alias("light_saved"))
            here = here.join(more.withColumnRenamed("parent", "node"), "node", "left")
            here = here.withColumns({c: F.col(c) + F.coalesce(by, F.lit(0)) for c, by in (("n_leaves", "light_leaves"), ("saved", "light_saved"))})
        done.append(stored(suffix_sums(here), "path-sums"))
    sums = suffix_sums(own.limit(0)) if not done else reduce(DataFrame.union, done)
    ends = end_digests(walk.where("last").select("node", "conv"))
    out = paths.join(sums, "node").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
