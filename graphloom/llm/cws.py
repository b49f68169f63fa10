"""Operator 10: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is its words with their counts as weights S. For each of ``SAMPLES`` samples every term
has r and c from Gamma(2, 1) and b from (0, 1), drawn from hashes of the term and the sample's
number; t = floor(ln S / r + b), and the term of least c / exp(r (t - b + 1)) is sampled with
its t. Two texts sample the same (term, t) with the probability of their generalised Jaccard
similarity, sum of least weights over sum of greatest.

That value depends on the term and t alone, so texts whose least ones are equal have sampled the
same (term, t); 32 bits of a hash of it stand for the sample.
Counting and sampling are hash aggregations, and as texts are dealt by their key once, neither
shuffles words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import stored

SAMPLES = 32
GROUP = 4
WORD_BREAKS = r"[ \t-\r]+"
_LOW = (1 << 32) - 1


def _half(h: Column, shift: int, bits: int) -> Column:
    """Some bits of a hash as a number in (0, 2^bits)."""
    x = F.shiftrightunsigned(h, shift) if shift else h
    return (x.bitwiseAND(F.lit((1 << bits) - 1)) if shift + bits < 64 else x).cast("double") + 0.5


def _sample(term: Column, log_weight: Column, number: Column) -> Column:
    """a of a term with this weight: the term of the least one is sampled."""
    first = F.xxhash64(term, number)
    second = F.xxhash64(first)
    r = F.lit(42 * math.log(2)) - F.log(_half(first, 0, 21) * _half(first, 21, 21))
    b = _half(first, 42, 22) * F.lit(2.0**-22)
    c = F.lit(64 * math.log(2)) - F.log(_half(second, 0, 32) * _half(second, 32, 32))
    return c * F.exp(r * (b - 1.0 - F.floor(log_weight / r + b)))


def signatures(texts: DataFrame, key: list[str], text_cols: tuple[str, ...] = ("text",), samples: int = SAMPLES) -> DataFrame:
    """(key, signature_0, signature_1, ...): for each text column an array of ``samples`` longs per key.

    Rows of a key count as one text; null texts as empty. Words are runs without ASCII white
    space; the empty text has one term, the empty word. A term that texts of a key hold equally
    often is drawn once for all of them, so two alike cost little more than one.
    """
    kinds = range(len(text_cols))
    text = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(text_cols))))
    words = texts.select(*key, text.alias("t")).select(*key, "t.kind", F.explode(F.split(F.trim(F.regexp_replace("t.text", WORD_BREAKS, " ")), " ")).alias("word"))
    counts = words.groupBy(*key, F.xxhash64("word").alias("term")).agg(*(F.count(F.when(F.col("kind") == i, 1)).alias(f"n{i}") for i in kinds))
    n = [F.col(f"n{i}") for i in kinds]
    first = [reduce(Column.__and__, [n[i] != n[j] for j in range(i)], n[i] > 0) for i in kinds]
    weights = F.array(*(F.struct(n[i].alias("n"), first[i].alias("first"), *((n[j] == n[i]).alias(f"in{j}") for j in kinds)) for i in kinds))
    parts = F.explode(F.array(*(F.lit(g) for g in range(-(-samples // GROUP)))))
    terms = counts.select(*key, "term", F.explode(weights).alias("w")).where("w.first").select(*key, "term", "w.*").withColumn("log_weight", F.log(F.col("n").cast("double"))).withColumn("part", parts)
    drawn = terms.select(*key, "part", *(f"in{i}" for i in kinds), *(_sample(F.col("term"), F.col("log_weight"), F.col("part") * GROUP + j).alias(f"a{j}") for j in range(GROUP)))
    least = drawn.groupBy(*key, "part").agg(*(F.min(F.when(F.col(f"in{i}"), F.col(f"a{j}"))).alias(f"m{i}_{j}") for i in kinds for j in range(GROUP)))
    part = F.struct("part", *(F.array(*(F.xxhash64(f"m{i}_{j}").bitwiseAND(F.lit(_LOW)) for j in range(GROUP))).alias(f"m{i}") for i in kinds))
    whole = least.groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select(*key, *(F.slice(F.flatten(F.col(f"parts.m{i}")), 1, samples).alias(f"signature_{i}") for i in kinds))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def followed(keys: DataFrame, id_col: str, tie: str) -> DataFrame:
    """Adds ``next_k``: the k of the next row by descending id (nulls last), then tie; after the last row, the first.

    Rows are dealt to as many ranges as Spark has shuffle partitions, by id and tie, so neither one
    task nor rows of one id are ordered as a whole; the first row of each range goes over the driver.
    """
    by = [F.col(id_col).desc_nulls_last(), F.col(tie).asc()]
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(keys.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "order")
    order = Window.partitionBy("range").orderBy(*by)
    firsts = ranged.withColumn("place", F.row_number().over(order)).where("place = 1").select("range", "k").collect()  # a row per range
    have = sorted((r["range"], r["k"]) for r in firsts)
    after = [(r, k) for (r, _), (_, k) in zip(have, have[1:] + have[:1], strict=True)]
    table = keys.sparkSession.createDataFrame(after, f"range int, after {keys.schema['k'].dataType.simpleString()}")
    return ranged.withColumn("next_k", F.lead("k").over(order)).join(F.broadcast(table), "range").withColumn("next_k", F.coalesce("next_k", "after")).drop("range", "after")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each text, and its edited text: the last half replaced by the start of the next document, by descending id.

    (id, n_chars, edited_text_sha256, signature, edited_signature, near_edited, near_next): a row per
    input row. Null texts are empty. Null ids come last. Rows of equal id and text stand for one
    document in the order and are given back as often as they came; rows of equal id and other
    texts are documents of their own, in order of a hash of the text. A lone document is its own next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.hex(F.xxhash64(text)))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), k.alias("k")).withColumn("n_chars", F.char_length("text").cast("long"))
    whole = rows.groupBy("k").agg(F.first("text").alias("text"))
    keys = rows.groupBy("k").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).cast("int").alias("copies"))
    chain = followed(keys, "id", "k")
    half = F.expr("int(n_chars div 2)")
    starts = whole.withColumnRenamed("k", "next_k").join(chain.select("k", "next_k", "n_chars"), "next_k").select("k", "n_chars", F.substring("text", F.lit(1), half).alias("start"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.expr("n_chars div 2")).cast("int")), "start")
    both = whole.join(starts, "k").select("k", "text", edited.alias("edited"))
    hashed = both.select("k", F.sha2("edited", 256).alias("edited_sha256"))
    signed = signatures(both, ["k"], ("text", "edited"), samples).withColumnsRenamed({"signature_0": "signature", "signature_1": "edited_signature"})
    pair = stored(signed.join(hashed, "k"), "signatures")  # read twice; no text is wanted after it
    of_next = pair.select(F.col("k").alias("next_k"), F.col("signature").alias("next_signature"))
    out = pair.join(chain, "k").join(of_next, "next_k")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "signature", "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
