"""Operator 11: verdicts on URLs from rules and listed URLs, by a blocked Bloom filter and an exact join. DataFrame functions only.

Rules and listed URLs are keys of one list. A URL makes a key for each pair of label count and path length
that some rule has, and one of its canonical form. Keys go through the filter, those it lets pass to the exact
join with the list, which takes its false positives out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored

WORDS = 4  # longs of a block; a key sets one bit in each
BITS_A_KEY = 16
MAX_BLOCKS = 1 << 17  # rows of the filter, which is broadcast: 6 MB of numbers. A longer list makes it less sharp, not larger.
_LISTED = "="  # stands before canonical URLs, which no host begins with


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: on up to ? or #. Null or without ://: both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. and the usual port, and the path without a slash at its end; no scheme, query or fragment. Null without a host."""
    plain = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    return F.when(plain != "", F.concat(F.lit(_LISTED), plain, F.regexp_replace(path, "/+$", "")))


def _bits(key: Column) -> list[Column]:
    """A bit of each word of the key's block."""
    h = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def filter_size(n_keys: int) -> int:
    """Blocks for so many keys: a power of two, ``MAX_BLOCKS`` at most."""
    return min(MAX_BLOCKS, 1 << max(0, (n_keys * BITS_A_KEY - 1).bit_length() - 8))


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 to w3): a row for each block with a key, ``n_blocks`` at most. keys: (key)."""
    each = keys.select(_block(F.col("key"), n_blocks).alias("block"), *(b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("key")))))
    return each.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)))


def possible(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` the filter of ``keys`` lets pass: all that have one of them, and a few others."""
    n_blocks = filter_size(keys.count())
    words = F.broadcast(bloom_filter(keys, n_blocks))  # MAX_BLOCKS rows at most
    met = rows.withColumn("block", _block(F.col("key"), n_blocks)).join(words, "block")
    for j, b in enumerate(_bits(F.col("key"))):
        met = met.where(F.col(f"w{j}").bitwiseAND(b) != 0)
    return met.drop("block", *(f"w{j}" for j in range(WORDS)))


def key_list(rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """(key, rule, verdict, n_host, n_rule): rules (host, path, verdict) and listed URLs, each key once.

    Rules with a null go, as do URLs without a host. Of rules with one key and two verdicts block holds.
    """
    host, path = host_and_path(F.col(url_col))
    plain = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), "path", "verdict")
    by_rule = plain.select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.char_length("host").alias("n_host"), (F.char_length("host") + F.char_length("path")).alias("n_rule"))
    by_url = listed.select(canonical(host, path).alias("key")).where("key is not null").select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("n_host"), F.lit(-1).alias("n_rule"))
    both = by_rule.union(by_url)
    return both.groupBy("key").agg(*(F.max(c).alias(c) for c in ("rule", "verdict", "n_host", "n_rule")))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): one row per input row; null and repeated ids and URLs are rows by themselves.

    rules: (host, path, verdict) with verdict allow or block. A rule fits its host and all subdomains of it where the
    path starts with the rule's; the longest wins, of equal ones that of the longer host. Without a rule a URL is blocked
    if its canonical form is that of a listed URL (column ``url_col``), else allowed; then rule is null. A null or odd URL
    has an empty host and path and is allowed. Other columns are not looked at. No rows in, no rows out.
    """
    host, path = host_and_path(F.col(url_col))
    rows = stored(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    keys = stored(key_list(rules, listed, url_col), "url-list")
    # the pairs of label count and path length: as many as rules differ in form
    forms = keys.where("rule is not null").select((F.col("n_host") - F.length(F.translate(F.expr("left(rule, n_host)"), ".", "")) + 1).alias("labels"), (F.col("n_rule") - F.col("n_host")).alias("n")).distinct().collect()
    prefix = [F.when(F.char_length("path") >= f.n, F.concat(F.substring_index("host", ".", -f.labels), F.expr(f"left(path, {f.n})"))) for f in forms]
    made = rows.select("row", F.explode(F.array_distinct(F.array(*prefix, canonical(F.col("host"), F.col("path"))))).alias("key")).where("key is not null")
    hits = possible(made, keys.select("key")).join(keys, "key")
    best = hits.groupBy("row").agg(F.max(F.struct("n_rule", "n_host", "rule", "verdict")).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
