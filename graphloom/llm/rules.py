"""Operator 7: quality rules per document, and verdicts per host from shrunk failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretoken import listed, slices
from graphloom.llm.simhash import split_words
from graphloom.llm.workers import task

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_HOST_RATE = 0.5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_WHITE = " \t\n\v\f\r"


def repeated_words(code: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each text that lie in a window of five words found twice or more in it."""
    if len(code) < WINDOW:
        return np.zeros(n_docs, np.int64)
    starts = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :])
    mixed = doc[starts].astype(np.uint64)
    for i in range(WINDOW):  # a mix may collide, so equal ones are compared below
        mixed = (mixed ^ code[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    first, second = starts[order[:-1]], starts[order[1:]]
    equal = mixed[order[:-1]] == mixed[order[1:]]
    first, second = first[equal], second[equal]
    same = doc[first] == doc[second]
    for i in range(WINDOW):
        same &= code[first + i] == code[second + i]
    twice = np.zeros(len(code) + 1, np.int64)
    if same.all():
        flagged = np.unique(np.concatenate([first, second]))
    else:  # a collision: count these windows by their words
        rows = np.stack([doc[starts], *(code[starts + i] for i in range(WINDOW))])
        _, back, n = np.unique(rows, axis=1, return_inverse=True, return_counts=True)
        flagged = starts[n[back.reshape(-1)] > 1]
    np.add.at(twice, flagged, 1)
    np.add.at(twice, flagged + WINDOW, -1)
    return np.bincount(doc[np.cumsum(twice)[:-1] > 0], minlength=n_docs).astype(np.int64)


def statistics_of(texts: pa.Array) -> list[np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    words, offsets = split_words(texts)
    n_words = np.diff(offsets)
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))])
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    some = np.fromiter((bool(x.strip(_WHITE)) for x in listed(lines.dictionary)), bool, len(lines.dictionary))
    line, line_doc = lines.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    line, line_doc = line[some[line]], line_doc[some[line]]
    distinct = np.unique(line_doc * max(1, len(some)) + line) // max(1, len(some))
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(distinct, minlength=n)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeats = repeated_words(code, np.repeat(np.arange(n), n_words), n)
    return [n_words.astype(np.int64), np.diff(chars[offsets]).astype(np.int64), symbols, dup_lines.astype(np.int64), repeats]


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, keep) of each row; null texts have no words."""

    @task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), *map(pa.array, statistics_of(b.column("__text"))), *(b.column(c) for c in keep)], ["id", "host", *(f.split()[0] for f in STATS.split(", ")), *keep])

    id_kind, host_kind = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("__text"), *keep)
    return rows.mapInArrow(count, ", ".join([f"id {id_kind}, host {host_kind}, {STATS}", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(stats: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): failure rates shrunk to a beta prior of all hosts.

    The prior's mean is the failure rate of all rows, its strength comes from the spread of the
    hosts' rates beyond what their sizes explain. A null host is a host of its own.
    """
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(base_failed().cast("long")).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"))
    m = F.col("f") / F.col("n")
    one = F.col("k") / F.col("n")  # 1 / mean size
    spread = (F.col("ff") / F.col("n") - m * m) / (m * (1 - m))
    rho = F.when((m <= 0) | (m >= 1) | (one >= 1), F.lit(0.5)).otherwise(F.least(F.greatest((spread - one) / (1 - one), F.lit(1e-4)), F.lit(0.999)))
    prior = total.select(m.alias("mean"), (1 / rho - 1).alias("strength"))  # one row
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, statistics, base_failed, host_kept, kept, keep): one row per input row, null ids and repeats included.

    Empty and null texts fail by having under ten words. No rows in, no rows out.
    """
    from graphloom.llm.shared import stored

    stats = stored(rule_statistics(docs, id_col, host_col, text_col, keep), "rules")
    verdict = host_verdicts(stats).select(F.col("host").alias("of_host"), "host_kept")
    rows = stats.join(verdict, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host").withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).withColumnRenamed("id", id_col).withColumnRenamed("host", host_col)
