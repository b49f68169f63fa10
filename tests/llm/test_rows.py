"""Rows of null and repeated ids go through the pipeline each by itself."""

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import packing, quality, queries, token_files

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10_000)}" for _ in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table():
    fine = [(i, prose(k), "en", f"s{k % 2}", 1) for k, i in enumerate([None, None, None, 7, 7, 8])]
    bad = [(None, "too short", None, "s0", 1), (7, "short too", "en", None, 1), (None, None, "en", "s0", 1)]
    return fine, bad


def test_quality_decides_by_row(spark, monkeypatch):
    w = np.zeros((1 << quality.SLOTS_LOG2) + 2)
    w[-2] = -100.0
    monkeypatch.setattr(quality, "fit", lambda *a, **b: w)
    monkeypatch.setattr(corpus_pipeline, "labels", lambda *a: None)
    fine, _ = table()
    bad = [(None, "tick tock " * 30, "en", "s0", 1), (7, "to and fro " * 30, "en", "s1", 1)]
    assert rows_of(corpus_pipeline.keep_quality(spark, spark.createDataFrame(fine + bad, KIND), "")) == sorted(fine, key=str)


def test_rules_decide_by_row(spark):
    fine, bad = table()
    assert rows_of(corpus_pipeline.keep_by_rules(spark, spark.createDataFrame(fine + bad + fine[:1], KIND), "")) == sorted(fine + fine[:1], key=str)


def test_one_row_of_each_group(spark):
    fine, _ = table()
    near = [(9, fine[3][1] + " end", "en", "s0", 1), (3, fine[0][1] + " end", "en", None, 1), (None, fine[5][1], "de", "s0", 1)]
    got = rows_of(corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(fine + near + fine[:2] + fine[3:4], KIND), ""))
    assert got == sorted([near[1], *fine[1:]], key=str)


def test_cut_rows_keep_their_columns(spark):
    fine, _ = table()
    again = [(None, fine[5][1] + " and more", "de", "s9", 1), (7, None, None, "s8", 1)]
    rows = fine + again
    got = rows_of(corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, KIND), ""))
    want = [(i, t or "", lang, s, len(t or "")) for i, t, lang, s, _ in fine + again[1:]] + [(None, " and more", "de", "s9", 9)]
    assert got == sorted(want, key=str)


def test_whole_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    fine, bad = table()
    spark.createDataFrame(fine + bad + fine[:1], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(r[0]) for r in fine)


def test_sample_is_bounded_by_documents(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, "three"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", 10).collect()
    assert len(rows) == 10 == len(set(rows)) and all(r.text.startswith("text") and r.label == 1 for r in rows)
    assert quality.labelled_sample(docs, labels, "quality", 1000).count() == 50


def test_null_rows_are_dealt_to_all_shards(spark):
    rows = spark.range(800).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).alias("n_tokens"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("cluster"))
    per = [r["count"] for r in packing.best_fit_pack(rows, 8).groupBy("shard").count().collect()]
    assert len(per) == 8 and sum(per) == 800 and max(per) < 200


def test_token_files_of_null_and_repeated_ids(spark, tmp_path):
    texts = [(None, prose(1)), (None, prose(2)), (None, None), (7, prose(3)), (7, prose(4)), (7, prose(4)), (3, ""), (9, prose(5))]
    token_files.write_token_files(spark.createDataFrame(texts, "doc_id long, text string"), f"{tmp_path}/t", queries.TOKENIZER)
    got = token_files.read_token_files(spark, f"{tmp_path}/t").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(((i, ids(t)) for i, t in texts), key=str)
    at = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, None, 3, 7, 7, 7, 9]


CLASHING = ["id", "host", "kept", "n", "node", "label", "score", "w", "m", "cluster", "shard", "bin", "piece", "offset", "n_tokens", "ids", "part", "seq", "start", "words", "h", "g", "key", "component", "band", "bits", "predicted", "rate"]


@pytest.mark.parametrize("name", ["op3_pack", "op4_quality", "op5_toxicity", "op7_rules", "op8_token_files", "op9_token_counts", "pipeline"])
def test_other_columns_change_nothing(spark, tmp_path, name):
    query = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("doc_id < 40")
    out = []
    for where, extra in (("plain", []), ("more", [F.lit("x").alias(c) for c in CLASHING])):
        docs.select("*", *extra).coalesce(1).write.parquet(f"{tmp_path}/{where}/documents.parquet")
        labels.select("*", *(extra[:5])).write.parquet(f"{tmp_path}/{where}/labels.parquet")
        out.append(rows_of(query(spark, f"{tmp_path}/{where}")))
    assert out[0] == out[1] and out[0]


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
