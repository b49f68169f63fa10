import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import near_copies, packing, queries, token_counts
from graphloom.llm.pretoken import encoder
from graphloom.llm.simhash import fingerprints_of
from graphloom.llm.token_counts import piece_counts
from tests.llm.brute import partition, shingles


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " ", "one two", "ONE  two", "one two three four five", "a b"]
    for n in (100, 250, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        # copies of 1 % of words changed, a chain that drifts away from its start, and a half-alike text
        out += [" ".join(edited(rng, base, max(1, n // 100))) for _ in range(6)] + [" ".join(base)]
        drift = base
        for _ in range(5):
            drift = edited(rng, drift, n // 60)
            out.append(" ".join(drift))
        out.append(" ".join(base[: n // 2] + [f"x{i}" for i in range(n // 2)]))
    return out


def test_shingle_sets(texts):
    got = list(near_copies.shingle_sets(pa.array(["Ä lone one", *texts]).slice(1)))
    want = list(map(shingles, texts))
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])


def test_groups_are_those_of_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component for r in near_copies.groups(docs, ["doc_id"]).collect()}
    want = partition(texts)
    assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_stage_keeps_one_of_near_copies(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, "").toPandas()
    assert sorted(got.doc_id) == sorted(set(partition(texts)))


def test_packing_parts_near_copies(spark, texts):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = packing.pack_documents(docs, queries.TOKENIZER, capacity=8000).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    group = partition(texts)
    for _, rows in got.groupby(["shard", "bin"]):
        held = [group[i] for i in rows.doc_id if texts[i] is not None]
        assert len(held) == len(set(held))
    assert got.groupby(["shard", "bin"]).doc_id.count().max() > 1


def test_stage_takes_the_links_of_operator_2(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(50_000)}" for _ in range(4000)]
    copies = [" ".join([*base[:-1], f"end{i}"]) for i in range(60)]
    bits = fingerprints_of(pa.array(copies)).tolist()
    near = next(i for i in range(1, 60) if 0 < (bits[0] ^ bits[i]).bit_count() <= 2)
    docs = spark.createDataFrame([(0, copies[0]), (1, copies[near]), (2, "another text of some words")], "doc_id long, text string")
    marked = near_copies.marked

    def apart(*args):
        """No two rows share a band."""
        return marked(*args).withColumn("bands", F.transform("bands", lambda _, i: F.col("node") + i))

    monkeypatch.setattr(near_copies, "marked", apart)
    alone = [r.component for r in near_copies.groups(docs, ["doc_id"]).orderBy("doc_id").collect()]
    linked = [r.component for r in near_copies.groups(docs, ["doc_id"], fingerprints=True).orderBy("doc_id").collect()]
    assert len(set(alone)) == 3 and linked[0] == linked[1] != linked[2]
    rows = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, rows, "").collect()) == [0, 2]


def test_packing_counts_and_marks_in_one_worker(spark, texts):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    length = near_copies.Measure("n_tokens", "text", lambda x: piece_counts(queries.TOKENIZER).of(x), (encoder, piece_counts))
    marks = near_copies.marked(docs, ["doc_id"], "text", length)
    assert marks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, queries.TOKENIZER).collect()}
    assert {r.doc_id: r.n_tokens for r in marks.collect()} == want


def test_pairs_that_are_no_links_are_told_by_their_sketches(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(50_000)}" for _ in range(400)]
    docs = [" ".join(edited(rng, base, 6)) for _ in range(60)]  # alike by 0.74
    made, stored = {}, near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name: made.setdefault(name, stored(df, name)) if name == "near-pairs" else stored(df, name))
    got = [r.component for r in near_copies.groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()]
    want = partition(docs)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))
    assert made["near-pairs"].count() < 200  # of 1770 pairs


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(7)
    for n in (1, 5, 300, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in "ab")
        whole = np.unique(np.concatenate([a, b[: n // 4]]))
        x, y, z = near_copies.sketches([a, whole, a]).view(np.uint64)
        assert np.bitwise_count(x ^ y).sum() <= len(whole) - len(a) and (x == z).all()
