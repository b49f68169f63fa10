import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import cws, packing, quality, rules, toxicity
from graphloom.llm.queries import ORACLE_SQL, op7_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    rows = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    rows["held_out"] = [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]
    return rows[~rows.held_out], rows[rows.held_out]


def test_quality_on_held_out_labels(labelled):
    train, test = labelled
    w = quality.train(train.text.tolist(), train.quality.to_numpy(float))
    score = quality.score(pa.array(test.text), w)
    assert ((score >= 0.3) == test.quality).mean() > 0.93
    assert (quality.score(pa.array([None, "", "a"], pa.string()), w) >= 0).all()


def test_toxicity_on_held_out_labels(labelled):
    train, test = labelled
    v, t = toxicity.train(train.text.tolist(), train.toxic.to_numpy())
    machine = toxicity.Scorer(np.append(v, t).astype("<f4").tobytes())
    score = machine.score(pa.array(test.text))
    assert ((score >= 0.5) == test.toxic).mean() > 0.9
    assert len(machine.score(pa.array([None, "", "a b c d", "..."], pa.string()))) == 4


def test_gaps_and_insertions_stay_close():
    words = [toxicity.canonical(w) for w in ("idiot", "i.d.i.o.t", "iddiot", "idxiot", "the", "stone")]
    u = toxicity.unit_vectors(words)
    near = u @ u[0]
    assert near[1] == near[0] and near[0] < 1.2  # a word with repeated subsequences is a little over 1
    assert near[2] > 0.6 and near[3] > 0.3 and max(near[4:]) < 0.1
    code, chunks, at = toxicity.canonical_words(pa.array(["you i d i o t", "a b", None]))
    assert "idiot" in chunks and np.diff(at).tolist() == [7, 2, 0]


def test_no_labels_give_even_scores(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(docs, quality.fit(docs, labels)).collect()] == [0.5, 0.5]
    assert [r.score for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).collect()] == [0.5, 0.5]


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)]


def test_rule_statistics():
    texts = [None, "", "a b c d e f", "a b c d e a b c d e", "x\nx\n \ny\nx", "# ü | <a>", "w " * 30, "  a\x0bb", "p q r s t u p q r s t v w"]
    got = rules.statistics_of(pa.array(texts))
    assert [[int(c[i]) for c in got] for i in range(len(texts))] == [statistics(t) for t in texts]


def test_rules_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op7_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = op7_rules(spark, SF).toPandas()[want.columns].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_bad_hosts_lose_their_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "same old words come here " * 20
    rows = [(i, "fine", good + str(i)) for i in range(60)] + [(100 + i, "farm", bad if i < 55 else good + str(i)) for i in range(60)] + [(300, None, good), (301, "small", bad)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i].kept for i in range(60)) and got[300].kept and not got[301].kept
    assert not got[159].kept and not got[159].base_failed


def naive(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and (b[0] > 0 or n == 0) and (s < 0 or s not in b[1]) and (c < 0 or c not in b[2])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        out.append(i)
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
    return out


def test_packing_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 80))
        lengths = sorted(rng.integers(1, 60, n).tolist(), reverse=True)
        sources, clusters = rng.integers(-1, 6, n).tolist(), rng.integers(-1, 20, n).tolist()
        bins, offsets = packing.place(lengths, sources, clusters, 64)
        assert bins == naive(lengths, sources, clusters, 64)
        assert all(o + x <= 64 for o, x in zip(offsets, lengths, strict=True))


def test_packing_rows(spark):
    rows = [(1, 5000, "s", 1), (2, 100, "s", 2), (3, 0, None, None), (None, None, None, None), (4, 2048, "t", 3), (5, 1000, "u", 4), (5, 1000, "u", 4)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long"), 1).toPandas()
    assert got[got.doc_id == 1].n_tokens.tolist() == [2048, 2048, 904]
    assert got.groupby("bin").n_tokens.sum().max() <= 2048
    assert len(got) == 9 and got[got.doc_id == 5].bin.nunique() == 2
    assert packing.best_fit_pack(spark.createDataFrame([], "doc_id long, n_tokens long, source string, cluster long"), 0).count() == 0


def likeness(a, b):
    a, b = collections.Counter((a or "").split()), collections.Counter((b or "").split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_follow_generalised_jaccard(spark):
    base = [f"w{i % 37}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"v{j}" for j in range(200 - k)]) for k in range(0, 201, 20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.signature_0 for r in cws.signatures(df, ["k"], samples=256).collect()}
    for i, t in enumerate(texts):
        share = np.mean([x == y for x, y in zip(got[i], got[10], strict=True)])
        assert abs(share - likeness(t, texts[10])) < 0.1


def drawn(text, samples):
    """Signature of a text by the method's formulas, word by word."""
    out = []
    xx = lambda raw, seed=42: xxhash.xxh64_intdigest(raw, seed)
    log = lambda h, *cuts: math.log(math.prod((h >> s & (1 << n) - 1) + 0.5 for s, n in cuts)) - sum(n for _, n in cuts) * math.log(2)
    words = collections.Counter(re.sub("[ \\t-\\r]+", " ", text or "").strip(" ").split(" "))
    for j in range(samples):
        least = math.inf
        for word, n in words.items():
            first = xx(struct.pack("<i", j), xx(struct.pack("<Q", xx(word.encode()))))
            second = xx(struct.pack("<Q", first))
            r, c, b = -log(first, (0, 21), (21, 21)), -log(second, (0, 32), (32, 32)), ((first >> 42) + 0.5) / 2**22
            t = math.floor(math.log(n) / r + b)
            least = min(least, c * math.exp(-r * (t - b + 1)))
        out.append(least)
    return out


def test_signatures_as_drawn_word_by_word(spark):
    rng = random.Random(6)
    texts = [None, "", " one\ttwo two\x0b", *(" ".join(rng.choices(["a", "bb", "c", "ü", "dd d"], k=rng.randint(1, 40))) for _ in range(8))]
    rows = [(i, t, texts[i - 1]) for i, t in enumerate(texts)]
    got = {r.k: r for r in cws.signatures(spark.createDataFrame(rows, "k int, text string, edited string"), ["k"], ("text", "edited"), 64).collect()}
    want = [drawn(t, 64) for t in texts]
    for i, _, _ in rows:
        assert got[i].signature_1 == got[(i - 1) % len(rows)].signature_0
        for j in range(len(rows)):
            same = [abs(x / y - 1) < 1e-9 for x, y in zip(want[i], want[j], strict=True)]
            assert same == [x == y for x, y in zip(got[i].signature_0, got[j].signature_0, strict=True)]


def test_edited_texts_and_order(spark):
    rows = [(5, "abcdef"), (9, "ghiü"), (1, ""), (3, None), (None, "xyz"), (7, "q"), (9, "ghiü")]
    got = cws.fingerprint_documents(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, k int")).collect()
    chain = [(9, "ghiü"), (7, "q"), (5, "abcdef"), (3, ""), (1, ""), (None, "xyz")]
    want = []
    for (i, t), (_, n) in zip(chain, chain[1:] + chain[:1], strict=True):
        half = len(t) // 2
        want += [(str(i), len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())] * (2 if i == 9 else 1)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert cws.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_run_no_python(spark):
    df = cws.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    text = "same words here"
    two = spark.createDataFrame([(1, text), (2, text)], "k int, text string")
    a, b = cws.signatures(two, ["k"]).select("signature_0").collect()
    assert a == b


def test_held_out(spark):
    got = spark.range(50).select("id", quality.held_out("id").alias("h"), F.col("id")).collect()
    assert all(r.h == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in got)
