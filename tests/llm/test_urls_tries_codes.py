"""Operators 11 to 13 against plain versions, on odd rows and against their SQL on small tables."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import prefix_trie, queries, url_filter, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_urls", "op12_prefix_trie", "op13_vector_codes"])
def test_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.project(", ".join(order)).fetchall()), key=str)


URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://example.com/en/1", "http://WWW.Example.COM/en/1?x=/y", "https://m.www.example.com/en/", "ftp://a.net/es/2#frag",
    "http://notexample.com/en/1", "http://x.example.com/EN/1", "http://net/fr/", "http://b.org/fr/", "http://spam.org/p/?a=1", "http://www.spam.org:80/p", "https://spam.org/p#top", "http://spam.org/q", "a://b://c.com/", "http://\u00c9.com/x\n/y?z", "http://b.com:80/en/",
]


def plain_verdict(url, rules, listed):
    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]

    def form(u):
        host, path = parts(u)
        host = re.sub(":(80|443)$", "", re.sub(r"^www\.", "", host))
        return host and host + re.sub("/+$", "", path)

    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if form(url) and form(url) in set(map(form, listed)) else "allow"


def test_urls_against_plain_version(spark):
    rules = [*queries.URL_RULES, ("b.com", "/e", "block"), ("org", "/f", "block")]
    listed = ["http://www.spam.org/p/", "https://listed.example.org/z?utm=1", None, "odd"]
    pages = [(i if i % 5 else None, u, "x", "y", 1) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, key string, block int")
    got = url_filter.judge_urls(df, spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in listed], "url string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *plain_verdict(u, rules, listed)) for i, u, *_ in pages), key=str)


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.possible(keys, keys).count() == 5000
    assert 0 < url_filter.possible(others, keys).count() < 400
    assert url_filter.filter_size(0) == 1 and url_filter.filter_size(10**12) == url_filter.MAX_BLOCKS
    n = url_filter.filter_size(5000)
    assert n == 512 and url_filter.bloom_filter(keys, n).count() <= n


def plain_trie(turns):
    convs = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [x[3:] for x in sorted(rows)] for c, rows in convs.items()}
    nodes = collections.defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = (convs.get(c - int(math.fmod(c, 20)), [])[:h]) + own[h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, d == len(seq)))
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    memo = {}
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        memo[k] = (sum(memo[x][0] for x in kids[k]) or 1, (len(nodes[k]) - 1) * words + sum(memo[x][1] for x in kids[k]))
    return sorted((min(nodes[k])[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(nodes[k]), len(kids[k]), *memo[k], hashlib.sha256(",".join(str(c) for c, e in sorted(nodes[k]) if e).encode()).hexdigest()) for k in nodes) if nodes else []


def test_trie_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rng = random.Random(3)
    turns = []
    for c in [*range(-30, 90), 7000, 7001, 123456789012]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 6])):
            turns.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a b", "a", "", None, "x\ty z "])))
    turns += [(200, t, "user", "same words") for t in range(40)] + [(201, t, "user", "same words") for t in range(37)] + [(202, t, "user", "same words") for t in range(37)]
    turns += [(200, 5, "user", "same words")] * 3 + [(None, 1, "user", "lost"), (300, None, None, None)]
    df = spark.createDataFrame([(*t, "n", 1, "p") for t in turns], "conv_id long, turn long, role string, text string, node string, depth int, conv string")
    got = prefix_trie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(turns), key=str)


def test_ends_of_many_conversations(spark):
    ids = [i * 37 - 5000 for i in range(3000)]
    ends = spark.createDataFrame([("n", i) for i in ids] + [("m", 5)], "node string, conv long")
    assert {r.node: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()} == {"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "m": hashlib.sha256(b"5").hexdigest()}


def plain_codes(rows, entries):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 4 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])] if kept else []
    if not kept:
        return []
    w = len(kept[0][2]) // 4
    books = [[r[2][p * w : p * w + w] for r in kept[:entries]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, p: min((dist(part, c), e) for e, c in enumerate(books[p]))
    cut = lambda v, p: v[p * w : p * w + w]
    for _ in range(4):
        new = []
        for p in range(4):
            of = collections.defaultdict(list)
            for _, _, v in kept:
                of[near(cut(v, p), p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(of[e]) for x in zip(*of[e], strict=True)] if of[e] else c for e, c in enumerate(books[p])])
        books = new
    out = [(i, label, "".join(f"{near(cut(v, p), p)[1]:02x}" for p in range(4)), min(sum(min(near(cut(v, p), p)[0], 2**63 - 1) for p in range(4)), 2**63 - 1)) for i, label, v in kept]
    total = collections.Counter()
    for _, label, _, e in out:
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, min(total[label], 2**63 - 1), sha) for i, label, c, e in out), key=str)


@pytest.mark.parametrize("scale", [0.3, 3e4, 1e12])
def test_codes_against_plain_version(spark, scale):
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i, None, 5]), [float(np.float32(rng.choice([rng.gauss(0, scale), -0.5, 0.25]))) for _ in range(8)], rng.choice([0, 1, None])) for i in range(60)]
    rows += [rows[3], rows[3], (99, None, 1), (98, [], 1), (97, [1.0] * 4, 1), (96, [1.0, None] * 4, 1), (95, [float("nan")] * 8, 1), (94, [float("inf")] * 8, None), (93, [1.0] * 7, 0)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, part string, place int")
    got = vector_codes.compress(df, entries=8)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, 8)


def test_distances_are_exact():
    a, b = np.array([[1 << 40, -(1 << 40)], [3, 4]]), np.array([[0, 0], [1 << 40, 5]])
    assert vector_codes.distances(a, b).tolist() == [[2 << 80, (5 + (1 << 40)) ** 2], [25, ((1 << 40) - 3) ** 2 + 1]]
    assert vector_codes.nearest(a, b)[1].tolist() == [vector_codes.LARGEST, 25]
