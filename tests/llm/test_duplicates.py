import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from graphloom.llm import components, simhash, substring_dedup
from graphloom.llm.suffixes import deep_shallow, multikey_quicksort


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(bits):
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one two", "Ä ä b\x0bc d", "a b c " * 40, "x y z w v", "X  Y z\nw v", "  a b c d"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bits string")
    got = {r.id: r.bits % (1 << 64) for r in simhash.simhash(docs).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_postings_shared_by_pairs():
    for n, least, most in ((8, 14, 14), (7, 7, 7), (6, 3, 3), (5, 1, 1), (4, 0, 1), (3, 0, 0)):
        counts = {sum({*b} <= {*same} for b in simhash.BLOCKS) for same in combinations(range(8), n)}
        assert (min(counts), max(counts)) == (least, most)
    assert simhash.LEAST_SHARED == 3


@pytest.mark.parametrize("posting", [1, 3, 64])
def test_links_are_all_pairs(spark, monkeypatch, posting):
    monkeypatch.setattr(simhash, "POSTING", posting)
    rng = random.Random(4)
    bits = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(120):
        b = rng.choice(bits)
        for _ in range(rng.choice([1, 1, 2, 3])):
            b ^= 1 << rng.choice([0, 1, 15, 16, 31, 32, 40, 47, 48, 62, 63])
        bits.append(b)
    bits = sorted(set(bits))
    df = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert sorted(links) == sorted((a, b) if (a ^ 1 << 63) < (b ^ 1 << 63) else (b, a) for a, b in combinations(bits, 2) if (a ^ b).bit_count() <= 2)


def test_near_duplicates_name_the_least_id(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " end"), (9, "other words stand here"), (None, base), (4, None), (2, ""), (9, "other words stand here")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = groups([fingerprint(t) for _, t in rows])
    least = {g: min((r[0] for r, w in zip(rows, want, strict=True) if w == g and r[0] is not None), default=None) for g in want}
    assert sorted(map(str, got)) == sorted(str((r[0], least[w])) for r, w in zip(rows, want, strict=True))


def test_components_of_chain_star_and_none(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 300)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for n, levels, most in ((0, 2, 3), (1, 1, 3), (200, 1, 2), (300, 3, 3), (500, 2, 100)):
        keys, group = rng.integers(0, most, (n, levels)).astype(np.uint64), rng.integers(0, 4, n)
        order, cls = multikey_quicksort(group, keys)
        rows = [(group[i], *keys[i]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and rows == sorted(rows)
        assert [a == b for a, b in zip(cls, cls[1:], strict=False)] == [a == b for a, b in zip(rows, rows[1:], strict=False)]


def test_no_half_characters_are_kept(spark):
    same = "ä" * 30
    rows = [(1, same), (2, "b" + same + "\ufffd" + "cäb"), (3, "ü" + same[:25])]
    got = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    assert got == {1: same, 2: "b\ufffdcäb", 3: "ü"}


def test_deep_shallow_orders_any_bytes():
    rng = random.Random(2)
    for _ in range(60):
        n, depth = rng.randint(1, 50), rng.choice([5, 30, 50])
        texts = [bytes(rng.choice([0, 0, 1, 97]) for _ in range(rng.randint(0, depth))) for _ in range(n)]
        group, lens = np.array([rng.randint(0, 2) for _ in texts]), np.array(list(map(len, texts)))
        rows = np.array([list(t.ljust(depth, b"\0")) for t in texts], np.uint8)
        for shallow in (8, 16, 32):
            order = deep_shallow(group, rows, lens, shallow)
            keys = [(group[i], rows[i].tobytes(), lens[i]) for i in order]
            assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def cut(rows):
    first = {}
    blobs = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in blobs:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    out = []
    for (i, b), (doc_id, _) in zip(blobs, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((doc_id, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), [a for a, _ in spans], [e for _, e in spans]))
    return out


@pytest.mark.parametrize("size", [300, 1_000_000])
def test_repeats_as_brute_force(spark, size):
    rng = random.Random(8)
    words = ["ö", "the", "of", "stone", "river", "a", "\0"]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else " ".join(rng.choices(words, k=9)) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(50, "ha" * 200), (51, "ha" * 100), (52, "a" * 49), (53, "a" * 50), (54, "a" * 51), (None, "a" * 80), (None, None), (3, "ha" * 60), (3, "ha" * 60), (60, None), (61, "")]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int"), size, 2 * size).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, bytes(r.kept), r.starts, r.ends) for r in got))) == sorted(map(str, cut(rows)))


def _peak(f, *given) -> float:
    tracemalloc.start()
    try:
        f(*given)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_bucket_is_judged_and_a_block_cut_in_little_memory():
    rng = np.random.default_rng(5)
    rows = []
    for block in range(20):
        n = 50_000
        rows.append({"bucket": 0, "block": block, "kind": 0, "doc_ids": np.arange(block, 20 * 500, 20).astype("<i8").tobytes(), "counts": np.full(500, n // 500, "<u4").tobytes(), "pieces": (rng.integers(0, 1 << 30, n) * 2 + 1).astype("<u4").tobytes(), "around": rng.integers(0, 1 << 62, n).astype("<u8").tobytes()})
    assert _peak(substring_dedup._judge, (pa.scalar(0),), substring_dedup._rows(rows)) < 60  # 12 MB of anchors
    letters = rng.integers(97, 123, 6_000_000).astype(np.uint8).tobytes().decode()
    docs = pa.table({"block": [0] * 100, "id": list(range(100)), "text": [letters[i * 60_000 : (i + 1) * 60_000] for i in range(100)]})
    marks = substring_dedup._rows([])
    cut = substring_dedup._cut(1, pa.int64(), [], True)
    assert _peak(cut, (pa.scalar(0),), docs, marks) < 140  # before: covered bytes, lost characters and places in eight bytes each


def test_characters_that_lost_a_byte_go():
    data = np.frombuffer("aé中𝟘bß".encode(), np.uint8)
    for a in range(len(data)):
        for b in range(a + 1, len(data) + 1):
            gone = np.zeros(len(data), bool)
            gone[a:b] = True
            got = substring_dedup._whole_characters(data, gone, np.array([a]), np.array([b]))
            want, at = [], 0
            for c in "aé中𝟘bß":
                n = len(c.encode())
                want += [bool(gone[at : at + n].any())] * n
                at += n
            assert got.tolist() == want
