import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import bpe, token_counts, token_files
from graphloom.llm.pretoken import encoder
from graphloom.llm.shared import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["", "   ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "I'LL we've <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "a" * 3000, "ab" * 300 + "xyz" * 70, "ﬁ Å Å", "a\x1cb \x85c\xa0d", "\x00\n\t", "漢字 かな٣½", "z" * 66 + " " + "qj" * 33]


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


def check(texts):
    ids, at = encoder(PATH).encode(pa.array(texts, pa.string()))
    back = encoder(PATH).decode(ids, at).to_pylist()
    counts = token_counts.piece_counts(PATH).of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = ids_of(t or "")
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        assert back[i] == LIB.decode(want, skip_special_tokens=False)
        assert counts[i] == len(want)


def test_odd_texts_as_the_library():
    rng = random.Random(1)
    letters = "abc the'sS tTİΣσς̸́é ß \x1c\x85\xa0 　漢12٣½!?.<|endoftext|>\n😀"
    check(ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_any_text_as_the_library(texts):
    check(texts)


def test_every_code_point_as_the_library():
    texts = ["".join(f"a{chr(c)}{chr(c)}b " for c in range(i, i + 64) if not 0xD800 <= c <= 0xDFFF) for i in [*range(0, 0x3500, 64), *range(0xA640, 0xAC00, 64), *range(0x10900, 0x11F00, 64), *range(0x16E00, 0x19200, 512), *range(0x323B0, 0x33500, 512), 0x3D000, 0xE0000]]
    check(texts)


def test_encode_and_decode_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "ids") for r in rows], "doc_id long, text string, ids string")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()
    want = sorted((str(i), np.array(ids_of(t or ""), "<u4").tobytes(), LIB.decode(ids_of(t or ""), skip_special_tokens=False)) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in got) == want


def test_counts_rows(spark):
    docs = spark.createDataFrame([(1, "the idiot"), (1, "the idiot"), (None, None), (2, "ü")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect())
    assert got == sorted([("1", 9, len(ids_of("the idiot")))] * 2 + [("None", 0, 0), ("2", 2, 1)])


def test_compress_round_trip():
    rng = np.random.default_rng(2)
    for seq in (np.zeros(0, int), np.array([1]), np.full(1000, 7), np.full(1001, 7), rng.integers(2, 6, 5000), np.tile([5, 5, 5, 1], 300)):
        for min_count in (2, 3, 24):
            symbols, rules, lengths = token_files.compress(seq, 1, 50, min_count=min_count)
            assert token_files.expand(symbols, rules, lengths, 50).tolist() == seq.tolist()
            assert len(symbols) <= len(seq) and len(rules) == len(lengths)
            closed = np.zeros(50 + len(rules), bool)
            closed[1] = True
            for i, (_, b) in enumerate(rules):
                closed[50 + i] = closed[b]
            found, same = {}, -2
            for i in np.flatnonzero(~closed[symbols[:-1]]).tolist():  # in a run of one symbol, pairs that don't overlap
                pair = symbols[i], symbols[i + 1]
                same = -2 if i == same + 1 and pair[0] == pair[1] == symbols[i - 1] else i
                found[pair] = found.get(pair, 0) + (same == i)
            assert max(found.values(), default=0) < max(min_count, 2)  # no frequent pair is left
    symbols, rules, _ = token_files.compress(np.full(1000, 7), 1, 50, min_count=3)
    assert len(symbols) < 20 and len(rules) > 5


def test_a_part_is_expanded_by_itself():
    seq = np.tile(np.random.default_rng(4).integers(2, 9, 300), 20)
    symbols, rules, lengths = token_files.compress(seq, 1, 50)
    for a, b in ((0, 0), (0, 6000), (17, 18), (295, 905), (5990, 6000)):
        assert token_files.expand(symbols, rules, lengths, 50, a, b).tolist() == seq[a:b].tolist()

    class Counted(np.ndarray):
        asked = 0

        def __getitem__(self, at):
            Counted.asked += np.size(at) if isinstance(at, np.ndarray) else 0  # rows of rules; columns of what came back are tuples
            return super().__getitem__(at)

    token_files.expand(symbols, rules.view(Counted), lengths, 50, 40, 42)
    assert 0 < Counted.asked < len(rules) / 4


def test_token_files(spark):
    texts = ["the cat sat on the mat " * 50, "", None, "ü", "the cat sat on the mat " * 20]
    rows = [(7, texts[0]), (2, texts[1]), (5, texts[2]), (-1, texts[3]), (9, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = fresh_path(spark, "t")
    token_files.write_token_files(docs, path, PATH, shard_ids=300)
    at = 0
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    for i, t in sorted(rows):
        want = ids_of(t or "") + [1]
        assert (got[i].start, got[i].n_tokens) == (at, len(want))
        assert zlib.crc32(bytes(got[i].ids)) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    shard = next(r for r in spark.read.parquet(path).collect() if 7 in r.doc_ids).asDict()
    assert token_files.document(shard, shard["doc_ids"].index(7)).tolist() == ids_of(texts[0]) + [1]
    assert token_files.document(shard, shard["doc_ids"].index(7), 3, 9).tolist() == ids_of(texts[0])[3:9]


def test_chunks_are_learnt_once(monkeypatch):
    from graphloom.llm.pretoken import Encoder

    e, learnt = Encoder(PATH), []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda chunks: (learnt.append(len(chunks)), learn(chunks)))
    slices_ = [pa.array([" ".join(f"{a:x}q{i}" for i in range(40_000))]) for a in range(10)]
    first = [e.encode(s)[0] for s in slices_]
    assert learnt == [40_000] * 10
    assert (e.encode(slices_[0])[0] == first[0]).all() and len(learnt) == 10


def test_pairs_without_overlap_are_those_taken_one_by_one():
    from graphloom.llm.token_files import _slots, _without_overlap

    rng = np.random.default_rng(2)
    for limit in (1, 3, 50):
        pairs = np.unique((rng.integers(0, 30, 200) << 32) | rng.integers(0, 30, 200))
        counts = rng.integers(4, 9, len(pairs))
        lefts, rights, want, slots = set(), set(), [], set()
        for i in np.lexsort((pairs, -counts)):
            a, b, slot = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF, int(_slots(pairs[i : i + 1])[0])
            if slot not in slots and len(want) < limit and ((a not in rights and b not in lefts) if a != b else (a not in lefts | rights)):
                want.append(pairs[i])
                lefts.add(a)
                rights.add(b)
            slots.add(slot)
        assert _without_overlap(pairs, counts, limit).tolist() == sorted(want)
