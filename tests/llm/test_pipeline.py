import collections

import pytest

import corpus_pipeline
from graphloom.llm import packing, quality, queries, rules, substring_dedup, token_counts
from graphloom.llm.bpe import bpe_encode
from tests.llm.brute import partition

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF), "t"))
    return out


def test_each_stage_does_its_part(spark, kept):
    docs, by_quality, by_rules, single, cut = (k.toPandas().set_index("doc_id").sort_index() for k in kept)
    assert set(docs.index) >= set(by_quality.index) >= set(by_rules.index) >= set(single.index) == set(cut.index)
    assert list(kept[4].columns) == list(kept[0].columns)
    scores = quality.quality_scores(kept[0], quality.fit(kept[0], queries.labels(spark, SF))).toPandas()
    assert set(by_quality.index) == set(scores[scores.score >= 0.3].doc_id)
    verdict = rules.quality_rules(kept[1]).toPandas()
    assert set(by_rules.index) == set(verdict[verdict.kept].doc_id)
    assert single.index.tolist() == by_rules.index[sorted(set(partition(by_rules.text.tolist())))].tolist()
    seen = {}
    for i in sorted(single.index):
        b = single.text[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        assert cut.text[i] == bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")


def test_packing_of_what_is_left(spark, kept):
    packed = corpus_pipeline.run(spark, SF).toPandas()
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(kept[4], queries.TOKENIZER).collect()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == n
    assert packed.groupby(["shard", "bin"]).n_tokens.sum().max() <= packing.CAPACITY
    source = {r.doc_id: r.source for r in kept[4].select("doc_id", "source").collect()}
    for _, rows in packed.groupby(["shard", "bin"]):
        assert max(collections.Counter(map(source.get, rows.doc_id)).values()) == 1


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_operators_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c " * 30, "en", "s", 5), (2, "", "en", "s", 0), (3, "w" * 200_000, "en", None, 1), (3, "w" * 200_000, "en", None, 1), (4, "tie " * 40, "en", "s", 1), (5, "tie " * 40, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, q in list(queries.QUERIES.items())[:10]:  # those of documents
        n = q(spark, str(tmp_path)).count()
        assert n >= len(rows) if name == "op3_pack" else n == len(rows), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), queries.TOKENIZER).count() == 0
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
