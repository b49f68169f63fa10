import random

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.plans import pipeline
from graphloom.sources import fastx, store


def drawn(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def vertices(spark):
    tigs = spark.createDataFrame([(5, "ACGTTGCAA", 5), (9, "GGCTAATC", 4)], "unitig_id long, seq string, n_kmers int")
    links = spark.createDataFrame([(1, 2, "A")], "u long, v long, ext string")
    parts = {
        "pairs": spark.createDataFrame([(5, 1), (5, 2), (9, 2)], "unitig_id long, color long"),
        "stats": spark.createDataFrame([(5, 3.0, False), (9, 1.0, True)], "unitig_id long, cov double, branching boolean"),
        "snps": spark.createDataFrame([(9, 2, 5)], "unitig_id long, pos int, bases int"),
        "haplotypes": spark.createDataFrame([(5, 7)], "unitig_id long, hap_id long"),
        "cycles": spark.createDataFrame([(5, "AC")], "unitig_id long, cycle string"),
    }
    return tigs, links, parts


def rows(df, like=None):
    return sorted(map(tuple, df.select(*(like or df).columns).collect()))


def test_store_gives_back_what_it_got(spark, tmp_path):
    tigs, links, parts = vertices(spark)
    store.write_store(tigs, links, 5, f"{tmp_path}/g", **parts)
    k, tigs2, links2, parts2 = store.read_store(spark, f"{tmp_path}/g", store.PARTS)
    assert k == 5 and rows(tigs2) == rows(tigs) and rows(links2) == rows(links)
    assert {n: rows(parts2[n], p) for n, p in parts.items()} == {n: rows(p) for n, p in parts.items()}
    index = {r.kmer: (r.unitig_id, r.dist, r.strand) for r in store.index_of(tigs2, 5).collect()}
    assert index["ACGTT"] == (5, 0, True) and index["AACGT"] == (5, 0, False) and index["TAATC"] == (9, 3, True) and len(index) == 16  # TTGCA and TGCAA are one k-mer


def test_store_refuses_what_does_not_fit(spark, tmp_path):
    tigs, links, parts = vertices(spark)
    with pytest.raises(ValueError):
        store.write_store(tigs, links, 5, f"{tmp_path}/g", colours=parts["pairs"])
    store.write_store(tigs, links, 5, f"{tmp_path}/g", **parts)
    spark.createDataFrame([(1, "TTTTT")], "color long, head string").write.mode("append").parquet(f"{tmp_path}/g/pairs")
    with pytest.raises(ValueError):
        store.read_store(spark, f"{tmp_path}/g")
    assert rows(store.read_store(spark, f"{tmp_path}/g", ("stats",))[3]["stats"], parts["stats"]) == rows(parts["stats"])
    tigs.withColumn("head", F.substring("seq", 1, 5)).withColumn("k", F.lit(7)).write.mode("append").parquet(f"{tmp_path}/g/vertices")
    with pytest.raises(ValueError):
        store.read_store(spark, f"{tmp_path}/g", ())


def test_fastq_is_numbered_across_splits(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{f}{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@III' * (i % 7 + 1)}\n" for i in range(400)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = fastx.numbered_lines(spark, [f"{tmp_path}/a.fastq", f"{tmp_path}/b.fastq"])
        assert spark.read.text(f"{tmp_path}/a.fastq").rdd.getNumPartitions() > 3
        got = fastx.read_fastx(spark, [f"{tmp_path}/a.fastq", f"{tmp_path}/b.fastq"]).collect()
        assert lines.where("n % 4 = 0 and not startswith(value, '@')").count() == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.name, r.seq, r.qual, r.ord) for r in got) == sorted((f"{f}{i}", "ACGT" * (i % 7 + 1), "@III" * (i % 7 + 1), i) for f in "ab" for i in range(400))


def test_command_line(spark, tmp_path):
    for bad in (["correct", "-s", "x", "-o", "y"], ["index", "-s", "x", "-o", "y"], ["index", "-1", "-s", "x", "-o", "y", "-k", "30"], ["index", "-1", "-s", "x", "-o", "y", "-S", "0"], ["correct", "-1", "-2", "-l", "x", "-o", "y", "-g", "g"], ["correct", "-2", "-l", "x", "-o", "y"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    genome = drawn(300, 8)
    noisy = genome[:150] + "ACGT".replace(genome[150], "")[0] + genome[151:]
    (tmp_path / "s.fasta").write_text("".join(f">r{i}\n{genome[i : i + 80]}\n" for i in range(0, 221, 10)))
    (tmp_path / "l.fastq").write_text(f"@b\n{noisy}\n+\n{'I' * 300}\n@a\n{genome[:200]}\n+\n{'I' * 200}\n")
    cli.main(["index", "-1", "-s", f"{tmp_path}/s.fasta", "-o", f"{tmp_path}/g", "-k", "15", "-K", "31"])
    assert spark.read.parquet(f"{tmp_path}/g/first/vertices").count() == 1 and spark.read.parquet(f"{tmp_path}/g/long_unitigs").count() == 1
    cli.main(["correct", "-1", "-g", f"{tmp_path}/g", "-l", f"{tmp_path}/l.fastq", "-o", f"{tmp_path}/out", "-k", "15", "-K", "31"])
    text = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert text[1::4] == [genome, genome[:200]] and text[0::4] == ["@b", "@a"]


def test_unitigs_side_by_side(spark):
    a, r, b, c, d = (drawn(40, i) for i in range(5))
    r = r[:20]  # longer than k, shorter than k2
    short = spark.createDataFrame([(x,) for x in (a + r + b, a + r + b, c + r + d, c + r + d)], "seq string")
    (tigs, index), (long_tigs, _) = pipeline.both_unitigs(short, pipeline.Params(k=15, k2=31))
    got = {frozenset((x.u, x.v)) for x in pipeline.side_by_side(long_tigs, index, 15).collect()}
    name = {k.kmer: k.unitig_id for k in index.collect()}
    tig = lambda s: name[s[:15]]
    assert long_tigs.count() == 2 and tigs.count() == 5
    assert got == {frozenset((tig(x), tig(r))) for x in (a, b, c, d)}


def test_unmapped_reads_are_rescued(spark):
    long, known = drawn(400, 1), drawn(100, 2)
    short = spark.createDataFrame([("k", known), ("k2", known)], "name string, seq string")
    unmapped = spark.createDataFrame([("new", long[100:180].lower()), ("known", known), ("few", long[:60]), ("n", "N" * 80), ("none", None)], "name string, seq string")
    got = pipeline.rescued_reads(unmapped, short, spark.createDataFrame([(long + known,)], "seq string"), pipeline.Params())
    assert [(r.name, r.seq) for r in got.collect()] == [("new", long[100:180])]
