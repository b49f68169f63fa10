import pytest
from pyspark.sql import functions as F

from graphloom.functions import align, dna


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_qualities(spark):
    s = [0.0, 0.5, 0.9, 1.0, 1.7]
    assert one(spark, *(dna.qual_char(F.lit(x), 0, 40) for x in s)) == ("!", "5", "E", "I", "I")
    assert one(spark, *(dna.qual_char(F.lit(x), 1, 40) for x in s)) == ('"', "5", "E", "I", "I")
    assert one(spark, *(dna.qual_score(F.lit(c), 0, 40) for c in "I!J5")) == (1.0, 0.0, 1.0, 0.5)
    assert one(spark, dna.clamp_qual(F.lit("!5~"), 40), dna.mean_qual(F.lit("I!"), 0, 40), dna.mean_qual(F.lit(""), 0, 40)) == ("!5I", 0.5, 0.0)
    assert one(spark, dna.all_bases_reach(F.lit("ANG"), F.lit("I!I"), 73), dna.all_bases_reach(F.lit("AAG"), F.lit("I!I"), 73)) == (True, False)


def test_entropy_and_windows(spark):
    assert one(spark, *(F.round(dna.entropy(F.lit(x)), 6) for x in ("ACGT", "AAAA", "AACC", "ACGN"))) == (2.0, 0.0, 1.0, 1.5)
    for n, want in ((100, (75, 125)), (1, (1, 1)), (0, (1, 1)), (7, (5, 8))):
        assert one(spark, *dna.length_window(F.lit(n), 0.25)) == want
    assert one(spark, dna.floor_log2(F.lit(9)), dna.rounded_coverage(F.lit(5), F.lit(2))) == (3, 3)


def test_strands_and_codes(spark):
    assert one(spark, dna.revcomp(F.lit("ACGTRN")), dna.canonical(F.lit("AACCG"))) == ("NYACGT", "AACCG")
    codes = one(spark, *(dna.iupac_code(F.lit(i)) for i in range(1, 16)))
    assert codes == tuple("ACMGRSVTWYHKDBN")
    assert one(spark, *(dna.iupac_bits(F.lit(c)) for c in (*codes, "x", "a"))) == (*range(1, 16), 0, 1)
    assert one(spark, dna.plain_bases(F.lit("ACNRT"), F.lit("r")))[0][:2] == "AC"
    assert one(spark, dna.valid_haplotype(F.array().cast("array<int>"), F.lit(1)), dna.valid_haplotype(F.array(F.lit(2)), F.lit(1))) == (True, False)


@pytest.mark.parametrize(
    ("q", "t", "mode", "dist", "ends"),
    [
        ("AACT", "AACTGGC", "NW", 3, [6]), ("AACT", "AACTGGC", "SHW", 0, [3]), ("ACT", "CGACTGAC", "HW", 0, [4]),
        ("ARCT", "AGCT", "NW", 0, [3]), ("ANCT", "ATCT", "NW", 0, [3]), ("AMCT", "ARCT", "NW", 1, [3]),
        ("ACGT", "TTACGGTT", "SHW", 3, [0, 1, 4, 5, 6]), ("", "ACGTA", "NW", 5, [4]), ("ACGTA", "", "HW", 5, [-1]), ("", "ACG", "SHW", 0, [-1]),
    ],
)
def test_alignments(q, t, mode, dist, ends):
    got = align.align(q, t, mode)
    assert got["dist"] == dist
    assert got["ends"] == ends if mode != "SHW" or dist != 3 else set(got["ends"]) >= {4, 5, 6}


def test_cigars():
    got = align.align("ACGT", "AGGTT")
    assert got["cigar"].count("X") == 1 and got["dist"] == 2
    assert align.standard_cigar("2=1X3I") == "3M3I"
    assert align.slice_cigar("2=1D2=", 2, 4) == (2, 3)


def test_alignment_column(spark):
    df = spark.createDataFrame([("AACT", "AACTGGC"), (None, "A")], "a string, b string").withColumn("x", align.alignment(F.col("a"), F.col("b"), "SHW"))
    assert [r.x.dist for r in df.collect()] == [0, None]


def test_common_prefix(spark):
    rows = [("abc", "abd", 2), ("", "x", 0), ("", "", 0), ("ab", "abc", 2), ("abc", "abc", 3), ("x", "y", 0), (None, "a", None)]
    got = spark.createDataFrame(rows, "a string, b string, n int").select("n", dna.common_prefix(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.n for r in got]


def test_best_aligned_cuts_and_takes_the_first(spark):
    rows = [(1, 5, "ACGT", "ACGTTT"), (1, 3, "ACGT", "ACGTTT"), (1, 4, "", "ACGTTT"), (1, 2, None, "ACGTTT"), (2, 1, "GGGG", "ACAC"), (3, 1, "GTT", "ACGTTT")]
    df = spark.createDataFrame(rows, "g int, o int, t string, r string")
    assert sorted((r.g, r.score, r.order) for r in align.best_aligned(df, ["g"], "t", "r", "o", "SHW", 0.5).collect()) == [(1, 0.0, 3)]
    assert sorted((r.g, r.score, r.order) for r in align.best_aligned(df, ["g"], "t", "r", "o", "HW", 0.5).collect()) == [(1, 0.0, 3), (3, 0.0, 1)]


def test_many_alignments_at_once(spark):
    import random

    from graphloom.functions import align

    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("ACGTN", k=n))
    pairs = [(word(rng.randrange(30)), word(rng.randrange(40))) for _ in range(300)] + [("ACGT", "é"), ("A" * 500, "C" * 700), (None, "A"), ("A", None)]
    some = [p for p in pairs if p[0] and p[1]]
    assert all((a == align.matrix(*p, True)).all() for p, a in zip(some, align.matrices(some, True, 5000), strict=True))
    df = spark.createDataFrame(pairs, "q string, t string").repartition(2)
    for mode in ("NW", "SHW", "HW"):
        for r in df.select("q", "t", align.alignment(F.col("q"), F.col("t"), mode).alias("x"), align.distance(F.col("q"), F.col("t"), mode).alias("y")).collect():
            if r.q is None or r.t is None:
                assert r.x.dist is None and r.y.dist is None
            else:
                assert r.x.asDict() == align.align(r.q, r.t, mode) and (r.y.dist, r.y.ends) == (r.x.dist, r.x.ends)
