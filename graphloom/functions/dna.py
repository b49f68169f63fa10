"""Column functions on DNA strings and on linear base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGT"
# IUPAC codes by bits A=1, C=2, G=4, T=8, and the complements of all codes.
IUPAC = ".ACMGRSVTWYHKDBN"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYKMBDHV", "TGCAYRMKVHDB"
QUAL_BASE = 33


def encode_seq(text: Column) -> Column:
    """Any text as DNA: its ASCII letters, upper case, dealt onto ACGT in turn."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, (BASES * 7)[:26])


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; of plain bases only."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def count_of(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits over ACGT; other letters count for the length only."""
    share = [count_of(seq, b) / F.length(seq) for b in BASES]
    return F.when(F.length(seq) > 0, -sum((F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))).otherwise(0.0)


def iupac_code(bits: Column) -> Column:
    """Letter of a 4-bit set of bases."""
    return F.substring(F.lit(IUPAC), bits.cast("int") + 1, F.lit(1))


def iupac_bits(letter: Column) -> Column:
    """4-bit set of a letter in either case; unknown letters: 0."""
    return F.greatest(F.position(F.upper(letter), F.lit(IUPAC)) - 1, F.lit(0))


def iupac_overlap(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def qual_char(score: Column, low: int, high: int) -> Column:
    """Score in 0..1 as a character, linear between low and high; over 1 counts as 1."""
    return F.char(F.floor(F.least(score, F.lit(1.0)) * (high - low) + QUAL_BASE + low).cast("int"))


def qual_score(char: Column, low: int, high: int) -> Column:
    return F.least((F.ascii(char) - QUAL_BASE - low) / float(high - low), F.lit(1.0))


def clamp_qual(qual: Column, high: int) -> Column:
    """Each character brought between 33 and 33 + high."""
    chars = F.filter(F.split(qual, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.char(F.least(F.greatest(F.ascii(c), F.lit(QUAL_BASE)), F.lit(QUAL_BASE + high)))), "")


def mean_qual(qual: Column, low: int, high: int) -> Column:
    """Mean score of a string, 0 if it is empty."""
    chars = F.filter(F.split(qual, ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, lambda c: qual_score(c, low, high)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.length(qual) > 0, total / F.length(qual)).otherwise(0.0)


def all_bases_reach(seq: Column, qual: Column, least: int) -> Column:
    """Whether every plain base has at least the quality; other letters don't count."""
    pairs = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda s, q: (~s.isin(*BASES)) | (F.ascii(q) >= least))
    return F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(True)))


def length_window(length: Column, share: float) -> tuple[Column, Column]:
    low = F.greatest((length - length * share).cast("long"), F.lit(1).cast("long"))
    return low, F.greatest((length + length * share).cast("long"), F.lit(1).cast("long"))


def floor_log2(value: Column) -> Column:
    return F.floor(F.log2(value)).cast("long")


def rounded_coverage(total: Column, n: Column) -> Column:
    """Half away from zero, within 0 and 2^31 - 1."""
    return F.least(F.greatest(F.round(total / n), F.lit(0.0)), F.lit(2147483647.0)).cast("long")


def valid_haplotype(haps: Column, hap: Column) -> Column:
    return (F.size(haps) == 0) | F.array_contains(haps, hap)


def fastq(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def plain_bases(seq: Column, name: Column) -> Column:
    """IUPAC letters and others replaced by a base drawn from a hash of the name and the place."""
    drawn = lambda c, i: F.when(c.isin(*BASES), c).otherwise(F.substring(F.lit(BASES), (F.pmod(F.xxhash64(name, i), F.lit(4)) + 1).cast("int"), F.lit(1)))
    return F.array_join(F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), drawn), "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many letters two strings have in common from their starts; null if either is null."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    part = F.array_position(same, F.lit(False)).cast("int")
    return F.when(part == 0, F.length(a)).when((a == "") | (b == ""), 0).otherwise(part - 1)
