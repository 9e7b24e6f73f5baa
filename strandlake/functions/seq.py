"""Sequence functions: built-in expressions over strings of residues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in TCAG order: fixed values.
CODE_1 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"))


def count_of(c: Column, residues: str) -> Column:
    """How many characters are among these, by what translate leaves out."""
    return F.length(c) - F.length(F.translate(c, residues, ""))


def percent_gc(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.floor(100 * count_of(c, "GCSgcs") / F.length(c)))


def kmers(c: Column, k: int) -> Column:
    """All substrings of k characters, in order."""
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def nmer_code(c: Column) -> Column:
    """Base 4 number of a word, G 0, A 1, T 2, C 3."""
    return F.conv(F.translate(F.upper(c), "GATC", "0123"), 4, 10).cast("long")


def translate_dna(c: Column, code: str = CODE_1) -> Column:
    """Amino acids of consecutive codons; X where a codon isn't of ACGT."""
    digits = F.translate(F.upper(c), "TCAGU", "01230")
    n = F.floor(F.length(c) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, (i * 3 + 1).cast("int"), F.lit(3)))
    acid = lambda d: F.when(d.rlike("^[0-3]{3}$"), F.substring(F.lit(code), (F.conv(d, 4, 10).cast("int") + 1), F.lit(1))).otherwise("X")
    return F.when(n > 0, F.array_join(F.transform(codons, acid), "")).otherwise("")


def jukes_cantor(p: Column) -> Column:
    return -0.75 * F.ln(1 - 4 * p / 3)


def poisson(p: Column) -> Column:
    return -F.ln(1 - p)


def kimura(p: Column) -> Column:
    return -F.ln(1 - p - 0.2 * p * p)


def grishin(p: Column) -> Column:
    return p * (2 + p) / (2 * (1 - p))


def cigar_ops(c: Column) -> Column:
    """(n, op) of each part of a CIGAR string."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("n"), F.substring(p, -1, 1).alias("op")))


def reference_span(c: Column) -> Column:
    """Reference positions that a CIGAR string covers."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda s, n: s + n.cast("int"))
