"""Scalars over sequencing reads: colours, flags, qualities, intensities, repeats, ambiguous matches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.cells import flat

#: Letters of the sixteen sets of bases, each at the place that its bit mask gives: fixed values.
IUPAC = "ACMGRSVTWYHKDBN"
#: Flag bits of alignment records: fixed values.
SAM_BITS = {
    "paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first": 64, "last": 128, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048,
}


def letters(c: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def base_code(b: Column) -> Column:
    """A 0, C 1, G 2, T 3, anything else 4."""
    at = F.position(F.upper(b), F.lit("ACGT"))
    return F.when(at == 0, 4).otherwise(at - 1)


def color_from_dna(seq: Column, primer: str = "A") -> Column:
    """Colours of successive pairs of bases, the first with the primer's; 4 where either base is unknown."""
    codes = lambda x: F.transform(letters(x), base_code)
    before = codes(F.substr(F.concat(F.lit(primer), seq), F.lit(1), F.length(seq)))
    return F.zip_with(before, codes(seq), lambda x, y: F.when((x == 4) | (y == 4), 4).otherwise(x.bitwiseXOR(y)))


def dna_from_color(colors: Column, primer: str = "A") -> Column:
    """Bases of colours; from a colour of 4 on, all are N."""
    start = "ACGT".find(primer.upper())
    letter = np.frombuffer(b"ACGTN", np.uint8)

    def run(cells: pd.Series) -> pd.Series:
        c, at = flat(cells)
        c = c.astype(np.int64)
        lost = np.cumsum((c > 3) | (start < 0))
        lost = lost - np.repeat(np.concatenate(([0], lost))[at[:-1]], np.diff(at)) > 0
        seen = np.concatenate(([0], np.bitwise_xor.accumulate(c & 3))) if len(c) else np.zeros(1, np.int64)
        bases = letter[np.where(lost, 4, seen[1:] ^ np.repeat(seen[at[:-1]], np.diff(at)) ^ max(start, 0))].tobytes().decode()
        return pd.Series([None if x is None else bases[a:b] for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), cells)], dtype=object)

    return F.pandas_udf(run, "string")(colors)


def sam_flags(**bits: Column) -> Column:
    """Flag number of named conditions; null counts as false."""
    out = F.lit(0)
    for name, c in bits.items():
        out = out + F.when(c, SAM_BITS[name]).otherwise(0)
    return out


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(SAM_BITS[name])) != 0


def quantizer(spec: str) -> list[int]:
    """256 levels of ``value:limit`` parts: qualities below a limit and not below the one before become the value; ``-`` is no limit."""
    table, begin = [0] * 256, 0
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+|-)\s*", part)
        if m is None:
            raise ValueError(f"bad quantizer part: {part!r}")
        end = 256 if m[2] == "-" else int(m[2])
        if not begin <= end <= 256:
            raise ValueError(f"limits of a quantizer must rise to 256 at most: {spec!r}")
        table[begin:end] = [int(m[1])] * (end - begin)
        begin = end
        if m[2] == "-":
            break
    return table


def quantize(q: Column, spec: str) -> Column:
    table = F.array(*[F.lit(v) for v in quantizer(spec)])
    return F.transform(q, lambda x: F.get(table, x.cast("int")))


def phred(qual: Column) -> Column:
    """Numbers of a quality string with offset 33."""
    return F.transform(letters(qual), lambda x: F.ascii(x) - 33)


def swap(v: Column, called: Column) -> Column:
    """A 4-vector with its first element and the one of the called base exchanged."""
    return F.when(called.between(1, 3), F.transform(v, lambda x, i: F.when(i == 0, F.get(v, called)).when(i == called, F.get(v, F.lit(0))).otherwise(x))).otherwise(v)


def normalize(v: Column, called: Column, sign: int = -1) -> Column:
    """The second of a pair less its first: elements 1 and 0 when 0 (or no base) is called, 3 and 2 when 2 is."""
    pair = F.when(called == 2, 3).when(called.isin(1, 3), -1).otherwise(1)
    return F.transform(v, lambda x, i: F.when(i == pair, x + sign * F.get(v, i - 1)).otherwise(x))


def denormalize(v: Column, called: Column) -> Column:
    return normalize(v, called, 1)


def circular_offset(offset: Column, length: Column, circular: Column) -> Column:
    """Place on a sequence; outside a linear one it is an error. A circular place equal to the length stays as it is."""
    bad = F.raise_error(F.concat(F.lit("offset out of range: "), offset.cast("string"))).cast("long")
    return (
        F.when(~circular & ((offset < 0) | (offset >= length)), bad).when(offset < 0, length - (-offset) % length)
        .when(circular & (offset > length), offset % length).otherwise(offset)
    )


def restrict_read(start: Column, length: Column, biological: Column, trim_start: Column, trim_length: Column, cut: bool = True) -> Column:
    """(start, stop) of a read within the trim window; null for technical reads, those outside it, and, under ``cut``, spans of 25 or less."""
    stop, trim_stop = start + length, trim_start + trim_length
    lo, hi = F.greatest(start, trim_start), F.least(stop, trim_stop)
    ok = biological & ~((stop < trim_start) | (start > trim_stop))
    return F.when(ok & ((hi - lo > 25) if cut else F.lit(True)), F.struct(lo.alias("start"), hi.alias("stop")))


def match_spans(c: Column, pattern: str) -> Column:
    """(start, stop) from 0, both inclusive, of the matches of a pattern that matches no empty text, in order and apart."""
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

    def span(m: Column, i: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
        at = total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
        return F.struct(at.alias("start"), (at + F.length(m) - 1).alias("stop"))

    return F.transform(found, span)


def repeats_of(c: Column, pattern: str, least: int) -> Column:
    """Spans where what the pattern matches comes ``least`` times or more in a row."""
    return match_spans(c, f"({pattern})\\1{{{least - 1},}}")


def nmer_repeats(c: Column, n: int, least: int) -> Column:
    return repeats_of(c, f"[acgtACGT]{{{n}}}", least)


def base_mask(b: Column) -> Column:
    """Bit set of a base letter: A 1, C 2, G 4, T 8; 0 for no base."""
    return F.position(F.upper(b), F.lit(IUPAC))


def match_at(seq: Column, pattern: str, at: Column) -> Column:
    """yes, maybe or no: whether the sequence from ``at`` (0-based) must, may or can't match the pattern of base letters."""
    states = []
    for k, q in enumerate(pattern.upper()):
        mask = IUPAC.index(q) + 1
        s = base_mask(F.substring(seq, (at + k + 1).cast("int"), F.lit(1)))
        states.append(F.when(s.bitwiseAND(F.lit(mask)) == 0, 0).when(s.bitwiseAND(F.lit(15 ^ mask)) == 0, 2).otherwise(1))
    least = F.least(*states) if len(states) > 1 else states[0]
    return F.when(least == 2, "yes").when(least == 1, "maybe").otherwise("no")


def find_matches(seq: Column, pattern: str, kind: str) -> Column:
    """Places from 0 where the pattern matches with this outcome."""
    places = F.when(F.length(seq) >= len(pattern), F.sequence(F.lit(0), F.length(seq) - len(pattern))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: match_at(seq, pattern, i) == kind)


def rle_text(c: Column) -> Column:
    """Runs as a character and its count; a count of 1 is left out."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(.)\1*"), F.lit(0)), lambda r: F.concat(F.substring(r, 1, 1), F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(""))), "")


def rle_text_back(c: Column) -> Column:
    """The text of such runs; its characters aren't digits."""
    n = lambda r: F.when(F.length(r) > 1, F.substring(r, F.lit(2), F.length(r)).cast("int")).otherwise(1)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\D\d*"), F.lit(0)), lambda r: F.repeat(F.substring(r, 1, 1), n(r))), "")


def global_place(ref_row: Column, offset: Column, first_row: Column, width: int) -> Column:
    """Place on a whole reference of an offset in one of its rows of ``width`` bases."""
    return (ref_row - first_row) * width + offset


def local_row(place: Column, width: int) -> Column:
    """Row from 1 that holds a place of the concatenated references."""
    return F.floor(place / width) + 1


def local_place(place: Column, width: int) -> Column:
    return place % width
