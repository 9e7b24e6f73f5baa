"""Codings of cells, residues, numbers, words and dates; all are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- cells ----------------------------------------------------------------------


def pack(c: Column, bits: int) -> Column:
    """Whole numbers of so many bits (the low ones of each), side by side in bytes; the last byte is filled with zeros."""
    digits = F.array_join(F.transform(c, lambda x: F.lpad(F.bin(x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))), bits, "0")), "")
    size = F.ceil(F.length(digits) / 8).cast("int")
    full = F.rpad(digits, size * 8, F.lit("0"))
    byte = lambda i: F.lpad(F.conv(F.substr(full, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    return F.when(size == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), byte), "")))


def unpack(packed: Column, bits: int, n: Column) -> Column:
    """The first ``n`` numbers of ``pack``."""
    size = F.octet_length(packed)
    byte = lambda i: F.lpad(F.conv(F.hex(F.substr(packed, i + 1, F.lit(1))), 16, 2), 8, "0")
    digits = F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), byte), "")).otherwise(F.lit(""))
    number = lambda i: F.conv(F.substr(digits, i * bits + 1, F.lit(bits)), 2, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), number)).otherwise(F.array().cast("array<long>"))


def plus_row(c: Column, row_id: Column, sign: int = 1) -> Column:
    """Every element plus (or minus) the row's id."""
    return F.transform(c, lambda x: x + sign * row_id)


def exists(columns: Sequence[str], name: str, value, like: Column | None = None) -> Column:
    """The value, once or for each element of another cell, if the frame has that column; else an empty cell."""
    if name not in columns:
        return F.slice(F.array(F.lit(value)), 1, 0)
    return F.array(F.lit(value)) if like is None else F.array_repeat(F.lit(value), F.size(like))


def merge_cells(*cells: Column) -> Column:
    """(data, ends): cells of one row behind each other, and where each ends."""
    ends, at = [], F.lit(0)
    for c in cells:
        at = at + F.size(c)
        ends.append(at)
    return F.struct(F.concat(*cells).alias("data"), F.array(*ends).alias("ends"))


def all_finite(c: Column) -> Column:
    """Whether a cell of doubles has no null, NaN or infinite element."""
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def number_of(c: Column) -> Column:
    """Whole number of a text: decimal, hexadecimal after 0x, octal after 0; null where it is none."""
    low = F.lower(F.trim(c))
    return (
        F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(low, F.lit(3)), 16, 10).try_cast("long")).when(low.rlike("^0[0-7]+$"), F.conv(low, 8, 10).try_cast("long"))
        .when(low.rlike("^[+-]?[0-9]+$"), low.try_cast("long"))
    )


# --- residues -------------------------------------------------------------------

#: What each ambiguity letter stands for: fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Letters of the four-bit coding by value: fixed values.
NA4 = "-ACMGRSVTWYHKDBN"
#: Genetic codes by number, codons in TCAG order: fixed values.
CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def to_4na(seq: Column) -> Column:
    """Two letters a byte, the first in the high half; a last letter alone has an empty low half."""
    digits = F.translate(F.upper(seq), NA4, "0123456789ABCDEF")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def from_4na(packed: Column, n: Column) -> Column:
    return F.substr(F.translate(F.hex(packed), "0123456789ABCDEF", NA4), F.lit(1), n)


def to_2na(seq: Column) -> Column:
    """Four bases a byte, A 0, C 1, G 2, T 3; other letters are an error of the caller, filled up with A."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(seq) / 2).cast("int") - 1, F.lit(0))), lambda i: F.rpad(F.substr(F.translate(F.upper(seq), "ACGT", "0123"), i * 2 + 1, F.lit(2)), 2, "0"))
    digits = F.array_join(F.transform(pairs, lambda p: F.conv(p, 4, 16)), "")
    return F.unhex(F.when(F.length(seq) == 0, "").when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def from_2na(packed: Column, n: Column) -> Column:
    pairs = "AA AC AG AT CA CC CG CT GA GC GG GT TA TC TG TT".split()
    of = F.create_map(*[x for k, p in enumerate(pairs) for x in (F.lit(f"{k:X}"), F.lit(p))])
    return F.substr(F.array_join(F.transform(F.filter(F.split(F.hex(packed), ""), lambda x: x != ""), lambda x: F.element_at(of, x)), ""), F.lit(1), n)


def resolved(seq: Column, key: Column) -> Column:
    """Ambiguity letters replaced by one of the bases that they stand for, drawn by the key and the place; the same again for the same key."""
    sets = F.create_map(*[F.lit(v) for kv in IUPAC.items() for v in kv])

    def draw(letter: Column, i: Column) -> Column:
        own = F.coalesce(F.try_element_at(sets, F.upper(letter)), F.lit("N"))
        digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string")).cast("binary")), 1, 6)
        at = F.pmod(F.conv(digits, 16, 10).cast("long"), F.length(own)).cast("int")
        return F.substr(own, at + 1, F.lit(1))

    return F.array_join(F.transform(F.filter(F.split(seq, ""), lambda x: x != ""), draw), "")


def expression(c: Column, text: str) -> Column:
    """Whether a sequence fits patterns of base letters (ambiguous ones too) joined by ``&``, ``|``, ``!`` and parentheses."""
    tokens = re.findall(r"[A-Za-z]+|[&|!()]", text)
    if "".join(tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"can't read {text!r}")
    at = 0

    def take(*kinds: str) -> str | None:
        nonlocal at
        if at < len(tokens) and (tokens[at] in kinds or not kinds):
            at += 1
            return tokens[at - 1]
        return None

    def atom() -> Column:
        if take("!"):
            return ~atom()
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError("a parenthesis is open")
            return inner
        word = take()
        if word is None or not word.isalpha():
            raise ValueError(f"a pattern is missing in {text!r}")
        return F.upper(c).rlike("".join(f"[{IUPAC[x]}]" if len(IUPAC[x]) > 1 else x for x in word.upper().replace("U", "T")))

    def both() -> Column:
        out = atom()
        while take("&"):
            out = out & atom()
        return out

    def either() -> Column:
        out = both()
        while take("|"):
            out = out | both()
        return out

    found = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r}")
    return found


def spot_reads(lengths: Column, types: Column) -> Column:
    """(start, length, type) of each read of a spot, starts from 0 behind each other."""
    before = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    return F.transform(F.arrays_zip(before.alias("start"), lengths.alias("length"), types.alias("type")), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["type"].alias("type")))


def bio_start(reads: Column) -> Column:
    """Start of the first biological read; 0 where there is none."""
    return F.coalesce(F.get(F.filter(reads, lambda r: r["type"] == "biological"), F.lit(0))["start"], F.lit(0))


def technical_in_lower_case(seq: Column, reads: Column) -> Column:
    part = lambda r: F.substr(seq, r["start"] + 1, r["length"])
    return F.array_join(F.transform(reads, lambda r: F.when(r["type"] == "biological", F.upper(part(r))).otherwise(F.lower(part(r)))), "")


# --- locations: arrays of (lo, hi, strand) --------------------------------------


def location_length(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"] + 1)


def location_reversed(c: Column) -> Column:
    """The same places read on the other strand, in the order in which it has them."""
    return F.reverse(F.transform(c, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.translate(x["strand"], "+-", "-+").alias("strand"))))


def location_clipped(c: Column, lo: Column, hi: Column) -> Column:
    """Parts of a location within a range."""
    met = F.filter(c, lambda x: (x["lo"] <= hi) & (x["hi"] >= lo))
    return F.transform(met, lambda x: F.struct(F.greatest(x["lo"], lo).alias("lo"), F.least(x["hi"], hi).alias("hi"), x["strand"].alias("strand")))


# --- words ----------------------------------------------------------------------

#: Rules of a phonetic key in order, on upper-case words: fixed patterns, of those that begin alike the longer first. Codes are in lower case until the end, so that no rule meets them again.
_METAPHONE = (
    (r"[^A-Z]", ""), (r"([A-BD-Z])\1+", "$1"), (r"^(?:AE|GN|KN|PN|WR)", lambda m: m), (r"^X", "s"), (r"^WH", "w"), (r"MB$", "m"),
    (r"SCH", "sk"), (r"TCH", "x"), (r"C(?=IA)", "x"), (r"CH", "x"), (r"SC(?=[IEY])", "s"), (r"C(?=[IEY])", "s"), (r"CK", "k"), (r"[CQ]", "k"), (r"DG(?=[EYI])", "j"), (r"D", "t"),
    (r"GH(?=[^AEIOU]|$)", ""), (r"GN(?:ED)?$", "n"), (r"G(?=[IEY])", "j"), (r"G", "k"), (r"PH", "f"), (r"S(?:H|(?=I[OA]))", "x"), (r"TH(?=M)", "t"), (r"TH", "0"), (r"T(?=I[OA])", "x"),
    (r"V", "f"), (r"X", "ks"), (r"Z", "s"), (r"(?<=[AEIOU])H(?![AEIOU])", ""), (r"(?<=[sxkt0jfPGRT])H", ""), (r"[WY](?![AEIOU])", ""), (r"^[AEIOU]", "a"), (r"[AEIOU]", ""),
)


def metaphone(c: Column) -> Column:
    """Phonetic key of a word: the consonants by sound, a leading vowel as ``a``; at most as the rules above tell."""
    out = F.upper(c)
    for pattern, code in _METAPHONE:
        if callable(code):  # a silent first letter
            out = F.when(out.rlike(pattern), F.substr(out, F.lit(2))).otherwise(out)
        else:
            out = F.regexp_replace(out, pattern, code)
    return F.lower(out)


def word_score(a: Column, b: Column) -> Column:
    """Nearness of two words, larger is nearer: the longer one's length, less the edit distances of the words and of their phonetic keys."""
    return F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b) - F.levenshtein(metaphone(a), metaphone(b))


def joined(sep: str, *cols: Column) -> Column:
    """Texts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), sep)


def name_at(names: Column, name: Column, ignore_case: bool = False) -> Column:
    """Place from 0 of a name in a list; -1 where it isn't."""
    low = (lambda x: F.lower(x)) if ignore_case else (lambda x: x)
    return (F.array_position(F.transform(names, low), low(name)) - 1).cast("int")


def names_sorted(names: Column, ignore_case: bool = False) -> Column:
    """Names in order, of names that differ only by case the upper ones first."""
    if not ignore_case:
        return F.array_sort(names)
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.lower(x).alias("k"), x.alias("x")))), lambda p: p["x"])


#: Month names of dates: fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def format_date(d: Column, template: str) -> Column:
    """A partial date (year, month, day, text) by a template of ``%Y %y %M %D %N %n`` (year, its last two digits, month and day in two digits, month's name and its first three letters); unknown parts are empty, a date without year is its text."""
    two = lambda x: F.coalesce(F.lpad(x.cast("string"), 2, "0"), F.lit(""))
    month = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), d["month"] - 1), F.lit(""))
    year = F.lpad(d["year"].cast("string"), 4, "0")
    out = F.lit(template)
    for mark, value in (("%Y", year), ("%y", F.substring(year, -2, 2)), ("%M", two(d["month"])), ("%D", two(d["day"])), ("%N", month), ("%n", F.substring(month, 1, 3))):
        out = F.replace(out, F.lit(mark), value)
    return F.when(d["year"].isNull(), d["text"]).otherwise(out)


def position_bin(c: Column) -> Column:
    """Bin of a place from 0, below 50 for any place: single places, then fives, fifties and five hundreds, then one for the rest."""
    return (
        F.when(c < 10, c).when(c < 60, 10 + F.floor((c - 10) / 5)).when(c < 560, 20 + F.floor((c - 60) / 50)).when(c < 9560, 30 + F.floor((c - 560) / 500)).otherwise(48).cast("int")
    )
