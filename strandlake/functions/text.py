"""Text functions: keys, distances, similarity of term sets; built-in expressions but for the stemmer."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A short English stop list: fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


#: What stands between words: anything but letters and digits of any script.
NO_WORD = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), NO_WORD), lambda w: w != "")


def content_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: ~w.isin(*STOP_WORDS))


def hash17(c: Column) -> Column:
    """h = 17 h + c over the UTF-8 bytes as signed characters, modulo 2^64, as a signed long."""
    digits = F.hex(F.encode(c, "UTF-8"))
    byte = lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i)).cast("decimal(38,0)")
    mod, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
    n = (F.length(digits) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).when(n == 0, F.array().cast("array<int>"))
    step = lambda h, i: F.pmod(h * 17 + signed(i), mod).cast("decimal(38,0)")
    return F.aggregate(places, F.lit(0).cast("decimal(38,0)"), step, lambda h: F.when(h >= half, h - mod).otherwise(h)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def divergence(a: Column, b: Column) -> Column:
    """Share of places at which two strings of one length differ."""
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)
    return F.size(differ) / F.length(a)


def accession_parts(c: Column) -> tuple[Column, Column]:
    """Letters and digits of an accession."""
    return F.regexp_extract(c, r"^([A-Za-z]+)[#_]?(\d+)", 1), F.regexp_extract(c, r"^([A-Za-z]+)[#_]?(\d+)", 2)


def title_modifiers(c: Column) -> Column:
    """Map of the ``[key=value]`` parts of a title."""
    pairs = F.regexp_extract_all(c, F.lit(r"\[([^=\]]+)=([^\]]*)\]"), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\[([^=\]]+)=", 1), F.regexp_extract(p, r"=([^\]]*)\]", 1))))


def html_escape(c: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences of a stem."""
    kinds = "".join("v" if ch in "aeiou" or ch == "y" and k and stem[k - 1] not in "aeiou" else "c" for k, ch in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return bool(re.search("[aeiou]|(?<=.)y", stem))


#: Suffixes of the published algorithm's second to fourth steps: fixed values.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stem of a lower-case word, by the published algorithm."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    short = lambda s: bool(re.search("[^aeiou][aeiouy][^aeiouwxy]$", s))
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeioulsz])\1$", w):
                    w = w[:-1]
                elif _measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for end, new in sorted(steps, key=lambda s: -len(s[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def stem(s: pd.Series) -> pd.Series:
    return s.map(lambda w: None if w is None else porter(w))


def approximate_end(text: str, pattern: str) -> tuple[int, int]:
    """(edits, end) of the best place in a text for a pattern: fewest edits, then the first end, inclusive; end -1 before the text."""
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for k, ch in enumerate(pattern):
        new = np.concatenate(([k + 1], np.minimum(row[:-1] + (t != ord(ch)), row[1:] + 1)))
        row = np.minimum.accumulate(new - at) + at  # a text letter left out costs one for each place passed
    best = int(row.argmin())
    return int(row[best]), best - 1


def agrep(c: Column, pattern: str, most: int) -> Column:
    """End of the best match of a pattern with at most so many edits; null where there is none."""

    def run(s: pd.Series) -> pd.Series:
        found = [None if x is None else approximate_end(x, pattern) for x in s]
        return pd.Series([f[1] if f is not None and f[0] <= most else None for f in found], dtype="Int64")

    return F.pandas_udf(run, "long")(c)


def _quoted(x: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", x)


def fgrep(c: Column, patterns: Sequence[str]) -> Column:
    """Place from 0 of the first of these texts; -1 where none is."""
    return F.regexp_instr(c, F.lit("|".join(f"(?:{_quoted(p)})" for p in patterns))) - 1


def find_text(c: Column, what: str, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """Place from 0 of a text, perhaps whatever its case, or between characters that are none of a word; -1 where it is not."""
    p = ("(?i)" if ignore_case else "") + (rf"(?<!\w){_quoted(what)}(?!\w)" if whole_word else _quoted(what))
    return F.regexp_instr(c, F.lit(p)) - 1


def wildcard(c: Column, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> Column:
    """Whether a name fits one of the masks (``*`` any text, ``?`` any character) and none of the others."""
    regex = lambda m: "^" + "".join(".*" if ch == "*" else "." if ch == "?" else _quoted(ch) for ch in m) + "$"
    fits = lambda masks: c.rlike("|".join(regex(m) for m in masks)) if masks else F.lit(False)
    return fits(include) & ~fits(exclude)


def field_rule(value: Column, rule: Column) -> Column:
    """Whether a value fits a rule's expression, in which ``\\|``, ``\\(`` and ``\\)`` stand for the bare characters; no rule accepts all."""
    return rule.isNull() | F.coalesce(F.regexp_like(value, F.regexp_replace(rule, r"\\([|()])", "$1")), F.lit(False))


def compare_dates(a: Column, b: Column) -> Column:
    """before, same, after or unknown of (year, month, day, text) dates.

    Two with years compare by the parts, of which a missing one differs from any other in a way unknown; two equal texts are the same.
    """
    out = F.when(a["year"].isNull() | b["year"].isNull(), F.when(a["year"].isNull() & b["year"].isNull() & (a["text"] == b["text"]), "same").otherwise("unknown"))
    for part in ("year", "month", "day"):
        x, y = a[part], b[part]
        out = out.when(x < y, "before").when(x > y, "after").when(x.isNull() != y.isNull(), "unknown")
    return out.otherwise("same")


def ascii85(c: Column) -> Column:
    """Ascii85 of a text's UTF-8 bytes."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else base64.a85encode(x.encode()).decode()), "string")(c)


def fasta_id(c: Column) -> Column:
    """Map of the ``type|value`` pairs of a bar-separated id; an id without bars is ``lcl``."""
    p = F.filter(F.split(c, r"\|"), lambda x, i: (x != "") | (i % 2 == 1))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(p) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(p, 2 * i), F.get(p, 2 * i + 1)))
    return F.when(F.locate("|", c) == 0, F.create_map(F.lit("lcl"), c)).otherwise(F.map_from_entries(pairs))


def hgvs(c: Column) -> Column:
    """(accession, kind, start, stop, ref, alt) of a change such as ``NM_1.2:c.76A>T`` or ``NC_1.1:g.5_9del``; parts that it lacks are null."""
    p = r"^([^:]+):([cgmnpr])\.(-?\d+)(?:_(-?\d+))?(?:([ACGTU]+)>([ACGTU]+)|(delins|del|dup|ins|inv)([ACGTU]*))$"
    g = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return F.struct(g(1).alias("accession"), g(2).alias("kind"), g(3).cast("long").alias("start"), F.coalesce(g(4), g(3)).cast("long").alias("stop"), g(5).alias("ref"), F.coalesce(g(6), g(8)).alias("alt"), F.coalesce(g(7), F.when(g(6).isNotNull(), F.lit("sub"))).alias("op"))


#: Read names of five platforms, with their coordinates as groups: fixed patterns.
SPOT_NAMES = {
    "illumina": (r"^(.*?)[:_](\d+)[:_](\d+)[:_](-?\d+)[:_](-?\d+)(?:[#/ ].*)?$", ("name", "lane", "tile", "x", "y")),
    "abi": (r"^(?:(.*)_)?(\d+)_(\d+)_(\d+)$", ("name", "panel", "x", "y")),
    "ion_torrent": (r"^([A-Z0-9]+):(\d+):(\d+)$", ("name", "row", "col")),
    "454": (r"^(.{7})([0-9]{2})([A-Z0-9]{5})$", ("name", "region", "xy")),
    "helicos": (r"^(.+)-([0-9]+)-([0-9]+)-([0-9]+)-([0-9]+)$", ("name", "channel", "field", "camera", "position")),
}


def spot_tokens(c: Column, platform: str) -> Column:
    """(name, start, length) of each coordinate of a read's name, in order; none of a name in another form."""
    pattern, names = SPOT_NAMES[platform]
    kind = "array<struct<name:string,start:int,length:int>>"
    groups = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract(c, pattern, k).alias("g")) for k, n in enumerate(names, 1)])

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.position(x["g"], F.substr(c, acc["at"] + 1)) - 1).alias("start")
        return F.struct(start, F.length(x["g"]).alias("length"), x["name"].alias("name"), acc["out"].alias("out"))

    def kept(x: Column) -> Column:  # places are told once a group, so no group's expression holds those before it
        return F.struct((x["start"] + x["length"]).alias("at"), F.concat(x["out"], F.array(F.struct(x["name"].alias("name"), x["start"].alias("start"), x["length"].alias("length")))).alias("out"))

    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    out = F.aggregate(groups, zero, lambda acc, x: let(step(acc, x), kept), lambda acc: acc["out"])
    return F.when(~F.regexp_like(c, F.lit(pattern)), F.array().cast(kind)).otherwise(out)


def extract_token(c: Column, tokens: Column, k: int) -> Column:
    """Text of a token; empty where there is no such one."""
    t = F.get(tokens, F.lit(k))
    return F.coalesce(F.substr(c, t["start"] + 1, t["length"]), F.lit(""))


def rewrite_name(c: Column, tokens: Column, template: str) -> Column:
    """The template with ``$name`` put for each token's text."""
    named = lambda n: lambda x: x["name"] == n
    out = F.lit(template)
    for n in sorted({n for _, names in SPOT_NAMES.values() for n in names}, key=lambda n: (-len(n), n)):
        hit = F.filter(tokens, named(n))
        out = F.replace(out, F.lit(f"${n}"), F.when(F.size(hit) > 0, extract_token(c, hit, 0)).otherwise(F.lit(f"${n}")))
    return out
