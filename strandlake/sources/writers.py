"""Writers of delimited formats: one string column by built-in expressions, then Spark's text sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import dealt
from strandlake.sources.readers import BED, SAM, percent_encoded, text_or_dot


def _line(*cols: Column) -> Column:
    return F.concat_ws("\t", *[text_or_dot(c) for c in cols]).alias("value")


def bed_lines(df: DataFrame) -> DataFrame:
    """The columns of ``readers.BED`` as BED rows; columns that the frame lacks, and a row's nulls at its end, are left out."""
    lists = ("block_sizes", "block_starts")
    cells = F.array(*[F.array_join(F.col(c).cast("array<string>"), ",") if c in lists else F.col(c).cast("string") for c, _ in BED if c in df.columns])
    last = F.array_max(F.transform(cells, lambda x, i: F.when(x.isNotNull(), i + 1)))
    return df.select(F.array_join(F.slice(cells, F.lit(1), F.greatest(last, F.lit(3))), "\t", ".").alias("value"))


def gff3_lines(df: DataFrame) -> DataFrame:
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(percent_encoded(e["key"]), F.lit("="), percent_encoded(e["value"]))), ";")
    return df.select(_line(*[F.col(c) for c in ("seqid", "source", "type", "start", "stop", "score", "strand", "phase")], attrs))


def gtf_lines(df: DataFrame) -> DataFrame:
    attrs = F.concat(F.lit('gene_id "'), F.coalesce("gene_id", F.lit("")), F.lit('"; transcript_id "'), F.coalesce("transcript_id", F.lit("")), F.lit('";'))
    return df.select(_line(*[F.col(c) for c in ("seqid", "source", "type", "start", "stop", "score", "strand", "phase")], attrs))


def vcf_lines(df: DataFrame) -> DataFrame:
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return df.select(_line(F.col("chrom"), F.col("pos"), F.col("id"), F.col("ref"), F.array_join("alt", ","), F.col("qual"), F.array_join("filter", ";"), info))


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "id", "title")), F.when(F.length("seq") > 0, F.concat(F.lit("\n"), body)).otherwise("")).alias("value"))


def wiggle_lines(df: DataFrame, width: int = 1 << 20) -> DataFrame:
    """variableStep blocks of (chrom, span), rows in order of position within a block; a block holds one range of ``width`` positions."""
    rows = df.select("chrom", "span", "pos", "value", F.floor(F.col("pos") / width).alias("_range"))
    block = dealt(rows, "chrom", "span", "_range", rows=1 << 18).groupBy("chrom", "span", "_range").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    head = F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(" span="), F.col("span").cast("string"))
    return block.select(F.concat_ws("\n", head, F.array_join(F.transform("v", lambda x: F.concat_ws(" ", x["pos"].cast("string"), x["value"].cast("string"))), "\n")).alias("value"))


def sam_lines(df: DataFrame) -> DataFrame:
    """Alignment rows; ``tags`` (tag, type, value), where the frame has them, follow the fixed fields."""
    fixed = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*" if kind == "string" else "0")) for c, kind in SAM])
    if "tags" not in df.columns:
        return df.select(fixed.alias("value"))
    return df.select(F.concat_ws("\t", fixed, F.transform("tags", lambda x: F.concat_ws(":", x["tag"], x["type"], x["value"]))).alias("value"))


def agp_lines(df: DataFrame) -> DataFrame:
    """Rows as ``read_agp`` gives them: columns 6 to 9 tell the component, or the gap."""
    pairs = (("component", "gap_length"), ("comp_beg", "gap_type"), ("comp_end", "linkage"), ("orientation", "evidence"))
    own = [F.coalesce(F.col(a).cast("string"), F.col(b).cast("string")) for a, b in pairs]
    return df.select(_line(*[F.col(c) for c in ("object", "obj_beg", "obj_end", "part", "type")], *own))


def gvf_lines(df: DataFrame) -> DataFrame:
    return gff3_lines(df)


def feature_table_lines(df: DataFrame) -> DataFrame:
    """One five-column text a feature: spans, the first with the type, then qualifiers."""
    at = lambda s: F.when(s["strand"] == "-", F.concat_ws("\t", s["stop"].cast("string"), s["start"].cast("string"))).otherwise(F.concat_ws("\t", s["start"].cast("string"), s["stop"].cast("string")))
    spans = F.transform("spans", lambda s, i: F.when(i == 0, F.concat_ws("\t", at(s), F.col("type"))).otherwise(at(s)))
    quals = F.transform("qualifiers", lambda q: F.concat(F.lit("\t\t\t"), F.concat_ws("\t", q["key"], q["value"])))
    return df.select(F.array_join(F.concat(spans, quals), "\n").alias("value"))


def mask_lines(spans: DataFrame, form: str = "interval") -> DataFrame:
    """Masked stretches (seqid, lo, hi), from 0 and inclusive, of each sequence in order: interval (``>id`` and lines ``lo - hi``) or acclist (``id lo hi``, a row each)."""
    if form == "acclist":
        return spans.select(_line(F.col("seqid"), F.col("lo"), F.col("hi")))
    if form != "interval":
        raise ValueError(f"unknown form {form!r}; there are interval, acclist")
    s = spans.groupBy("seqid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    return s.select(F.concat_ws("\n", F.concat(F.lit(">"), "seqid"), F.array_join(F.transform("s", lambda x: F.concat_ws(" - ", x["lo"].cast("string"), x["hi"].cast("string"))), "\n")).alias("value"))


def masked_fasta(seqs: DataFrame, spans: DataFrame, hard: bool = False) -> DataFrame:
    """(id, title, seq) with masked stretches in lower case, or as N."""
    s = spans.groupBy(F.col("seqid").alias("id")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    part = lambda lo, hi: F.substr(F.col("seq"), lo + 1, hi - lo + 1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        lo = F.greatest(x["lo"].cast("long"), acc["at"])
        body = part(lo, x["hi"].cast("long"))
        return F.when(x["hi"] < acc["at"], acc).otherwise(F.struct((x["hi"].cast("long") + 1).alias("at"), F.concat(acc["t"], part(acc["at"], lo - 1), F.repeat(F.lit("N"), F.length(body)) if hard else F.lower(body)).alias("t")))

    joined = seqs.join(s, "id", "left")
    masked = F.aggregate(F.coalesce("s", F.array().cast("array<struct<lo:long,hi:long>>")), zero, step, lambda acc: F.concat(acc["t"], F.substr(F.col("seq"), acc["at"] + 1)))
    return joined.select("id", "title", masked.alias("seq"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)


def write_many(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """One computation to several sinks."""
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()
