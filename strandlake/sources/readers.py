"""Readers of delimited and record formats, all by Spark's own text sources.

Every reader of lines has a parser of the same name, which takes lines from
wherever they are (column ``value``). A line that can't be read, because it has too
few fields or one that isn't of its column's type, keeps its text in ``bad_line`` and
has nulls elsewhere (``permissive``), or is an error whatever columns are looked at
(``failfast``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import dealt


def _either(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _once(df: DataFrame, *cols: Column) -> DataFrame:
    """These columns, worked out once a row: made as the one row of an array, so that no filter or later column puts their expressions in its own place."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def _fields(lines: DataFrame, columns: list[tuple[str, str]], skip: str, sep: str = "\t", least: int | None = None, mode: str = "permissive", rest: str | None = None, none: str | None = ".") -> DataFrame:
    """Typed columns of delimited lines, ``none`` being the field that stands for null; ``rest`` names an array of the fields after them."""
    lines = _once(lines, F.col("value")).where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(skip))
    rows = _once(lines, F.col("value"), F.split("value", sep).alias("p"))
    raw = [F.get("p", F.lit(k)) if none is None else F.nullif(F.get("p", F.lit(k)), F.lit(none)) for k in range(len(columns))]
    rows = _once(rows, F.col("value"), F.col("p"), *[r.try_cast(kind).alias(f"_{k}") for k, (r, (_, kind)) in enumerate(zip(raw, columns))])
    cast = [F.col(f"_{k}") for k in range(len(columns))]
    bad = (F.size("p") < (least or len(columns))) | _either([r.isNotNull() & c.isNull() for r, c, (_, kind) in zip(raw, cast, columns) if kind != "string"])
    rows = _once(rows, F.col("value"), F.col("p"), *cast, bad.alias("bad"))
    if mode == "failfast":  # a filter, so that no choice of columns leaves it out
        rows = rows.where(F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))).cast("boolean")).otherwise(F.lit(True)))
    out = [F.when(~F.col("bad"), c).alias(name) for c, (name, _) in zip(cast, columns)]
    if rest:
        n = len(columns)
        out.append(F.when(~F.col("bad"), F.when(F.size("p") > n, F.slice("p", F.lit(n + 1), F.greatest(F.size("p") - n, F.lit(1)))).otherwise(F.array().cast("array<string>"))).alias(rest))
    return rows.select(*out, F.when(F.col("bad"), F.col("value")).alias("bad_line"))


def _map_of(pairs: Column, decode: Callable[[Column], Column] = lambda c: c) -> Column:
    """Map of ``key=value`` texts; a key that repeats has its values joined by commas, one without value has the empty text."""
    at = lambda kv: F.locate("=", kv)
    key = lambda kv: decode(F.trim(F.when(at(kv) > 0, F.substr(kv, F.lit(1), at(kv) - 1)).otherwise(kv)))
    value = lambda kv: decode(F.when(at(kv) > 0, F.substr(kv, at(kv) + 1)).otherwise(F.lit("")))
    own = F.filter(pairs, lambda kv: F.trim(kv) != "")
    keys = F.array_distinct(F.transform(own, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(own, lambda kv: key(kv) == k), value), ",")))


def percent_decoded(c: Column) -> Column:
    """Text with its percent codes resolved; a percent sign that begins none stays."""
    plain = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.locate("%", c) > 0, F.coalesce(F.try_url_decode(plain), c)).otherwise(c)


def percent_encoded(c: Column) -> Column:
    """Text with the characters that structure an attribute column as percent codes."""
    for raw in "%;=&,\t\n\r":
        c = F.replace(c, F.lit(raw), F.lit(f"%{ord(raw):02X}"))
    return c


GFF = [("seqid", "string"), ("source", "string"), ("type", "string"), ("start", "long"), ("stop", "long"), ("score", "double"), ("strand", "string"), ("phase", "int"), ("attributes", "string")]


def parse_gff3(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    df = _fields(lines, GFF, "^#", mode=mode)
    return df.withColumn("attrs", _map_of(F.split("attributes", ";"), percent_decoded))


def read_gff3(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """GFF3 rows with ``attrs``, a map of the attributes; gene structure is a join of Parent to ID. A file's sequence section is left out."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    section = rows.where(F.col("value").startswith("##FASTA") | F.col("value").startswith(">")).groupBy("file").agg(F.min("at").alias("from"))
    rows = rows.join(section, "file", "left").where("from is null or at < from")
    return parse_gff3(rows.select("value"), mode)


def parse_gtf(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    df = _fields(lines, GFF, "^#", mode=mode)
    value = lambda key: F.nullif(F.regexp_extract("attributes", f'{key} "([^"]*)"', 1), F.lit(""))
    return df.withColumns({"gene_id": value("gene_id"), "transcript_id": value("transcript_id")})


def read_gtf(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    return parse_gtf(spark.read.text(path), mode)


BED = [("chrom", "string"), ("start", "long"), ("stop", "long"), ("name", "string"), ("score", "double"), ("strand", "string"), ("thick_start", "long"), ("thick_stop", "long"), ("item_rgb", "string"), ("block_count", "int"), ("block_sizes", "string"), ("block_starts", "string")]


def parse_bed(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    df = _fields(lines, BED, "^(#|track|browser)", least=3, mode=mode)
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    return df.withColumns({"block_sizes": numbers("block_sizes"), "block_starts": numbers("block_starts")})


def read_bed(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """BED rows of three to twelve columns; absent ones are null."""
    return parse_bed(spark.read.text(path), mode)


VCF = [("chrom", "string"), ("pos", "long"), ("id", "string"), ("ref", "string"), ("alts", "string"), ("qual", "double"), ("filters", "string"), ("info_text", "string"), ("format", "string")]


def parse_vcf(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    df = _fields(lines, VCF, "^#", least=8, mode=mode, rest="calls")
    genotypes = F.transform("calls", lambda c: F.map_from_arrays(F.slice(F.split("format", ":"), F.lit(1), F.size(F.split(c, ":"))), F.split(c, ":")))
    info = _map_of(F.split("info_text", ";"))
    return df.select("chrom", "pos", "id", "ref", F.split("alts", ",").alias("alt"), "qual", F.split("filters", ";").alias("filter"), info.alias("info"), genotypes.alias("genotypes"), "bad_line")


def read_vcf(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """VCF rows: alt as an array, info as a map (flags have empty values), genotypes as an array of maps by FORMAT."""
    return parse_vcf(spark.read.text(path), mode)


def read_vcf_specs(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, number, type, description) of the INFO, FORMAT and FILTER declarations of a header."""
    head = spark.read.text(path).where(F.col("value").rlike("^##(INFO|FORMAT|FILTER)=<"))
    own = lambda key: F.nullif(F.regexp_extract("value", rf'[<,]{key}=("[^"]*"|[^,>]*)', 1), F.lit(""))
    return head.select(F.regexp_extract("value", "^##([A-Z]+)=", 1).alias("kind"), own("ID").alias("id"), own("Number").alias("number"), own("Type").alias("type"), F.trim(own("Description"), F.lit('"')).alias("description"))


def parse_agp(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    cols = [("object", "string"), ("obj_beg", "long"), ("obj_end", "long"), ("part", "int"), ("type", "string"), ("f6", "string"), ("f7", "string"), ("f8", "string"), ("f9", "string")]
    df = _fields(lines, cols, "^#", least=8, mode=mode)
    gap = F.col("type").isin("N", "U")
    own = lambda c, kind="string": F.when(~gap, F.col(c)).try_cast(kind)
    return df.select(
        "object", "obj_beg", "obj_end", "part", "type", own("f6").alias("component"), own("f7", "long").alias("comp_beg"), own("f8", "long").alias("comp_end"), own("f9").alias("orientation"),
        F.when(gap, F.col("f6")).try_cast("long").alias("gap_length"), F.when(gap, F.col("f7")).alias("gap_type"), F.when(gap, F.col("f8")).alias("linkage"), F.when(gap, F.col("f9")).alias("evidence"), "bad_line",
    )


def read_agp(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """AGP rows; of a gap row (type N or U) columns 6 to 9 are length, gap type, linkage and evidence."""
    return parse_agp(spark.read.text(path), mode)


def agp_against_sequences(agp: DataFrame, seqs: DataFrame) -> DataFrame:
    """Components (component, used, length, problem) whose rows and sequences (id, seq) disagree: one without the other, or a row that ends beyond it."""
    used = agp.where(F.col("component").isNotNull()).groupBy("component").agg(F.max("comp_end").alias("used"))
    have = seqs.select(F.col("id").alias("component"), F.length("seq").cast("long").alias("length"))
    problem = F.when(F.col("length").isNull(), "no sequence").when(F.col("used").isNull(), "not placed").when(F.col("used") > F.col("length"), "ends beyond its sequence")
    return used.join(have, "component", "full_outer").withColumn("problem", problem).where("problem is not null")


def agp_problems(agp: DataFrame) -> DataFrame:
    """Rule violations as (object, part, problem)."""
    gap = F.col("type").isin("N", "U")
    span = F.col("obj_end") - F.col("obj_beg") + 1
    rules = [
        (F.col("obj_end") < F.col("obj_beg"), "object end before begin"),
        (~gap & (F.col("comp_end") - F.col("comp_beg") + 1 != span), "component and object lengths differ"),
        (gap & (F.col("gap_length") != span), "gap length differs from object span"),
        (~gap & ~F.coalesce(F.col("orientation"), F.lit("")).isin("+", "-", "?", "0", "na"), "unknown orientation"),
        ((F.col("type") == "U") & (F.col("gap_length") != 100), "gap of unknown length is not 100"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())
    return agp.select("object", "part", F.explode(found).alias("problem"))


M8 = [("query", "string"), ("subject", "string"), ("identity", "float"), ("length", "int"), ("mismatches", "int"), ("gaps", "int"), ("q_start", "int"), ("q_end", "int"), ("s_start", "int"), ("s_end", "int"), ("evalue", "double"), ("score", "float")]


def parse_hits(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    return _fields(lines, M8, "^#", mode=mode)


def read_hits(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """Tabular hits of twelve columns."""
    return parse_hits(spark.read.text(path), mode)


SAM = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "int"), ("seq", "string"), ("qual", "string")]


def parse_sam(lines: DataFrame, mode: str = "permissive") -> DataFrame:
    df = _fields(lines, SAM, "^@[A-Z][A-Z](\\t|$)", mode=mode, rest="optional", none=None)
    part = lambda x, k: F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]):([A-Za-z]):(.*)$", k)
    tags = F.transform(F.filter("optional", lambda x: part(x, 1) != ""), lambda x: F.struct(part(x, 1).alias("tag"), part(x, 2).alias("type"), part(x, 3).alias("value")))
    return df.withColumn("tags", tags).select(*[n for n, _ in SAM], "tags", "bad_line")


def read_sam(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """Alignment rows with ``tags``, an array of (tag, type, value) of the optional fields."""
    return parse_sam(spark.read.text(path), mode)


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields, value) of header lines: fields are a map, of comments (CO) an empty one."""
    head = spark.read.text(path).where(F.col("value").rlike("^@[A-Z][A-Z](\\t|$)"))
    kind = F.substring("value", 2, 2)
    pairs = F.when(kind == "CO", F.array().cast("array<string>")).otherwise(F.slice(F.split("value", "\t"), 2, 1000))
    return head.select(kind.alias("kind"), _map_of(F.transform(pairs, lambda x: F.regexp_replace(x, "^([A-Za-z][A-Za-z0-9]):", "$1="))).alias("fields"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, seq): records are cut by the source itself, so a file is split over tasks."""
    recs = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    text = F.regexp_replace("value", "^>", "")
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substr(F.col("value"), F.locate("\n", F.col("value")) + 1), r"\s", "")
    seq = F.when(F.locate("\n", F.col("value")) > 0, body).otherwise("")
    return recs.select(F.regexp_extract(title, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(title, r"^\S*", "")).alias("title"), seq.alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line): every line with its number from 0 in its file.

    Lines are numbered within the blocks that the source cuts files into, each a task of its own;
    only the blocks' counts, a row for each, are added up by file. So a file of any size is read in parallel.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    rows = dealt(rows, "file", "block", rows=1 << 18)  # paths take far more room sorted than shuffled
    base = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = rows.groupBy("file", "block").agg(F.count("*").alias("lines")).select("file", "block", base.alias("base"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return rows.withColumn("k", inside).join(bases, ["file", "block"]).select("file", "block", (F.col("base") + F.col("k")).alias("n"), "line")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of four-line records; blank lines at the end of a file are no record."""
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("line")))
    rec = numbered_lines(spark, path).groupBy("file", F.floor(F.col("n") / 4).alias("rec")).agg(at(0).alias("name"), at(1).alias("seq"), at(3).alias("qual"))
    return rec.where("name <> ''").select(F.regexp_replace("name", "^@", "").alias("name"), "seq", "qual")


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, span, value) of fixedStep and variableStep tracks; rows take the declaration before them, which may lie in an earlier block."""
    rows = numbered_lines(spark, path).where((F.length("line") > 0) & ~F.col("line").rlike("^(#|track|browser)"))
    rows = rows.withColumn("head", F.col("line").rlike("^(fixed|variable)Step"))
    here = F.last(F.when(F.col("head"), F.struct("n", F.col("line").alias("decl"))), ignorenulls=True)
    last = rows.where("head").groupBy("file", "block").agg(F.max(F.struct("n", F.col("line").alias("decl"))).alias("last"))
    blocks = rows.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", before.alias("carried"))
    inside = Window.partitionBy("file", "block").orderBy("n")
    nth = F.row_number().over(Window.partitionBy("file", "block", "d.n").orderBy("n")) - 1
    rows = rows.withColumn("own", here.over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(blocks, ["file", "block"])
    rows = rows.withColumn("d", F.coalesce("own", "carried")).where("not head and d is not null").withColumn("k", nth)
    # values of one declaration go on from block to block
    sizes = rows.groupBy("file", F.col("d.n").alias("dn"), "block").agg(F.count("*").alias("c"))
    done = F.coalesce(F.sum("c").over(Window.partitionBy("file", "dn").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "dn", "block", done.alias("done"))
    data = rows.select("file", "block", F.col("d.n").alias("dn"), F.col("d.decl").alias("decl"), "k", "line").join(sizes, ["file", "dn", "block"]).withColumn("k", F.col("k") + F.col("done"))
    key = lambda k, d: F.coalesce(F.nullif(F.regexp_extract("decl", rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(d))
    fixed = F.col("decl").startswith("fixed")
    parts = F.split(F.trim("line"), r"\s+")
    pos = F.when(fixed, key("start", "1").cast("long") + F.col("k") * key("step", "1").cast("long")).otherwise(F.get(parts, F.lit(0)).try_cast("long"))
    return data.select(key("chrom", "").alias("chrom"), pos.alias("pos"), key("span", "1").cast("int").alias("span"), F.when(fixed, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))).try_cast("double").alias("value"))


def read_gvf(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """GFF3 rows of sequence changes, with the reference's sequence and the variant ones of their attributes."""
    df = read_gff3(spark, path, mode)
    return df.withColumns({"reference_seq": F.col("attrs")["Reference_seq"], "variant_seqs": F.split(F.col("attrs")["Variant_seq"], ",")})


def read_bed15(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """Microarray rows: twelve columns of blocks, then experiments and their scores as arrays."""
    text = ["name", "strand", "item_rgb", "block_sizes", "block_starts", "exp_ids", "exp_scores"]
    names = ["chrom", "start", "stop", "name", "score", "strand", "thick_start", "thick_stop", "item_rgb", "block_count", "block_sizes", "block_starts", "exp_count", "exp_ids", "exp_scores"]
    df = _fields(spark.read.text(path), [(n, "string" if n in text or n == "chrom" else "double" if n == "score" else "long") for n in names], "^(#|track|browser)", mode=mode)
    numbers = lambda c, kind: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast(kind))
    return df.withColumns({"block_sizes": numbers("block_sizes", "long"), "block_starts": numbers("block_starts", "long"), "exp_ids": numbers("exp_ids", "int"), "exp_scores": numbers("exp_scores", "double")})


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(head, lines) of records that the source cuts at ``sep``."""
    recs = spark.read.option("lineSep", sep).text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    return recs.select(F.get(lines, F.lit(0)).alias("head"), F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.length(F.trim(x)) > 0).alias("lines"))


def read_glimmer3(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, name, start, stop, strand, frame, score) of gene predictions; start is before stop also in reverse."""
    rec = _records(spark, path, "\n>").select(F.regexp_extract("head", r"^>?(\S*)", 1).alias("seqid"), F.explode("lines").alias("line"))
    p = F.split(F.trim("line"), r"\s+")
    a, b, frame = F.get(p, F.lit(1)).try_cast("long"), F.get(p, F.lit(2)).try_cast("long"), F.get(p, F.lit(3)).try_cast("int")
    return rec.select("seqid", F.get(p, F.lit(0)).alias("name"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"), F.when(frame < 0, "-").otherwise("+").alias("strand"), frame.alias("frame"), F.get(p, F.lit(4)).try_cast("double").alias("score"))


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, type, spans, qualifiers) of five-column feature tables; a span whose start is after its stop is in reverse."""
    rec = _records(spark, path, ">Feature ").withColumn("seqid", F.regexp_extract("head", r"^(\S+)", 1))
    rows = rec.withColumn("rec", F.monotonically_increasing_id()).select("seqid", "rec", F.posexplode("lines").alias("n", "line"))
    p = F.split("line", "\t")
    number = lambda k: F.regexp_replace(F.get(p, F.lit(k)), "[<>^]", "").try_cast("long")
    kind = F.nullif(F.get(p, F.lit(2)), F.lit(""))
    rows = rows.select("seqid", "rec", "n", number(0).alias("a"), number(1).alias("b"), kind.alias("type"), F.get(p, F.lit(3)).alias("key"), F.get(p, F.lit(4)).alias("value"))
    run = F.count("type").over(Window.partitionBy("rec").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    in_order = lambda test, *cols: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("n", *cols)))), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    feats = rows.withColumn("run", run).where("run > 0").groupBy("seqid", "rec", "run").agg(
        F.max("type").alias("type"), in_order(F.col("a").isNotNull(), "a", "b").alias("s"), in_order(F.col("key").isNotNull() & (F.col("key") != ""), "key", "value").alias("qualifiers")
    )
    spans = F.transform("s", lambda x: F.struct(F.least(x["a"], x["b"]).alias("start"), F.greatest(x["a"], x["b"]).alias("stop"), F.when(x["a"] > x["b"], "-").otherwise("+").alias("strand")))
    return feats.select("seqid", "run", "type", spans.alias("spans"), "qualifiers")


def read_ace(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bases, n_reads, seq, reads) of assembly files; reads are (read, strand, start), seq has pads as ``*``."""
    recs = spark.read.option("lineSep", "\nCO ").text(path).where(~F.col("value").startswith("AS "))
    p = F.split(F.regexp_extract("value", r"^([^\n]*)", 1), r"\s+")
    seq = F.regexp_replace(F.regexp_extract("value", r"^[^\n]*\n((?:[A-Za-z*-]+[ \t\r]*\n)+)", 1), r"\s", "")
    at = lambda x, k: F.get(F.split(x, r"\s+"), F.lit(k))
    reads = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^AF (\S+ [UC] -?\d+)"), F.lit(1)), lambda x: F.struct(at(x, 0).alias("read"), F.when(at(x, 1) == "C", "-").otherwise("+").alias("strand"), at(x, 2).cast("long").alias("start")))
    return recs.select(F.get(p, F.lit(0)).alias("contig"), F.get(p, F.lit(1)).try_cast("long").alias("bases"), F.get(p, F.lit(2)).try_cast("long").alias("n_reads"), seq.alias("seq"), reads.alias("reads"))


def aligned_pair(a: Column, b: Column) -> Column:
    """(a, b) of two rows of an alignment without the columns that are gaps in both."""
    kept = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda c: (c["x"] != "-") | (c["y"] != "-"))
    return F.struct(F.array_join(F.transform(kept, lambda c: c["x"]), "").alias("a"), F.array_join(F.transform(kept, lambda c: c["y"]), "").alias("b"))


def feature_kind(c: Column, warn: list[str], refuse: list[str]) -> Column:
    """okay, warn or disallowed of a feature's name, whatever its case."""
    name = F.lower(c)
    return F.when(name.isin(*[x.lower() for x in refuse]), "disallowed").when(name.isin(*[x.lower() for x in warn]), "warn").otherwise("okay")


def guess_format(spark: SparkSession, path: str) -> str:
    """Name of a file's format, from its first lines."""
    head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    rows = [x for x in head if x.strip() and not x.startswith(("#", "track", "browser"))]
    first = head[0] if head else ""
    if first.startswith("##fileformat=VCF"):
        return "vcf"
    if first.startswith("##gff-version"):
        return "gff3"
    if first.startswith(">"):
        return "fasta"
    if first.startswith("@") and len(head) > 2 and head[2].startswith("+"):
        return "fastq"
    if first.startswith("@") and "\t" in first:
        return "sam"
    if any(r.startswith(("fixedStep", "variableStep")) for r in rows):
        return "wiggle"
    n = len(rows[0].split("\t")) if rows else 0
    if n == 12:
        return "hits"
    if n == 9 and 'gene_id "' in rows[0]:
        return "gtf"
    if n == 9:
        return "agp" if rows[0].split("\t")[4] in "ADFGOPNUW" else "gff3"
    if n >= 3 and all(x.isdigit() for x in rows[0].split("\t")[1:3]):
        return "bed"
    return "json" if first.lstrip().startswith(("{", "[")) else "text"


def text_or_dot(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))
