"""Registered queries of files written and read again, and of functions on texts and cells; registered with the others on import."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlake.coding_queries import G_SQL, genome
from strandlake.functions import cells as C
from strandlake.functions import reads as RD
from strandlake.functions import text as X
from strandlake.lookup_queries import SEGMENTS
from strandlake.queries import C_SQL, S_SQL, order_cells, query, spans, t, text_of
from strandlake.session import shared_folder
from strandlake.sources import readers as P
from strandlake.sources import tables as TB
from strandlake.sources import writers as W


def _written(spark, lines, name: str) -> str:
    """A folder of the shared one with these lines as files."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    W.write_lines(lines, path)
    return path


# --- files ----------------------------------------------------------------------


@query(f"SELECT 's' || item_id AS id, 'item ' || item_id AS title, length(seq) AS n, md5(seq) AS digest FROM {G_SQL}")
def fasta_round_trip(spark, d):
    """Sequences in lines of 60 letters, written as files and read again."""
    g = genome(spark, d).select(F.concat(F.lit("s"), "item_id").alias("id"), F.concat(F.lit("item "), "item_id").alias("title"), "seq")
    back = P.read_fasta(spark, _written(spark, W.fasta_lines(g), "fasta"))
    return back.select("id", "title", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"SELECT 'r' || item_id AS name, substr(seq, 1, 50) AS seq, repeat('I', 49) || '@' AS qual FROM {G_SQL}")
def fastq_round_trip(spark, d):
    """Records of four lines, one of which begins with the sign of a record, written as files and read again."""
    g = genome(spark, d).select(F.concat_ws("\n", F.concat(F.lit("@r"), "item_id"), F.substring("seq", 1, 50), F.lit("+"), F.lit("I" * 49 + "@")).alias("value"))
    return P.read_fastq(spark, _written(spark, g, "fastq"))


@query("SELECT 'c' || l_suppkey AS chrom, l_orderkey * 8 + l_linenumber AS pos, CAST(l_linenumber AS INTEGER) AS span, l_quantity / 4 AS value FROM lineitem")
def wiggle_round_trip(spark, d):
    """Tracks of a key and span each, written as files and read again."""
    x = t(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_suppkey").alias("chrom"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").cast("int").alias("span"), (F.col("l_quantity") / 4).alias("value"))
    return P.read_wiggle(spark, _written(spark, W.wiggle_lines(x), "wiggle"))


@query(f"SELECT 'c' || o_custkey AS seqid, lo AS start, hi AS stop, 'g' || o_custkey AS gene_id, 't' || o_orderkey AS transcript_id FROM {S_SQL}")
def gtf_round_trip(spark, d):
    x = spans(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("seqid"), F.lit("src").alias("source"), F.lit("exon").alias("type"), F.col("lo").alias("start"), F.col("hi").alias("stop"), F.lit(None).cast("double").alias("score"),
        F.lit("+").alias("strand"), F.lit(None).cast("int").alias("phase"), F.concat(F.lit("g"), "o_custkey").alias("gene_id"), F.concat(F.lit("t"), "o_orderkey").alias("transcript_id"),
    )
    return P.read_gtf(spark, _written(spark, W.gtf_lines(x), "gtf"), "failfast").select("seqid", "start", "stop", "gene_id", "transcript_id")


@query(f"SELECT 'c' || o_custkey AS seqid, lo AS start, 'A' AS reference_seq, 'C,' || CASE WHEN o_orderkey % 2 = 0 THEN 'G' ELSE 'T' END AS variants FROM {S_SQL}")
def gvf_round_trip(spark, d):
    """Sequence changes as attributes, written as files and read again."""
    attrs = F.create_map(F.lit("ID"), F.concat(F.lit("v"), "o_orderkey"), F.lit("Reference_seq"), F.lit("A"), F.lit("Variant_seq"), F.when(F.col("o_orderkey") % 2 == 0, "C,G").otherwise("C,T"))
    x = spans(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("seqid"), F.lit("src").alias("source"), F.lit("SNV").alias("type"), F.col("lo").alias("start"), F.col("lo").alias("stop"), F.lit(None).cast("double").alias("score"), F.lit("+").alias("strand"),
        F.lit(None).cast("int").alias("phase"), attrs.alias("attrs"),
    )
    back = P.read_gvf(spark, _written(spark, W.gvf_lines(x), "gvf"), "failfast")
    return back.select("seqid", "start", "reference_seq", F.array_join("variant_seqs", ",").alias("variants"))


@query(f"SELECT 's' || item_id AS id, substr(seq, 1, 10) || lower(substr(seq, 11, 20)) || substr(seq, 31, 20) || lower(substr(seq, 51, 5)) || substr(seq, 56) AS seq FROM {G_SQL}")
def soft_masked(spark, d):
    """Sequences with two stretches, one of them told by two that overlap, in lower case."""
    g = genome(spark, d).select(F.concat(F.lit("s"), "item_id").alias("id"), F.lit("").alias("title"), "seq")
    at = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for a, b in ((10, 22), (18, 29), (50, 54))]))
    masks = g.select(F.col("id").alias("seqid"), at.alias("m")).select("seqid", "m.*")
    return W.masked_fasta(g, masks).select("id", "seq")


@query("SELECT c_mktsegment AS key, CAST(min(c_custkey) AS BIGINT) AS first, CAST(max(c_custkey) AS BIGINT) AS last FROM customer GROUP BY 1")
def text_index_lookups(spark, d):
    """First and last rows of the stretches that a text index keeps for each key, looked up by key."""
    index = TB.text_index(t(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("key")), "row", "key")
    found = None
    for key in SEGMENTS:
        own = TB.index_lookup(index, key).select(F.lit(key).alias("key"), "first", "last")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("key").agg(F.min("first").cast("long").alias("first"), F.max("last").cast("long").alias("last"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(NULL AS VARCHAR) AS c_comment FROM customer")
def copied_columns(spark, d):
    """Columns copied to another schema by name: cast, added as null, or left out."""
    from pyspark.sql.types import LongType, StringType, StructType

    target = StructType().add("c_custkey", LongType()).add("c_nationkey", LongType()).add("c_comment", StringType())
    return TB.copy_matching(t(spark, d, "customer"), target)


# --- texts ----------------------------------------------------------------------


@query("SELECT doc_id, CAST(instr(text, 'tion') - 1 AS INTEGER) AS place, CAST(instr(lower(text), 'the') - 1 AS INTEGER) AS any_case, CAST(CASE WHEN regexp_matches(text, '(^|[^0-9A-Za-z_])and($|[^0-9A-Za-z_])') THEN 1 ELSE 0 END AS INTEGER) AS whole FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def text_searches(spark, d):
    """Places of a text, of one whatever its case, and whether a whole word is there, in the documents of ASCII letters."""
    x = t(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    c = F.col("text")
    return x.select("doc_id", X.find_text(c, "tion").cast("int").alias("place"), X.find_text(c, "the", ignore_case=True).cast("int").alias("any_case"), (X.find_text(c, "and", whole_word=True) >= 0).cast("int").alias("whole"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN day(o_orderdate) < 15 THEN 'before' WHEN day(o_orderdate) > 15 THEN 'after' ELSE 'same' END AS told, count(*) AS n FROM orders GROUP BY 1")
def compared_dates(spark, d):
    """Dates against the fifteenth of their month, of which some lack the day."""
    o = t(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    part = lambda day: F.struct(F.year("at").alias("year"), F.month("at").alias("month"), day.alias("day"), F.lit("").alias("text"))
    own = F.when(F.col("o_orderkey") % 5 != 0, F.dayofmonth("at"))
    return o.groupBy(X.compare_dates(part(own), part(F.lit(15))).alias("told")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, 'NM_' || l_partkey || '.1' AS accession, l_suppkey AS start, l_suppkey + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 3 END AS stop, CASE WHEN l_linenumber % 2 = 0 THEN 'sub' ELSE 'delins' END AS op, CASE WHEN l_linenumber % 2 = 0 THEN 'T' ELSE 'GG' END AS alt FROM lineitem")
def sequence_changes(spark, d):
    """Changes written by name, taken apart."""
    acc = F.concat(F.lit("NM_"), "l_partkey", F.lit(".1:c."), "l_suppkey")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(acc, F.lit("A>T"))).otherwise(F.concat(acc, F.lit("_"), F.col("l_suppkey") + 3, F.lit("delinsGG")))
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.hgvs(name).alias("h"))
    return x.select("l_orderkey", "l_linenumber", "h.accession", "h.start", "h.stop", "h.op", "h.alt")


@query(f"SELECT item_id, CAST(len(regexp_extract_all(seq, 'G[AT]C')) AS INTEGER) AS n, CAST(coalesce(len(regexp_extract(seq, '^(.*?)G[AT]C', 1)) + CASE WHEN regexp_matches(seq, 'G[AT]C') THEN 0 ELSE NULL END, -1) AS INTEGER) AS first FROM {G_SQL}")
def pattern_spans(spark, d):
    """How many matches a pattern has in each sequence, and where the first begins."""
    x = genome(spark, d).select("item_id", RD.match_spans(F.col("seq"), "G[AT]C").alias("m"))
    return x.select("item_id", F.size("m").alias("n"), F.coalesce(F.get("m", F.lit(0))["start"], F.lit(-1)).cast("int").alias("first"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'gi' ELSE 'lcl' END AS kind, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS value FROM customer")
def parsed_ids(spark, d):
    """Ids of bars, and local ones without, by type and value."""
    text = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("gi|"), "c_custkey", F.lit("|gb|X1.1"))).otherwise(F.col("c_name"))
    m = t(spark, d, "customer").select("c_custkey", X.fasta_id(text).alias("m"))
    kind = F.when(F.map_contains_key("m", F.lit("gi")), "gi").otherwise("lcl")
    return m.select("c_custkey", kind.alias("kind"), F.try_element_at("m", kind).alias("value"))


@query(f"SELECT item_id, round(CAST(len(list_filter(range(1, 101), lambda i: seq[i] <> seq[i + 20])) AS DOUBLE) / 100, 6) AS share FROM {G_SQL}")
def shifted_divergence(spark, d):
    """Share of a hundred places at which a sequence differs from itself, twenty places on."""
    g = genome(spark, d)
    return g.select("item_id", F.round(X.divergence(F.substring("seq", 1, 100), F.substring("seq", 21, 100)), 6).alias("share"))


# --- cells ----------------------------------------------------------------------


@query(f"SELECT l_orderkey, array_to_string(list_filter(range(1, len(c) + 1), lambda i: len(list_filter(c[1:i], lambda x: x > 20)) > 0), ',') AS kept FROM {C_SQL}")
def trimmed_cells(spark, d):
    """Places of cells that are left once the run of small values at the start is trimmed."""
    small = F.transform("c", lambda x: (x > 20).cast("long"))
    places = F.sequence(F.lit(1).cast("long"), F.size("c").cast("long"))
    left = C.trim(small, 0, 0)
    x = order_cells(spark, d).select("l_orderkey", F.slice(places, F.size("c") - F.size(left) + 1, F.size("c")).alias("kept"))
    return x.select("l_orderkey", text_of(F.col("kept")).alias("kept"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(range(1, len(c) + 1), lambda i: c[i] || ':' || (c[i] + 1)), ',') AS pairs, array_to_string(c, ',') AS valid, CAST(len(c) AS INTEGER) AS same FROM {C_SQL}")
def pasted_cells(spark, d):
    """Two cells side by side, cells whose range is checked, and how many elements agree in 20 bits of mantissa with ones that are nearly equal."""
    x = order_cells(spark, d)
    pairs = F.transform(C.paste(F.col("c"), F.transform("c", lambda v: v + 1)), lambda p: F.concat_ws(":", p["c"].cast("string"), p["1"].cast("string")))
    near = F.transform("c", lambda v: C.compare(v.cast("double"), v.cast("double") * (1 + 2.0**-30), 20).cast("int"))
    return x.select("l_orderkey", F.array_join(pairs, ",").alias("pairs"), text_of(C.range_validate(F.col("c"), 0, 1000)).alias("valid"), F.aggregate(near, F.lit(0), lambda a, v: a + v).alias("same"))
