"""Registered queries of reads held as differences, and of re-sorted tables; registered with the others on import."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from strandlake.coding_queries import G_SQL, genome
from strandlake.functions import algorithms as A
from strandlake.functions import genes as GM
from strandlake.operators import genes as GN
from strandlake.operators import restore as R
from strandlake.queries import query, t
from strandlake.session import shared_folder, spread
from strandlake.sources import bam, store
from strandlake.streaming import jobs, registry

_SPAN = 160
#: The parts of the stand-in alignments by line number: lengths of clip, match, insertion, match, deletion, match, gap, match and clip; 0 leaves a part out.
SHAPES = {1: (3, 10, 0, 9, 4, 8, 0, 9, 0), 2: (0, 12, 2, 7, 0, 10, 30, 8, 2), 3: (0, 30, 0, 0, 0, 0, 0, 0, 0), 4: (5, 9, 1, 11, 6, 10, 12, 14, 4), 5: (0, 8, 3, 8, 2, 8, 0, 8, 0), 6: (2, 20, 0, 0, 0, 0, 0, 0, 3), 7: (0, 15, 0, 10, 9, 15, 0, 0, 0)}
_OPS = "SMIMDMNMS"


def _joined(cigar: str) -> str:
    """A CIGAR with like neighbours as one."""
    parts: list[list] = []
    for n, op in re.findall(r"(\d+)(\D)", cigar):
        if parts and parts[-1][1] == op:
            parts[-1][0] += int(n)
        else:
            parts.append([int(n), op])
    return "".join(f"{n}{op}" for n, op in parts)


def _texts(pos: str) -> dict[int, tuple]:
    """(read as an expression over ``seq`` and a start from 1, CIGAR, exact CIGAR, clipped CIGAR, clips, edit distance) of each shape."""
    out = {}
    for k, shape in SHAPES.items():
        read, cigar, exact, clipped, edits, at = [], "", "", "", 0, 0
        for op, size in zip(_OPS, shape):
            if not size:
                continue
            cigar += f"{size}{op}"
            clipped += f"{size}{op}" if op != "S" else ""
            if op == "M":
                # the second base of each match is another one than the reference has
                read += [f"substr(seq, {pos} + {at}, 1)", f"translate(substr(seq, {pos} + {at + 1}, 1), 'ACGT', 'TGCA')", f"substr(seq, {pos} + {at + 2}, {size - 2})"]
                exact, edits, at = exact + f"1=1X{size - 2}=", edits + 1, at + size
            elif op in "SI":
                read.append("'" + "ACGTACGTAC"[:size] + "'")
                exact, edits = exact + f"{size}{op}", edits + (size if op == "I" else 0)
            else:
                exact, edits, at = exact + f"{size}{op}", edits + (size if op == "D" else 0), at + size
        out[k] = (" || ".join(read), *map(_joined, (cigar, exact, clipped)), shape[0], shape[8], edits)
    return out


_T = _texts("pos")
_CASE = lambda i, quote=False: "CASE l_linenumber " + " ".join(f"WHEN {k} THEN " + (f"'{v[i]}'" if quote else str(v[i])) for k, v in _T.items()) + " END"
_POS_SQL = f"(SELECT l_orderkey * 8 + l_linenumber AS aln, l_linenumber, CAST(l_partkey % (SELECT count(*) FROM benchmark) AS BIGINT) AS item_id, 1 + l_suppkey % 40 AS pos FROM lineitem)"


def _parts(shape: tuple) -> list[tuple[str, int, int]]:
    """(kind, place after the start, length) of the parts of a shape that a read has."""
    out, at = [], 0
    for op, size in zip(_OPS, shape):
        if size and op in "MSI":
            out.append((op, at, size))
        at += size if op in "MDN" else 0
    return out


def _read(shape, seq, pos):
    """The read of ``_texts`` from the parts of its shape: a small expression, as code of a case a shape is too long to be compiled by the JVM."""
    kinds = F.array(*[F.array(*[F.struct(F.lit(op).alias("op"), F.lit(at).alias("at"), F.lit(size).alias("size")) for op, at, size in _parts(SHAPES[k])]) for k in sorted(SHAPES)])
    bases = lambda p, k, n: F.substr(seq, (pos + p["at"] + k).cast("int"), n)
    match = lambda p: F.concat(bases(p, 0, F.lit(1)), F.translate(bases(p, 1, F.lit(1)), "ACGT", "TGCA"), bases(p, 2, p["size"] - 2))
    return F.array_join(F.transform(F.get(kinds, shape - 1), lambda p: F.when(p["op"] == "M", match(p)).otherwise(F.substr(F.lit("ACGTACGTAC"), F.lit(1), p["size"]))), "")


def alignments(spark, d):
    """An alignment a line: on a benchmark sequence, at a place and in a shape that the line tells."""
    g = genome(spark, d)
    items = t(spark, d, "benchmark").agg(F.count("*").alias("items"))
    x = spread(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).crossJoin(F.broadcast(items)).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("aln"), "l_linenumber", (F.col("l_partkey") % F.col("items")).alias("item_id"), (1 + F.col("l_suppkey") % 40).alias("pos"))  # one row
    both = x.join(g, "item_id").where(F.length("seq") >= _SPAN)
    return both.select("aln", F.col("item_id").alias("ref"), "pos", F.expr(_CASE(1, True)).alias("cigar"), _read(F.col("l_linenumber"), F.col("seq"), F.col("pos")).alias("seq"))


def _refs(spark, d):
    return genome(spark, d).select(F.col("item_id").alias("ref"), "seq")


_ALN_SQL = f"(SELECT aln, item_id AS ref, pos, {_CASE(1, True)} AS cigar, {_CASE(2, True)} AS exact_cigar, {_CASE(3, True)} AS clipped_cigar, {_CASE(4)} AS left_clip, {_CASE(5)} AS right_clip, {_CASE(6)} AS edit_distance, {_CASE(0).replace('pos +', 'CAST(pos AS INTEGER) +')} AS read FROM {_POS_SQL} JOIN {G_SQL} g USING (item_id) WHERE length(seq) >= {_SPAN})"


@query(f"SELECT aln, ref, pos, read AS seq, cigar, exact_cigar, clipped_cigar, CAST(left_clip AS INTEGER) AS left_clip, CAST(right_clip AS INTEGER) AS right_clip, CAST(edit_distance AS INTEGER) AS edit_distance FROM {_ALN_SQL}")
def restored_reads(spark, d):
    """Reads with clips, insertions, deletions and gaps, held as differences from the reference and restored, with what the differences tell."""
    refs = _refs(spark, d)
    held = R.held_reads(alignments(spark, d), refs, "aln", width=64)
    return R.restored_reads(held, refs, "aln", width=64).drop("mismatch_read")


@query(
    f"SELECT ref, count(*) AS reads, CAST(sum(length(read)) AS BIGINT) AS bases, CAST(sum(n + left_clip + right_clip) AS BIGINT) AS held FROM (SELECT *, len(regexp_extract_all(exact_cigar, 'X')) + CAST(coalesce(nullif(regexp_extract(exact_cigar, '([0-9]+)I', 1), ''), '0') AS INTEGER) AS n FROM {_ALN_SQL}) GROUP BY 1"
)
def held_bases(spark, d):
    """Bases of reads by reference, and how many of them are held because the reference doesn't have them."""
    held = R.held_reads(alignments(spark, d), _refs(spark, d), "aln")
    return held.groupBy("ref").agg(F.count("*").alias("reads"), F.sum(F.size("held.has_mismatch")).alias("bases"), F.sum(F.length("held.mismatch")).alias("held"))


_SORT_SQL = "row_number() OVER (ORDER BY o_orderdate, o_totalprice DESC, o_orderkey)"


@query(f"SELECT {_SORT_SQL} AS o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def resorted_orders(spark, d):
    """The whole table by date, and by price within it, with dense ids in the new order."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return R.resorted(o, "o_orderkey", ["o_orderdate", F.desc("o_totalprice")], ["o_orderdate", "o_totalprice"])[0].drop("o_orderdate")


@query(f"SELECT n AS l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT o_orderkey, {_SORT_SQL} AS n FROM orders) ON o_orderkey = l_orderkey UNION ALL SELECT NULL, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def remapped_lines(spark, d):
    """What refers to the re-sorted table, by its new ids."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    mapping = R.resorted(o, "o_orderkey", ["o_orderdate", F.desc("o_totalprice")], ["o_orderdate", "o_totalprice"])[1]
    return R.referred(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", mapping, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, l_shipdate, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_discount > 0.02")
def sorted_alignments(spark, d):
    """All rows that a filter leaves, sorted by several keys in both directions, with their places: a sort by ranges that spills and merges within each."""
    x = t(spark, d, "lineitem").where("l_discount > 0.02").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return R.dense_ids(x, [F.desc("l_quantity"), "l_shipdate", "l_orderkey", "l_linenumber"], "place").drop("l_shipdate")


@query(f"SELECT ref, CAST(count(*) AS BIGINT) AS reads, CAST(sum(length(read)) AS BIGINT) AS bases, CAST(sum(edit_distance) AS BIGINT) AS edits FROM {_ALN_SQL} WHERE pos <= 30 GROUP BY 1")
def bam_round_trip(spark, d):
    """Alignments written as BAM files to the shared folder, and those of the first places read back by filter and column."""
    bam.register(spark)
    refs = _refs(spark, d)
    made = R.restored_reads(R.held_reads(alignments(spark, d), refs, "aln"), refs, "aln")
    none = lambda kind: F.lit(None).cast(kind)
    rows = made.select(
        F.col("aln").cast("string").alias("qname"), F.lit(0).alias("flag"), F.col("ref").cast("string").alias("rname"), F.col("pos").cast("long").alias("pos"), F.lit(60).alias("mapq"), "cigar", none("string").alias("rnext"),
        F.lit(0).cast("long").alias("pnext"), F.lit(0).alias("tlen"), "seq", none("string").alias("qual"), F.array(F.struct(F.lit("NM").alias("tag"), F.lit("i").alias("type"), F.col("edit_distance").cast("string").alias("value"))).alias("tags"),
    )
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", F.length("seq").alias("n")))), lambda x: F.concat(F.lit("@SQ\tSN:"), x["ref"].cast("string"), F.lit("\tLN:"), x["n"].cast("string"))), "\n")
    header = refs.agg(names.alias("h")).first()["h"]  # a line a reference, as the format asks
    path = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}"
    rows.repartition("rname").write.format("bam").option("header", f"@HD\tVN:1.6\n{header}\n").mode("append").save(path)
    x = spark.read.format("bam").schema("rname string, pos long, seq string, tags array<struct<tag:string,type:string,value:string>>").load(path).where("pos <= 30")
    return x.groupBy(F.col("rname").cast("long").alias("ref")).agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.sum(F.element_at("tags", 1)["value"].cast("long")).alias("edits"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM (SELECT c_mktsegment, c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_mktsegment, -c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1")
def store_of_files(spark, d):
    """A store of lines of files: customers by segment, then one segment's files gone and files with some customers added; each file is read once."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    c = t(spark, d, "customer")
    kept = store.Store(spark, f"{root}/store", store.lines)
    line = lambda key: F.concat_ws(",", "c_mktsegment", key.cast("string")).alias("value")
    c.select("c_mktsegment", line(F.col("c_custkey"))).repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(f"{root}/in")
    kept.update(f"{root}/in", "part-*")
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(f"{root}/in/c_mktsegment=BUILDING")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    c.where("c_nationkey < 5").select("c_mktsegment", line(-F.col("c_custkey"))).write.mode("append").partitionBy("c_mktsegment").text(f"{root}/in")
    kept.update(f"{root}/in", "part-*")
    part = F.split("line", ",")
    return kept.rows().groupBy(part[0].alias("segment")).agg(F.count("*").alias("n"), F.sum(part[1].cast("long")).alias("keys"))


@query()
def job_registry(spark, d):
    """Jobs by affinity and state after a stream of all events: views submit jobs, clicks fetch them; what isn't done within an hour falls back once, then fails."""
    registry.with_state_store(spark)
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern may name a file or a folder
    op = F.when(F.col("event_type") == "view", "submit").when(F.col("event_type") == "click", "fetch").when(F.col("event_type") == "purchase", "cancel")
    user = F.col("user_id").cast("string")
    rows = e.select((F.col("user_id") % 8).cast("string").alias("affinity"), F.col("event_id").alias("job"), op.alias("op"), user.alias("client"), F.col("ts").cast("timestamp").alias("ts")).where("op is not null")
    out = registry.changes(rows, timeout_s=3600, tries=2)
    q = out.writeStream.outputMode("update").foreachBatch(jobs.append_once(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return registry.counts(spark.read.parquet(f"{root}/out"))


# --- transcripts and genes ------------------------------------------------------

_MET_SQL = f"(SELECT ref, CASE WHEN l_linenumber = 2 THEN pos + 29 ELSE pos + 36 END AS a, CASE WHEN l_linenumber = 2 THEN pos + 58 ELSE pos + 47 END AS b, pos AS lo, CASE WHEN l_linenumber = 2 THEN pos + 66 ELSE pos + 61 END AS hi FROM (SELECT l_linenumber, item_id AS ref, pos FROM {_POS_SQL} JOIN {G_SQL} g USING (item_id) WHERE length(seq) >= {_SPAN} AND l_linenumber IN (2, 4)))"


@query(f"SELECT ref, a || '-' || b AS introns, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM {_MET_SQL} GROUP BY 1, 2")
def collapsed_alignments(spark, d):
    """Alignments of the same reference and introns as one."""
    c = GN.collapsed(alignments(spark, d).withColumn("strand", F.lit("+")))
    text = F.array_join(F.transform("introns", lambda i: F.concat(i["lo"].cast("string"), F.lit("-"), i["hi"].cast("string"))), ",")
    return c.select("ref", text.alias("introns"), "lo", "hi", "n")


@query()
def chained_transcripts(spark, d):
    """Chains of collapsed alignments that go on from each other."""
    c = GN.chained_models(GN.collapsed(alignments(spark, d).withColumn("strand", F.lit("+"))))
    return c.withColumn("introns", F.array_join(F.transform("introns", lambda i: F.concat(i["lo"].cast("string"), F.lit("-"), i["hi"].cast("string"))), ","))


@query()
def spliced_alignments(spark, d):
    """Transcripts of two exons against genomic sequences made of them, an intron from the next item's sequence between, and flanks."""
    g = genome(spark, d).where(F.length("seq") >= _SPAN)
    other = g.select((F.col("item_id") - 1).alias("item_id"), F.substring("seq", 21, 60).alias("filler"))
    x = g.join(other, "item_id").select(
        "item_id", F.substring("seq", 1, 120).alias("q"),
        F.concat(F.substring("filler", 1, 25), F.substring("seq", 1, 70), F.lit("GT"), "filler", F.lit("AG"), F.substring("seq", 71, 50), F.substring("filler", 30, 20)).alias("g"),
    )
    return x.select("item_id", GN.spliced(F.col("q"), F.col("g")).alias("a")).select("item_id", "a.score", "a.cigar", F.size("a.exons").alias("exons"))


@query()
def predicted_genes(spark, d):
    """Genes of each sequence by a model whose codons are counted in the longest open reading frames of all sequences."""
    g = genome(spark, d)
    frames = A.orf_table(g, "seq", "item_id").where("strand = '+' AND hi - lo >= 59").join(g, "item_id").select(F.substr("seq", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("cds"))
    scores = GM.coding_scores(GN.codon_counts(frames, "cds"), GN.base_shares(g, "seq"))
    model = GM.Model(coding=scores, gene=-1.0, intron=-2.0, least_intron=20, lengths=GM.length_chances(60.0, 1.0, 600))
    found = GN.predicted_genes(g, "item_id", "seq", model)
    return found.select("item_id", "strand", "gene", F.round("score", 6).alias("score"), F.array_join(F.transform("exons", lambda e: F.concat(e["lo"].cast("string"), F.lit(".."), e["hi"].cast("string"))), ",").alias("exons"))
