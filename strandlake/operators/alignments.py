"""Operators over alignments: pileup, pairing, set comparison, scores, hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators.intervals import overlap_join

_EATS_READ, _EATS_REF = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")


def aligned_columns(cigar: Column) -> Column:
    """(r, q) of every reference place, from 0, that a CIGAR string covers; q is the place in the read, null in a deletion. One pass over its parts."""
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,n:int,r:int,q:int>>").alias("parts"))

    def step(acc: Column, o: Column) -> Column:
        eats = lambda kinds: F.when(o["op"].isin(*kinds), o["n"]).otherwise(0)
        part = F.struct(o["op"].alias("op"), o["n"].alias("n"), acc["r"].alias("r"), acc["q"].alias("q"))
        return F.struct((acc["r"] + eats(_EATS_REF)).alias("r"), (acc["q"] + eats(_EATS_READ)).alias("q"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    def places(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda k: F.struct((p["r"] + k).alias("r"), F.when(p["op"] != "D", p["q"] + k).alias("q")))

    parts = F.aggregate(S.cigar_ops(cigar), zero, step, lambda acc: acc["parts"])
    return F.flatten(F.transform(F.filter(parts, lambda p: p["op"].isin("M", "=", "X", "D") & (p["n"] > 0)), places))


def chunked_reference(refs: DataFrame, width: int = 5000, size: int | None = None) -> DataFrame:
    """(ref, chunk, bases): a reference in rows that begin every ``width`` bases, and hold so many or ``size``, so that none is carried whole by a join."""
    n = F.greatest(F.ceil(F.length("seq") / width).cast("int"), F.lit(1))
    return refs.select("ref", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"), "seq").select(
        "ref", "chunk", F.substring("seq", (F.col("chunk") * width + 1).cast("int"), F.lit(size or width)).alias("bases")
    )


def windowed_reference(refs: DataFrame, width: int) -> DataFrame:
    """``chunked_reference`` in rows of few bases: cut of rows of a hundred times as many, so that no long sequence is gone through once a row."""
    long = chunked_reference(refs, width * 100)
    n = F.greatest(F.ceil(F.length("bases") / width).cast("int"), F.lit(1))
    k = F.explode(F.sequence(F.lit(0), n - 1)).alias("k")
    return long.select("ref", "chunk", "bases", k).select("ref", (F.col("chunk") * 100 + F.col("k")).alias("chunk"), F.substring("bases", (F.col("k") * width + 1).cast("int"), F.lit(width)).alias("bases"))


def pileup(alignments: DataFrame, refs: DataFrame, width: int = 50, rows: int = 1 << 18) -> DataFrame:
    """(ref, pos, base, depth, calls, quals) of every covered place, pos from 1.

    ``alignments``: name, flag, ref, pos (from 1), mapq, cigar, seq, qual. A call is ``.`` (``,`` in reverse) where
    the read has the reference's base, the base itself (lower case in reverse) where not, and ``*`` in a deletion; ``^``
    and the mapping quality come before a read's first call, ``$`` after its last. Calls are in order of start and name.
    Reads are dealt by the ``width`` places of the reference that they lie on, over tasks of about ``rows`` of them, and taken apart there: no call is shuffled.
    """
    cols, own = aligned_columns(F.col("cigar")), ["ref", "start", "name", "mapq", "cigar", "seq", "qual", "back"]
    a = alignments.where(F.col("flag").bitwiseAND(F.lit(4)) == 0).withColumns({"start": F.col("pos"), "back": F.col("flag").bitwiseAND(F.lit(16)) != 0})
    # made as the one row of an array: a filter and each later use would work them out again
    a = a.select(F.inline(F.array(F.struct(*own, cols.alias("cols"))))).where(F.size("cols") > 0)
    r0, r1 = F.element_at("cols", 1)["r"], F.element_at("cols", -1)["r"]
    chunk_of = lambda r: F.floor((F.col("start") + r - 1) / width).cast("int")
    # a read meets the places of the reference that it lies on before it is taken apart, and its calls are made there
    tasks = max(alignments.sparkSession.sparkContext.defaultParallelism, -(-alignments.count() // rows))
    a = a.select(*own, r0.alias("r0"), r1.alias("r1"), F.explode(F.sequence(chunk_of(r0), chunk_of(r1))).alias("chunk")).repartition(tasks, "ref", "chunk")
    here = F.filter(cols, lambda x: chunk_of(x["r"]) == F.col("chunk"))
    a = a.join(windowed_reference(refs, width).hint("merge"), ["ref", "chunk"]).select(*own, "r0", "r1", "chunk", "bases", F.explode(here).alias("x"))
    a = a.select("*", (F.col("start") + F.col("x.r")).alias("at"), F.col("x.q").isNotNull().alias("known"))
    base = F.upper(F.substr("bases", (F.pmod(F.col("at") - 1, F.lit(width)) + 1).cast("int"), F.lit(1)))
    a = a.select("*", base.alias("base"), F.upper(F.substr("seq", F.col("x.q") + 1, F.lit(1))).alias("b"))
    letter = F.when(~F.col("known"), "*").when(F.col("b") == F.col("base"), F.when(F.col("back"), ",").otherwise(".")).otherwise(F.when(F.col("back"), F.lower("b")).otherwise(F.col("b")))
    head = F.when(F.col("x.r") == F.col("r0"), F.concat(F.lit("^"), F.char(F.col("mapq") + 33))).otherwise("")
    call = F.concat(head, letter, F.when(F.col("x.r") == F.col("r1"), "$").otherwise("")).alias("call")
    ql = F.when(F.col("known"), F.substr("qual", F.col("x.q") + 1, F.lit(1))).otherwise("~").alias("ql")
    c = a.select("ref", "chunk", "at", "base", F.struct("start", "name", "back", call, ql).alias("c"))
    sites = c.groupBy("ref", "chunk", F.col("at").alias("pos")).agg(F.first("base").alias("base"), F.sort_array(F.collect_list("c")).alias("s"))
    return sites.select(
        "ref", "pos", "base", F.size("s").alias("depth"), F.array_join(F.transform("s", lambda x: x["call"]), "").alias("calls"), F.array_join(F.transform("s", lambda x: x["ql"]), "").alias("quals")
    )


def coverage_graph(alignments: DataFrame) -> DataFrame:
    """(ref, pos, depth) where depth changes, by a sweep over the ends of blocks; no place is exploded."""
    ends = alignments.select("ref", F.col("pos").alias("at"), F.lit(1).alias("d")).unionByName(alignments.select("ref", (F.col("pos") + S.reference_span(F.col("cigar"))).alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy("ref", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    return steps.select("ref", F.col("at").alias("pos"), F.sum("d").over(Window.partitionBy("ref").orderBy("at")).alias("depth"))


def compare_sets(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, width: int) -> DataFrame:
    """(kind, a_id, b_id): equivalent intervals, overlaps among the rest, and what is in one set only.

    Sets have (key, id, lo, hi). Equivalent ones meet by an equi-join; only the rest goes to the overlap join.
    """
    x, y = a.select(key, F.col(a_id).alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), b.select(key, F.col(b_id).alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    same = x.join(y.withColumns({"a_lo": F.col("b_lo"), "a_hi": F.col("b_hi")}).drop("b_lo", "b_hi"), [key, "a_lo", "a_hi"]).select("a", "b")
    rest_a, rest_b = x.join(same.select("a").distinct(), "a", "left_anti"), y.join(same.select("b").distinct(), "b", "left_anti")
    meet = overlap_join(rest_a, rest_b, key, width).select("a", "b")
    only_a = rest_a.join(meet.select("a").distinct(), "a", "left_anti").select("a", F.lit(None).cast(y.schema["b"].dataType).alias("b"))
    only_b = rest_b.join(meet.select("b").distinct(), "b", "left_anti").select(F.lit(None).cast(x.schema["a"].dataType).alias("a"), "b")
    parts = (("equivalent", same), ("overlap", meet), ("only_1", only_a), ("only_2", only_b))
    out = None
    for kind, df in parts:
        df = df.select(F.lit(kind).alias("kind"), "a", "b")
        out = df if out is None else out.unionByName(df)
    return out


def compare_features(a: Column, b: Column, a_strand: Column, b_strand: Column) -> Column:
    """How the location of feature b lies to that of a; both are arrays of (lo, hi) exons, sorted, apart and in one coordinate system.

    different_strand, missing, same, 5'/3'_extension (equal but for one outer end), missing_exon and 5'/3'_extra_exon
    (equal but for exons that only one has), subset, overlap (exons meet), region_overlap (only their ranges do), or complex.
    """
    lo, hi = (lambda x: F.get(x, F.lit(0))["lo"]), (lambda x: F.element_at(x, -1)["hi"])
    forward = a_strand != "-"
    meets = F.exists(a, lambda x: F.exists(b, lambda y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])))
    within = F.forall(b, lambda y: F.exists(a, lambda x: (x["lo"] <= y["lo"]) & (x["hi"] >= y["hi"])))
    extra, missing = F.array_except(b, a), F.array_except(a, b)
    shared = F.size(F.array_intersect(a, b)) > 0
    ends = lambda x, left: F.transform(x, lambda e, i: F.struct(F.when((i == 0) & F.lit(left), 0).otherwise(e["lo"]).alias("lo"), F.when((i == F.size(x) - 1) & F.lit(not left), 0).otherwise(e["hi"]).alias("hi")))
    but_left, but_right = ends(a, True) == ends(b, True), ends(a, False) == ends(b, False)
    five = (but_left & forward) | (but_right & ~forward)
    before, after = F.forall(extra, lambda e: e["hi"] < lo(a)), F.forall(extra, lambda e: e["lo"] > hi(a))
    extra_only = shared & (F.size(missing) == 0) & (F.size(extra) > 0)
    return (
        F.when(a_strand != b_strand, "different_strand").when((hi(a) < lo(b)) | (hi(b) < lo(a)), "missing").when(a == b, "same")
        .when(five, "5'_extension").when(but_left | but_right, "3'_extension").when(shared & (F.size(extra) == 0), "missing_exon")
        .when(extra_only & F.when(forward, before).otherwise(after), "5'_extra_exon").when(extra_only & F.when(forward, after).otherwise(before), "3'_extra_exon")
        .when(within, "subset").when(shared, "complex").when(meets, "overlap").otherwise("region_overlap")
    )


def pair_hits(hits: DataFrame, least: int, most: int, geometry: str = "FR") -> DataFrame:
    """Pairs of a read's hits of mates 1 and 2 on one subject, with outer spans of least..most and this geometry.

    ``hits``: read, mate, subject, lo, hi, strand, hit. Geometry tells the strands of the left and the right hit.
    """
    side = lambda k: hits.where(F.col("mate") == k).select("read", "subject", *[F.col(c).alias(f"{c}{k}") for c in ("lo", "hi", "strand", "hit")])
    pairs = side(1).join(side(2), ["read", "subject"])
    left_first = F.col("lo1") <= F.col("lo2")
    span = F.greatest("hi1", "hi2") - F.least("lo1", "lo2") + 1
    sign = {"F": "+", "R": "-"}
    strands = F.concat(F.when(left_first, F.col("strand1")).otherwise(F.col("strand2")), F.when(left_first, F.col("strand2")).otherwise(F.col("strand1")))
    return pairs.withColumn("span", span).where(F.col("span").between(least, most) & (strands == sign[geometry[0]] + sign[geometry[1]])).select("read", "subject", "hit1", "hit2", "span")


def hit_list(hits: DataFrame, query: str, subject: str, score: str, hit_id: str, subjects: int, per_subject: int) -> DataFrame:
    """Of each query the best subjects by best score, and of each of those its best hits; ties to smaller ids.

    Subjects are ranked after one partial aggregate, so the window sees one row a subject.
    """
    best = hits.groupBy(query, subject).agg(F.max(score).alias("_best"))
    kept = best.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_best"), subject))).where(F.col("_k") <= subjects).select(query, subject)
    inside = Window.partitionBy(query, subject).orderBy(F.desc(score), hit_id)
    return hits.join(kept, [query, subject]).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= per_subject)


def join_compartments(hits: DataFrame, key: str, ratio: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``hits`` with ``part``: a new part where the gap to what came before exceeds ``ratio`` of that part's usual hit, the one before."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    far = F.col(lo) - F.lag(hi).over(w) > ratio * (F.lag(hi).over(w) - F.lag(lo).over(w) + 1)
    return hits.withColumn("_open", F.coalesce(far.cast("int"), F.lit(1))).withColumn("part", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def alignment_scores(matches: Column, mismatches: Column, gaps: Column, query_span: Column, query_length: Column, k: float = 0.02) -> dict[str, Column]:
    """Named scores of an alignment; the weighted identity discounts short alignments by ``k``."""
    columns = matches + mismatches + gaps
    identity = F.when(columns > 0, 100.0 * matches / columns).otherwise(0.0)
    return {
        "pct_identity": identity, "pct_coverage": F.when(query_length > 0, 100.0 * query_span / query_length).otherwise(0.0),
        "pct_identity_ungapped": F.when(matches + mismatches > 0, 100.0 * matches / (matches + mismatches)).otherwise(0.0),
        "weighted_identity": identity / 100.0 * (1 - F.exp(-k * columns)),
    }


def trim_pct(df: DataFrame, key: str, order: list, share: float) -> DataFrame:
    """The first ``share`` of a key's rows in this order, rounded up."""
    w = Window.partitionBy(key)
    return df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).where(F.col("_k") <= F.ceil(F.col("_n") * share)).drop("_k", "_n")
