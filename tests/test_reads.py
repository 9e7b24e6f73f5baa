"""Reads, alignments, masks and row-addressed tables against plain versions and fixed cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import algorithms as A
from strandlake.functions import masking as M
from strandlake.functions import reads as Q
from strandlake.operators import alignments as L
from strandlake.operators import rows as R
from strandlake.sources import tables as B


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def random_dna(rng, n, alphabet="ACGT"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_colors_flags_qualities(spark):
    assert one(spark, Q.color_from_dna(F.lit("ACNGT")), Q.dna_from_color(F.array(*[F.lit(x) for x in (0, 1, 4, 1)])), Q.color_from_dna(F.lit(""))) == [[0, 1, 4, 4, 1], "ACNN", []]
    assert one(spark, Q.sam_flags(paired=F.lit(True), reverse=F.lit(None).cast("boolean"), last=F.lit(True)), Q.has_flag(F.lit(17), "reverse")) == [129, True]
    assert Q.quantizer("1:10, 10:20,30:-")[8:22] == [1, 1] + [10] * 10 + [30, 30] and Q.quantizer("5:3")[:5] == [5, 5, 5, 0, 0]
    for bad in ("1", "1:x", "1:20,2:10", "1:300"):
        with pytest.raises(ValueError):
            Q.quantizer(bad)
    assert one(spark, Q.quantize(Q.phred(F.lit("!+5I")), "1:10,10:20,30:-")) == [[1, 10, 30, 30]]


def test_places_and_spans(spark):
    off = lambda x, c=True: Q.circular_offset(F.lit(x).cast("long"), F.lit(10).cast("long"), F.lit(c))
    assert one(spark, off(-3), off(10), off(13), off(4, False), off(-10)) == [7, 10, 3, 4, 10]
    with pytest.raises(Exception, match="out of range"):
        one(spark, off(10, False))
    spans = lambda c: [tuple(x) for x in c]
    rng = random.Random(5)
    for _ in range(4):
        s = random_dna(rng, 60, "AC")
        want = [(m.start(), m.end() - 1) for m in re.finditer(r"([acgtACGT]{2})\1{2,}", s)]
        assert spans(one(spark, Q.nmer_repeats(F.lit(s), 2, 3))[0]) == want
    assert one(spark, Q.rle_text(F.lit("MMMIMM")), Q.rle_text_back(F.lit("M3IM2")), Q.rle_text(F.lit(""))) == ["M3IM2", "MMMIMM", ""]
    assert one(spark, *[Q.match_at(F.lit("ARN"), p, F.lit(k)) for p, k in (("A", 0), ("A", 1), ("C", 1), ("R", 1), ("AR", 0), ("RN", 0), ("T", 2))]) == ["yes", "maybe", "no", "yes", "yes", "yes", "maybe"]
    assert one(spark, Q.find_matches(F.lit("ACANC"), "AC", "yes"), Q.find_matches(F.lit("ACANC"), "AC", "maybe"), Q.find_matches(F.lit("A"), "AC", "yes")) == [[0], [2, 3], []]


def test_masks_against_plain_versions():
    rng = random.Random(9)
    for _ in range(30):
        s = random_dna(rng, rng.randrange(0, 60), "ACG" if rng.random() < 0.5 else "AAAT")
        entropy = lambda w: -sum(w.count(c) / 12 * math.log2(w.count(c) / 12) for c in set(w))
        bits = [entropy(s[i : i + 12]) for i in range(max(0, len(s) - 11))]
        np.testing.assert_allclose(M.window_entropy(s, 12), bits, atol=1e-9)
        hit, i = set(), 0
        while i < len(bits):
            j = i
            while j < len(bits) and bits[j] <= 1.2 + 1e-9:
                j += 1
            if j > i and min(bits[i:j]) <= 1.0 + 1e-9:
                hit |= set(range(i, j + 11))
            i = max(j, i + 1)
        assert {k for a, b in M.low_complexity(s, 12, 1.0, 1.2) for k in range(a, b + 1)} == hit
        score = lambda w: sum(c * (c - 1) for c in [[w[k : k + 3] for k in range(len(w) - 2)].count(x) for x in {w[k : k + 3] for k in range(len(w) - 2)}]) / (2 * (len(w) - 3))
        np.testing.assert_allclose(M.triplet_scores(s, 16), [score(s[i : i + 16]) for i in range(max(0, len(s) - 15))], atol=1e-9)
    assert M.triplet_mask("A" * 20, 64, 2.0) == [(0, 19)] and M.triplet_mask("", 64) == M.low_complexity("") == M.antigenic("MKV") == []
    p = "K" * 10 + "V" * 12 + "K" * 10
    assert M.antigenic(p, 6) == [(a, b) for a, b in M.runs(np.array([4 <= k - 3 <= 24 and sum(M.PROPENSITY[c] for c in p[k - 3 : k + 4]) / 7 >= 1.0 if 3 <= k < len(p) - 3 else False for k in range(len(p))]))]


def test_traceback_and_trees():
    rng = random.Random(2)
    for _ in range(30):
        a, b = random_dna(rng, rng.randrange(0, 12)), random_dna(rng, rng.randrange(0, 12))
        score, cigar = A.traceback(a, b)
        assert score == A.global_alignment(a, b)
        i = j = total = 0
        for n, op in re.findall(r"(\d+)([MID])", cigar):
            for _ in range(int(n)):
                if op == "M":
                    total, i, j = total + (1 if a[i] == b[j] else -1), i + 1, j + 1
                else:
                    total, i, j = total - 2, i + (op == "I"), j + (op == "D")
        assert (i, j, total) == (len(a), len(b), score)
    d = np.array([[0, 5, 9, 9], [5, 0, 10, 10], [9, 10, 0, 8], [9, 10, 8, 0]], float)
    edges = A.neighbor_joining(list("abcd"), d)
    want = {("a", "b"): 5, ("a", "c"): 9, ("a", "d"): 9, ("b", "c"): 10, ("b", "d"): 10, ("c", "d"): 8}
    assert A.patristic(edges) == pytest.approx(want)
    rooted = A.rerooted(edges, "c")
    assert A.patristic(rooted) == pytest.approx(want) and rooted[0][:2] == ("root", "c")
    assert A.zero_negative([("x", "y", -0.5)]) == [("x", "y", 0.0)]
    x = A.length_adjustment(100, 10**6, 10)
    assert 0 < x < 100 and A.effective_space(100, 10**6, 10) == (100 - x) * (10**6 - 10 * x)
    assert A.length_adjustment(3, 10, 5) == 0


def test_pileup_with_gaps(spark):
    refs = spark.createDataFrame([("r", "ACGTACGTAC")], "ref string, seq string")
    rows = [("a", 0, "r", 2, 30, "2M1I2M1D1M", "CGTTAG", "abcdef"), ("b", 16, "r", 4, 0, "1S2M", "GAA", "xyz"), ("c", 4, "r", 4, 0, "3M", "AAA", "xyz"), ("d", 0, "r", 1, 9, None, "A", "x")]
    al = spark.createDataFrame(rows, "name string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual string")
    got = {r.pos: (r.base, r.depth, r.calls, r.quals) for r in L.pileup(al, refs, width=3).collect()}
    assert got == {2: ("C", 1, "^?.", "a"), 3: ("G", 1, ".", "b"), 4: ("T", 2, ".^!a", "dy"), 5: ("A", 2, ".,$", "ez"), 6: ("C", 1, "*", "~"), 7: ("G", 1, ".$", "f")}


def test_feature_comparison(spark):
    a = [(10, 20), (30, 40), (50, 60)]
    cases = {
        "same": a, "missing": [(70, 80)], "missing_exon": [(10, 20), (50, 60)], "5'_extension": [(5, 20), (30, 40), (50, 60)], "3'_extension": [(10, 20), (30, 40), (50, 65)],
        "5'_extra_exon": [(1, 4), *a], "3'_extra_exon": [*a, (70, 80)], "subset": [(12, 18), (31, 39)], "overlap": [(15, 35)], "region_overlap": [(22, 28)], "complex": [(10, 20), (35, 45)],
    }
    rows = [(k, a, b) for k, b in cases.items()]
    df = spark.createDataFrame(rows, "want string, a array<struct<lo:int,hi:int>>, b array<struct<lo:int,hi:int>>")
    for s in ("+", "-"):
        got = {r.want: r.got for r in df.select("want", L.compare_features(F.col("a"), F.col("b"), F.lit(s), F.lit(s)).alias("got")).collect()}
        mirror = {"5'_extension": "3'_extension", "3'_extension": "5'_extension", "5'_extra_exon": "3'_extra_exon", "3'_extra_exon": "5'_extra_exon"} if s == "-" else {}
        assert got == {k: mirror.get(k, k) for k in cases}
    assert df.select(L.compare_features(F.col("a"), F.col("b"), F.lit("+"), F.lit("-")).alias("k")).distinct().collect()[0].k == "different_strand"


def test_row_addressed_tables(spark):
    assert B.row_ranges("5, 1-3,4-4,10-8") == [(1, 5), (8, 10)]
    with pytest.raises(ValueError, match="bad row range"):
        B.row_ranges("1-")
    df = spark.createDataFrame([(1, 'a"b', 1.5, None), (2, "x,y", None, [1, 2]), (3, "<&>", 2.0, [])], "id long, s string, x double, c array<int>")
    lines = lambda form: [r.value for r in B.dump(df.select("id", "s"), form).collect()]
    assert lines("csv") == ['1,"a""b"', '2,"x,y"', "3,<&>"] and lines("xml")[2] == "<row><id>3</id><s>&lt;&amp;&gt;</s></row>" and lines("default")[0] == 'id: 1\ns: a"b'
    assert lines("tab")[1] == "2\tx,y" and lines("piped")[0] == '1|a"b'
    with pytest.raises(ValueError, match="unknown form"):
        B.dump(df, "nosuch")
    got = {r.name: (r.filled, r.least, r.most, r.fixed) for r in B.column_report(df).collect()}
    assert got == {"id": (3, 1, 1, True), "s": (3, 3, 3, True), "x": (2, 0, 1, False), "c": (2, 0, 2, False)}
    assert [tuple(r) for r in B.redact(df, F.col("id") < 3, ["s", "x", "c"]).collect()] == [(1, "NNN", 0.0, None), (2, "NNN", None, None), (3, "<&>", 2.0, [])]
    target = spark.createDataFrame([], "ID int, s int, other string").schema
    assert [tuple(r) for r in B.copy_matching(df, target).collect()] == [(1, None, None), (2, None, None), (3, None, None)]
    index = B.text_index(spark.createDataFrame([(1, "k"), (2, "k"), (3, "j"), (5, "k")], "id long, key string"), "id", "key")
    assert sorted((r["first"], r["last"]) for r in B.index_lookup(index, "k").collect()) == [(1, 2), (5, 5)]
    assert (B.index_project(index, 3), B.index_project(index, 4, "none")) == ("j", "none")
    meta = B.write_node(spark.createDataFrame([], "path string, value string"), "a/b", "1")
    meta = B.write_node(B.write_node(meta, "a/b", "2", append=True), "c", "x")
    assert (B.read_node(meta, "a/b", "int"), B.read_node(meta, "c", "int"), B.read_node(meta, "none")) == (12, None, None)
    ids = spark.createDataFrame([(x,) for x in (0, 5, 5, 7, 1000, 1001, 999_999)], "id long")
    assert sorted(tuple(r) for r in R.sparse_rank(ids, "id", 100).collect()) == [(0, 0), (5, 1), (7, 2), (1000, 3), (1001, 4), (999_999, 5)]
