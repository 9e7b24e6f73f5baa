"""Versioned transforms, triggers, edits, text search, and streams of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake import queries, search_queries
from strandlake.operators.words import near_words
from strandlake.functions import algorithms as A
from strandlake.functions import text as X
from strandlake.plans import registry as G
from strandlake.streaming import jobs as J


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_versions():
    r = G.Registry()
    for spec in ("clip #1.0", "clip #1.3", "clip #2.1", "ns:cut"):
        r.add(spec, lambda spec=spec: spec)
    assert [r.get(s)() for s in ("clip", "clip #1", "clip #1.2", "clip#2.0", "ns:cut #1")] == ["clip #2.1", "clip #1.3", "clip #1.3", "clip #2.1", "ns:cut"]
    for bad in ("clip #1.4", "clip #3", "nosuch"):
        with pytest.raises(ValueError, match="no transform"):
            r.get(bad)
    with pytest.raises(ValueError, match="already"):
        r.add("ns:cut #1.0", len)
    assert r.names() == ["clip #1.0", "clip #1.3", "clip #2.1", "ns:cut #1.0"]


def test_triggers_and_edits(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 2],), ([2],), ([],)], "q array<int>")
    got = G.write_with_triggers(df, f"{tmp_path}/t", {"rows": F.count("*"), **G.quality_counts(F.col("q"), 4)})
    assert got == {"rows": 3, "q0": 0, "q1": 1, "q2": 3, "q3": 0} and spark.read.parquet(f"{tmp_path}/t").count() == 3
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, v string, w int")
    edits = spark.createDataFrame(
        [(1, 1, "upsert", True, "x"), (1, 2, "upsert", False, "no"), (2, 1, "upsert", True, "y"), (2, 2, "delete", True, None), (4, 1, "upsert", True, "new"), (5, 1, "delete", True, None), (3, 1, "delete", False, None)],
        "id int, seq int, op string, committed boolean, v string",
    )
    assert sorted(map(tuple, G.apply_edits(rows, edits, "id").collect())) == [(1, "x", 1), (3, "c", 3), (4, "new", None)]


def test_text_search(spark):
    def slow(text, pattern):
        row = [0] * (len(text) + 1)
        for k, ch in enumerate(pattern, 1):
            new = [k]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (t != ch), row[j] + 1, new[-1] + 1))
            row = new
        return min(row), row.index(min(row)) - 1

    rng = random.Random(3)
    for _ in range(200):
        text, pattern = ("".join(rng.choice("abc") for _ in range(rng.randrange(n))) for n in (20, 6))
        assert X.approximate_end(text, pattern) == slow(text, pattern)
    s = F.lit("the Cat (a.b) cat")
    assert one(spark, X.find_text(s, "cat"), X.find_text(s, "cat", ignore_case=True), X.find_text(s, "a", whole_word=True), X.find_text(s, "he", whole_word=True), X.fgrep(s, ["(a.", "Ca"]), X.fgrep(s, ["axb"])) == [14, 4, 9, -1, 4, -1]
    assert one(spark, X.agrep(F.lit("xxhallo"), "hello", 1), X.agrep(F.lit("xx"), "hello", 1), X.ascii85(F.lit("hello"))) == [6, None, "BOu!rDZ"]
    assert one(spark, X.wildcard(F.lit("a.txt"), ["*.t?t"]), X.wildcard(F.lit("axtxt"), ["*.t?t"]), X.wildcard(F.lit("a.txt"), ["*"], ["a*"])) == [True, False, False]
    assert one(spark, X.field_rule(F.lit("ab"), F.lit(r"^\(a\|x\)b$")), X.field_rule(F.lit("cb"), F.lit("^(a|x)b$")), X.field_rule(F.lit("z"), F.lit(None).cast("string"))) == [True, False, True]


def test_dates_ids_names(spark):
    d = lambda y, m=None, n=None, text=None: F.struct(*[F.lit(v).cast("int").alias(k) for k, v in (("year", y), ("month", m), ("day", n))], F.lit(text).cast("string").alias("text"))
    pairs = ((d(2020), d(2021)), (d(2020, 5), d(2020, 4)), (d(2020, 5), d(2020)), (d(2020, 5, 1), d(2020, 5, 1)), (d(None, text="x"), d(None, text="x")), (d(None, text="x"), d(2020)))
    assert one(spark, *[X.compare_dates(a, b) for a, b in pairs]) == ["before", "after", "unknown", "same", "same", "unknown"]
    assert one(spark, X.fasta_id(F.lit("gi|5|gb|A1.2|")), X.fasta_id(F.lit("seq1"))) == [{"gi": "5", "gb": "A1.2"}, {"lcl": "seq1"}]
    assert [tuple(x) for x in one(spark, X.hgvs(F.lit("NM_1.2:c.76A>T")), X.hgvs(F.lit("NC_1.1:g.5_9del")))] == [("NM_1.2", "c", 76, 76, "A", "T", "sub"), ("NC_1.1", "g", 5, 9, None, None, "del")]
    name = F.lit("M1:2:3:44:-5#0")
    tok = X.spot_tokens(name, "illumina")
    assert one(spark, *[X.extract_token(name, tok, k) for k in range(6)]) == ["M1", "2", "3", "44", "-5", ""]
    assert one(spark, X.rewrite_name(name, tok, "$lane.$tile.$x.$y"), F.size(X.spot_tokens(F.lit("other"), "illumina")), X.extract_token(F.lit("R1:7:9"), X.spot_tokens(F.lit("R1:7:9"), "ion_torrent"), 2)) == ["2.3.44.-5", 0, "9"]


def test_alternates_are_all_words_within_two_edits(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    rng = random.Random(6)
    words = {"receive", "recieve", "a", "bc", "b", "cat", "cart", "chart"}
    for n in [*range(1, 24), 40]:
        word = "".join(rng.choice("abc") for _ in range(n))
        for _ in range(8):
            new = word
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(new) + 1)
                new = new[:k] + rng.choice(["", "x", "b"]) + new[k + rng.randrange(2) :]
            words |= {word, new} - {""}
    got = near_words(spark.createDataFrame([(w,) for w in sorted(words)], "w string")).collect()
    want = {(a, b, edits(a, b)) for a in words for b in words if a != b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and ("receive", "recieve", 2) in want
    kept = {(r.w, r.alternate) for r in got}
    assert {("cat", "cart"), ("cart", "chart"), ("a", "bc")} <= kept


def test_multiple_alignment():
    rng = random.Random(4)
    for n in range(6):
        seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 15))) for _ in range(n)]
        rows = A.center_star(seqs)
        assert [r.replace("-", "") for r in rows] == seqs and len({len(r) for r in rows}) <= 1
    assert A.center_star(["ACGT", "AGT", "ACGGT"]) in (["ACG-T", "A-G-T", "ACGGT"], ["AC-GT", "A--GT", "ACGGT"], ["AC-GT", "A-G-T", "ACGGT"])


def test_streams(spark, tmp_path):
    rows = [(k, "2024-01-01 00:00:00") for k in range(20)]
    a = spark.createDataFrame(rows, "k int, s string").select("k", F.to_timestamp("s").alias("ts"))
    b = a.select("k", (F.col("ts") + F.make_dt_interval(secs=F.col("k") * 1.0)).alias("ts2"))
    a.write.parquet(f"{tmp_path}/a"), b.write.parquet(f"{tmp_path}/b")
    pairs = J.mates(spark.readStream.schema(a.schema).parquet(f"{tmp_path}/a"), spark.readStream.schema(b.schema).parquet(f"{tmp_path}/b"), "k", 5, "1 minute")
    q = pairs.writeStream.foreachBatch(J.append_once(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4, 5]
    e = spark.createDataFrame([(1, 5, 1), (2, 9, 1), (3, 2, 2)], "id int, timeout_us long, batch int")
    assert [r.id for r in J.due(e, 5).collect()] == [3, 1] and [r.id for r in J.without_batches(e, e.where("id = 1")).collect()] == [3]


def test_seeds_of_sequences_of_different_brands(spark, sf):
    brand = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = search_queries.seeded_similarity(spark, sf).collect()
    assert any(brand[r.q] != brand[r.s] for r in got) and any(r.q > r.s for r in got) and any(r.q < r.s for r in got)


def test_edit_distances_of_all_pairs_on_whole_texts(spark, tmp_path):
    rows = [(1, "caf\u00e9"), (2, "cafe"), (3, "xcafe")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["text_edit_distance_all"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
