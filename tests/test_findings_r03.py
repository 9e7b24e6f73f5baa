"""What the findings of round 3 told, on small tables."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from strandlake import coding_queries, domain_queries, format_queries, lookup_queries, queries as own, read_queries, restore_queries, search_queries  # noqa: F401  the others register their own
from strandlake.functions import text as X
from strandlake.operators import restore
from strandlake.operators import search as H
from strandlake.operators import words as N
from strandlake.operators.rows import top_k
from strandlake.sources import readers as P
from strandlake.sources import tables as B
from strandlake.sources import writers as W
from strandlake.streaming import registry


def plan(df):
    return df._jdf.queryExecution().toString()


def test_mapped_features_send_nothing_exploded_to_the_driver(spark, sf):
    assert "BroadcastHashJoin" not in plan(own.queries()["mapped_features"](spark, sf))


def test_hits_distribution_sends_nothing_exploded_to_the_driver(spark, sf):
    assert "BroadcastHashJoin" not in plan(own.queries()["hits_distribution"](spark, sf))


def test_registry_of_many_jobs_is_quick():
    """Fetches, cancels and deadlines don't go over all jobs: 60,000 events took minutes."""
    r, began = registry.Registry({}, [], 1000, 1), time.monotonic()
    for job in range(20_000):
        r.event("submit", job, None, 0)
    for job in range(0, 20_000, 2):
        r.event("cancel", job, None, 1)
    for job in range(10_000):
        r.event("fetch", None, f"c{job}", 2)
    r.event("fetch", None, "waits", 3)
    r.late(5000)
    assert list(r.waiting) == ["waits"] and not r.jobs
    assert [c[0] for c in r.changes[30_000:40_000]] == list(range(1, 20_000, 2)) and {c[1] for c in r.changes[40_000:]} == {"Failed"}
    assert time.monotonic() - began < 10


def test_stretches_of_few_hits_are_done_together(spark, sf1):
    """60,000 hits in as many stretches nearly; a table a stretch took more than a minute."""
    began = time.monotonic()
    assert own.queries()["linked_lines"](spark, sf1).count() == 60_000
    own.queries()["linked_lines"](spark, sf1).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < 40


def test_words_of_sequences_are_made_after_the_deal(spark, sf):
    """A small file is one task; what it is taken apart to is made where few rows are, and no row of it is shuffled for its sequence's score."""
    for name in ("triplet_complexity", "sequence_entropy"):
        shuffled = [line for line in own.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]
        assert len(shuffled) == 1 and "REPARTITION_BY_NUM" in shuffled[0]


def test_alignments_are_dealt_before_they_are_grouped(spark, sf):
    """Rows come by a number of tasks that grows with them, and no hash table is made of a split of the input."""
    plan = own.queries()["merged_alignments"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    deal = max(k for k, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
    assert not any("HashAggregate" in line for line in plan[deal:])


def test_seeds_of_copies_are_told_once(spark):
    """Keys of the same sequences share their hits; the same rows as without, whatever keys are there twice."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(3)] + [None, "ACG"]
    rows = [(k, texts[k % 5]) for k in range(30)] + [(0, texts[1]), (5, texts[1]), (6, texts[1]), (None, texts[0])]
    df = spark.createDataFrame(rows, "id long, seq string")
    reps, members = H.copies(df, "id", "seq")
    want = H.two_hits(H.word_hits(df, df, "id", "seq", 3), 3, 24)
    got = H.of_all_keys(H.two_hits(H.word_hits(reps, reps, "id", "seq", 3, itself=True), 3, 24), members, "id").select(*want.columns)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    score = F.ascii(F.concat("_qs", "_ss")) + F.length("_qs") * 3 - F.locate("GT", "_ss")
    scored = lambda x, itself: H.with_sequences(H.segments(x, x, "id", "seq", 3, 24, 4, itself=itself).select("q", "s").distinct(), x, x, "id", "seq").select("q", "s", score.alias("score"))
    best = lambda x: sorted(map(tuple, top_k(x.select("q", "s", "score"), ["q"], [F.desc("score"), "s"], 3).collect()))
    assert best(H.best_of_kinds(scored(reps, True), reps, members, "id", 3)) == best(scored(df.where("id is not null"), False))


@pytest.mark.parametrize("name", ["seed_hits_all", "seeded_similarity", "two_hit_seeds"])
def test_seeds_of_all_parts_end(spark, name):
    """20,000 sequences of 64 kinds: none of these ended within 100 s."""
    over = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    over.start()
    try:
        own.queries()[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
    finally:
        over.cancel()


def test_words_of_long_texts_are_quick(spark):
    """Words were found by counting letters from the text's start, each; and each seed carried its whole texts."""
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(f"d{k}", "".join(rng.choice("abcdefgh é") for _ in range(150_000)) + item) for k in range(4)], "id string, text string")
    items = spark.createDataFrame([("i0", item)], "id string, text string")
    began = time.monotonic()
    got = sorted(tuple(r) for r in H.segments(items, docs, "id", "text", 16, 64, 40).collect())
    assert got == [("i0", f"d{k}", 0, 299, 150_000, 150_299, 300) for k in range(4)]
    assert time.monotonic() - began < 15


def test_reads_are_not_made_once_more_for_their_windows(spark, sf):
    """What differences need of a read's span is told by built-ins, and short windows come of one join: no Python and no grouping before it."""
    refs = restore_queries._refs(spark, sf)
    held = restore.held_reads(restore_queries.alignments(spark, sf), refs, "aln")
    plan = held.where("ref_len <= 5000")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
    began = time.monotonic()
    for name in ("restored_reads", "held_bases"):
        own.queries()[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < 60


def test_equal_pairs_are_aligned_once(spark, sf):
    """What is aligned is made distinct before."""
    plan = own.queries()["global_alignments"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython"):]


@pytest.mark.parametrize("name", ["hits_distribution", "mapped_features"])
def test_customers_are_dealt_before_rows_are_made_of_them(spark, sf, name):
    """A small file is one task or two, which made all rows."""
    p = own.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    made = [line for line in p[p.index("REPARTITION_BY_NUM") :].splitlines() if "Generate " in line]
    assert not made and "REPARTITION_BY_NUM" in p


def test_tokens_of_read_names_are_told_once(spark):
    """A group's place held the places of all groups before it, twice each."""
    df = spark.createDataFrame([("r-1-2-3-44-8",), ("r",), ("-1-1-1-1-1",)], "c string").select(X.spot_tokens(F.col("c"), "helicos").alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract") <= 6
    assert [[tuple(x) for x in r.t] for r in df.collect()] == [[("name", 0, 3), ("channel", 4, 1), ("field", 6, 1), ("camera", 8, 2), ("position", 11, 1)], [], [("name", 0, 2), ("channel", 3, 1), ("field", 5, 1), ("camera", 7, 1), ("position", 9, 1)]]


def test_lines_are_split_once(spark):
    """The filter of bad lines put the split line in place of each field, some dozen times a row."""
    lines = spark.createDataFrame([("o", 1)], "o string, n int").select(F.concat_ws("\t", "o", "n", F.lit("10\t1\tF\tc\t1\t10\t+")).alias("value"))
    df = P.agp_problems(P.parse_agp(lines, "failfast"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert df.collect() == []


def test_no_call_of_a_pileup_is_shuffled(spark, sf):
    """Reads are dealt by the places that they lie on and taken apart after; each of their bases was shuffled with the read's name."""
    p = own.queries()["pileup_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    taken_apart = p[: p.index("REPARTITION_BY_NUM")]
    assert "Generate explode" in taken_apart and not any("Exchange " in line for line in taken_apart[: taken_apart.rindex("Generate explode")].splitlines())


def test_index_runs_of_a_key_are_many_tasks(spark):
    """One key's rows were one window; runs go over the ends of ranges as before."""
    rows = [(k, "a") for k in range(0, 40) if k != 17] + [(k, "b") for k in (17, 100, 101)] + [(None, "b")]
    df = spark.createDataFrame(rows, "id long, key string")
    got = B.text_index(df, "id", "key", width=8)
    assert {tuple(r) for r in got.collect()} == {("a", 0, 17), ("a", 18, 22), ("b", 17, 1), ("b", 100, 2), ("b", None, 1)}


def test_a_track_is_many_blocks(spark):
    """A track's rows were one row of one task."""
    df = spark.createDataFrame([("c", 1, k, 0.5) for k in range(10)], "chrom string, span int, pos long, value double")
    assert sorted(r.value.count("\n") for r in W.wiggle_lines(df, width=4).collect()) == [2, 4, 4]


@pytest.mark.parametrize("name", ["term_vectors_normalised", "text_top_terms"])
def test_words_are_made_where_their_document_is(spark, sf, name):
    """Texts are shuffled once by document; each of its words was shuffled, twice in one of these."""
    p = own.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len(by_key) == 1 and "REPARTITION_BY_NUM" in by_key[0]


def test_lone_words_need_no_join_of_all_words(spark, sf):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (None, "a"), (None, "d"), (None, "b"), (3, "e")]
    pairs = spark.createDataFrame(rows, "doc long, w string").distinct()
    assert {tuple(r) for r in N.lone_words(pairs, "doc").collect()} == {(1, 1), (2, 1), (3, 1), (None, 2)}
    p = own.queries()["dictionary_check"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join") == 1


def test_words_of_one_ending_do_not_meet_by_it(spark):
    """Words of 15 to 24 letters meet by what they leave after two deletions: a common ending made pairs of all words that have it (F17)."""
    words = [f"{k:09d}"[::-1].translate(str.maketrans("0123456789", "abcdefghij")) + "ification" for k in range(0, 40_000, 997)]
    rests, moved, placed = N._keys(spark.createDataFrame([(w,) for w in words], "w string"))
    assert rests.count() and not moved.count() and not placed.count()
    got = N.near_words(spark.createDataFrame([("internationalisation",), ("internationalization",), ("nternationalisatio",), ("misinformationalised",)], "w string")).collect()
    assert {tuple(r) for r in got} == {(a, b, d) for x, y, d in (("internationalisation", "internationalization", 1), ("internationalisation", "nternationalisatio", 2)) for a, b in ((x, y), (y, x))}
