"""Registered queries of reads, alignments, masks and row-addressed tables; registered with the others on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import algorithms as A
from strandlake.functions import reads as Q
from strandlake.functions import seq as S
from strandlake.functions import text as X
from strandlake.operators import alignments as L
from strandlake.operators import intervals as I
from strandlake.operators import rows as R
from strandlake.plans import registry as G
from strandlake.queries import D_SQL, S_SQL, dna, query, spans, t, text_of
from strandlake.sources import tables as B
from strandlake.session import dealt

B_SQL = f"(SELECT p_partkey, p_brand, seq, i, substr(seq, i, 1) AS b FROM (SELECT p_partkey, p_brand, seq, CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS i FROM {D_SQL}))"

# --- reads ----------------------------------------------------------------------


@query(f"SELECT p_partkey, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: xor(instr('ACGT', seq[i]) - 1, CASE WHEN i = 1 THEN 3 ELSE instr('ACGT', seq[i - 1]) - 1 END)), ',') AS colors, seq AS back FROM {D_SQL}")
def color_round_trip(spark, d):
    c = Q.color_from_dna(F.col("seq"), "T")
    return dna(spark, d).select("p_partkey", text_of(c).alias("colors"), Q.dna_from_color(c, "T").alias("back"))


@query("SELECT flag, count(*) AS n FROM (SELECT 1 + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 4 ELSE 0 END + CASE l_linenumber WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 1024 ELSE 0 END AS flag FROM lineitem) GROUP BY 1")
def sam_flag_counts(spark, d):
    flag = Q.sam_flags(
        paired=F.lit(True), reverse=F.col("l_returnflag") == "R", unmapped=F.col("l_linestatus") == "O", first=F.col("l_linenumber") == 1, last=F.col("l_linenumber") == 2,
        duplicate=F.col("l_quantity") > 40,
    )
    return t(spark, d, "lineitem").groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


QUAL_SQL = "(SELECT p_partkey, CAST(unnest(range(1, 33)) AS INTEGER) AS i, md5(p_name) AS qual FROM part)"


@query(f"SELECT p_partkey, string_agg(CASE WHEN q < 20 THEN 10 WHEN q < 65 THEN 20 ELSE 30 END, ',' ORDER BY i) AS q FROM (SELECT p_partkey, i, ascii(substr(qual, i, 1)) - 33 AS q FROM {QUAL_SQL}) GROUP BY 1")
def quantized_qualities(spark, d):
    return t(spark, d, "part").select("p_partkey", text_of(Q.quantize(Q.phred(F.md5(F.col("p_name").cast("binary"))), "10:20, 20:65, 30:-")).alias("q"))


@query(f"SELECT q, count(*) AS n FROM (SELECT ascii(substr(qual, i, 1)) - 33 AS q FROM {QUAL_SQL}) GROUP BY 1")
def quality_histogram(spark, d):
    q = F.explode(Q.phred(F.md5(F.col("p_name").cast("binary"))))
    return t(spark, d, "part").select(q.alias("q")).groupBy("q").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' AND NOT (hi < 20 OR lo > 60) AND least(hi, 60) - greatest(lo, 20) > 25 THEN greatest(lo, 20) END AS lo, CASE WHEN l_returnflag <> 'N' AND NOT (hi < 20 OR lo > 60) AND least(hi, 60) - greatest(lo, 20) > 25 THEN least(hi, 60) END AS hi FROM (SELECT *, l_partkey % 30 AS lo, l_partkey % 30 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)")
def read_filter(spark, d):
    r = Q.restrict_read(F.col("l_partkey") % 30, F.col("l_quantity").cast("long"), F.col("l_returnflag") != "N", F.lit(20).cast("long"), F.lit(40).cast("long"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.col("r.start").alias("lo"), F.col("r.stop").alias("hi"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c IN (1, 2, 3) THEN array_to_string(list_transform(range(0, 4), lambda i: v[CASE WHEN i = 0 THEN c + 1 WHEN i = c THEN 1 ELSE i + 1 END]), ',') ELSE array_to_string(v, ',') END AS swapped, array_to_string(list_transform(range(1, 5), lambda i: v[i] - CASE WHEN c = 0 AND i = 2 THEN v[1] WHEN c = 2 AND i = 4 THEN v[3] ELSE 0 END), ',') AS scaled, array_to_string(v, ',') AS back FROM (SELECT *, l_linenumber % 4 AS c, [l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)] AS v FROM lineitem)")
def intensity_vectors(spark, d):
    v, c = F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")), F.col("l_linenumber").cast("int") % 4
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), c.alias("c"))
    scaled = Q.normalize(F.col("v"), F.col("c"))
    return x.select("l_orderkey", "l_linenumber", text_of(Q.swap(F.col("v"), F.col("c"))).alias("swapped"), text_of(scaled).alias("scaled"), text_of(Q.denormalize(scaled, F.col("c"))).alias("back"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN x < 0 THEN 1000 - (-x) % 1000 WHEN x > 1000 THEN x % 1000 ELSE x END AS place, (l_partkey - 1) * 500 + l_suppkey AS whole, CAST(floor(((l_partkey - 1) * 500 + l_suppkey) / 700) AS BIGINT) + 1 AS row_id, ((l_partkey - 1) * 500 + l_suppkey) % 700 AS local FROM (SELECT *, l_orderkey - 900 AS x FROM lineitem)")
def reference_places(spark, d):
    whole = Q.global_place(F.col("l_partkey"), F.col("l_suppkey"), F.lit(1), 500)
    place = Q.circular_offset(F.col("l_orderkey") - 900, F.lit(1000).cast("long"), F.lit(True))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"), whole.alias("whole"), Q.local_row(whole, 700).alias("row_id"), Q.local_place(whole, 700).alias("local"))


@query()
def dinucleotide_repeats(spark, d):
    return dna(spark, d).select("p_partkey", F.explode(Q.nmer_repeats(F.col("seq"), 2, 2)).alias("m")).select("p_partkey", "m.*")


@query(f"SELECT p_partkey, array_to_string(list_filter(range(0, length(seq) - 2), lambda i: regexp_full_match(substr(seq, i + 1, 3), '[AG][CT]G')), ',') AS places FROM {D_SQL}")
def ambiguous_matches(spark, d):
    return dna(spark, d).select("p_partkey", text_of(Q.find_matches(F.col("seq"), "RYG", "yes")).alias("places"))


@query(f"SELECT p_partkey, string_agg(b || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY lo) AS runs, any_value(seq) AS back FROM (SELECT p_partkey, seq, b, min(i) AS lo, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, b ORDER BY i) AS g FROM {B_SQL}) GROUP BY p_partkey, seq, b, g) GROUP BY 1")
def transcript_runs(spark, d):
    r = Q.rle_text(F.col("seq"))
    return dna(spark, d).select("p_partkey", r.alias("runs"), Q.rle_text_back(r).alias("back"))


@query(f"WITH b AS {B_SQL}, p AS (SELECT b, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM b) AS p FROM b GROUP BY 1), k AS (SELECT substr(seq, i, 5) AS kmer, count(*) AS n FROM b WHERE i <= length(seq) - 4 GROUP BY 1), e AS (SELECT kmer, n, (SELECT CAST(sum(n) AS BIGINT) FROM k) * p1.p * p2.p * p3.p * p4.p * p5.p AS expected FROM k JOIN p p1 ON p1.b = kmer[1] JOIN p p2 ON p2.b = kmer[2] JOIN p p3 ON p3.b = kmer[3] JOIN p p4 ON p4.b = kmer[4] JOIN p p5 ON p5.b = kmer[5]) SELECT kmer, n, round(expected, 6) AS expected, round(n / expected, 6) AS ratio FROM e")
def kmer_observed_expected(spark, d):
    """5-mers against what the shares of single bases let expect; both counts come of one pass, and the shares are one row."""
    x = dna(spark, d)
    share = [(S.count_of(F.col("seq"), b)) for b in "ACGT"]
    total = x.agg(*[F.sum(c).alias(b) for c, b in zip(share, "ACGT")], F.sum(F.length("seq")).alias("bases"), F.sum(F.greatest(F.length("seq") - 4, F.lit(0))).alias("kmers"))
    n = x.select(F.explode(S.kmers(F.col("seq"), 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).join(F.broadcast(total))
    p = lambda i: F.when(F.substring("kmer", i, 1) == "A", F.col("A")).when(F.substring("kmer", i, 1) == "C", F.col("C")).when(F.substring("kmer", i, 1) == "G", F.col("G")).otherwise(F.col("T")) / F.col("bases").cast("double")
    expected = F.col("kmers")
    for i in range(1, 6):
        expected = expected * p(i)
    return n.select("kmer", "n", F.round(expected, 6).alias("expected"), F.round(F.col("n") / expected, 6).alias("ratio"))


# --- alignments -----------------------------------------------------------------


def reads_on_parts(spark, d):
    """Stand-in alignments: ten bases of a part's sequence for each line, some with A read as C."""
    x = t(spark, d, "lineitem").join(dna(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    pos = F.col("l_orderkey") % 20 + 1
    cut = F.substring("seq", pos.cast("int"), F.lit(10))
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0).alias("flag"), F.col("l_partkey").alias("ref"), pos.alias("pos"),
        F.lit(30).alias("mapq"), F.lit("10M").alias("cigar"), F.when(F.col("l_linenumber") % 3 == 0, F.translate(cut, "A", "C")).otherwise(cut).alias("seq"), F.lit("IIIIIIIIII").alias("qual"),
    )


P_SQL = f"(SELECT l_orderkey || '-' || l_linenumber AS name, l_linenumber % 2 = 0 AS back, l_partkey AS ref, l_orderkey % 20 + 1 AS pos, seq AS refseq, CASE WHEN l_linenumber % 3 = 0 THEN translate(substr(seq, l_orderkey % 20 + 1, 10), 'A', 'C') ELSE substr(seq, l_orderkey % 20 + 1, 10) END AS read FROM lineitem JOIN {D_SQL} ON l_partkey = p_partkey)"


@query(
    "SELECT ref, place AS pos, base, CAST(count(*) AS INTEGER) AS depth, string_agg(call, '' ORDER BY pos, name, back, b) AS calls, string_agg('I', '') AS quals FROM (SELECT *, CASE WHEN k = 0 THEN '^?' ELSE '' END || CASE WHEN b = base THEN CASE WHEN back THEN ',' ELSE '.' END WHEN back THEN lower(b) ELSE b END || CASE WHEN k = 9 THEN '$' ELSE '' END AS call FROM "
    f"(SELECT *, pos + k AS place, substr(read, k + 1, 1) AS b, substr(refseq, pos + k, 1) AS base FROM (SELECT *, CAST(unnest(range(0, 10)) AS BIGINT) AS k FROM {P_SQL}))) GROUP BY 1, 2, 3"
)
def pileup_rows(spark, d):
    return L.pileup(reads_on_parts(spark, d), dna(spark, d).select(F.col("p_partkey").alias("ref"), "seq"))


@query(f"SELECT ref, place AS pos, CAST(sum(d) OVER (PARTITION BY ref ORDER BY place) AS BIGINT) AS depth FROM (SELECT ref, place, sum(d) AS d FROM (SELECT ref, pos AS place, 1 AS d FROM {P_SQL} UNION ALL SELECT ref, pos + 10, -1 FROM {P_SQL}) GROUP BY 1, 2 HAVING sum(d) <> 0)")
def coverage_track(spark, d):
    return L.coverage_graph(reads_on_parts(spark, d))


FO_SQL = f"a AS (SELECT s.o_custkey, s.o_orderkey AS a, lo, hi FROM {S_SQL} s JOIN orders o USING (o_orderkey) WHERE o_orderstatus = 'F'), b AS (SELECT s.o_custkey, s.o_orderkey AS b, lo, hi FROM {S_SQL} s JOIN orders o USING (o_orderkey) WHERE o_orderstatus = 'O')"


@query(
    f"WITH {FO_SQL}, same AS (SELECT a, b FROM a JOIN b USING (o_custkey, lo, hi)), ra AS (SELECT * FROM a WHERE a NOT IN (SELECT a FROM same)), rb AS (SELECT * FROM b WHERE b NOT IN (SELECT b FROM same)), "
    "meet AS (SELECT a, b FROM ra JOIN rb ON ra.o_custkey = rb.o_custkey AND ra.lo <= rb.hi AND rb.lo <= ra.hi) SELECT 'equivalent' AS kind, a, b FROM same UNION ALL SELECT 'overlap', a, b FROM meet "
    "UNION ALL SELECT 'only_1', a, NULL FROM ra WHERE a NOT IN (SELECT a FROM meet) UNION ALL SELECT 'only_2', NULL, b FROM rb WHERE b NOT IN (SELECT b FROM meet)"
)
def alignment_set_compare(spark, d):
    s = spans(spark, d).join(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    a, b = (s.where(F.col("o_orderstatus") == k).select("o_custkey", F.col("o_orderkey").alias(n), "lo", "hi") for k, n in (("F", "a"), ("O", "b")))
    return L.compare_sets(a, b, "o_custkey", "a", "b", 32)


@query()
def annotation_compare(spark, d):
    """Merged spans of filled and of open orders, as two features of each customer."""
    s = spans(spark, d).join(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    side = lambda k, n: I.islands(s.where(F.col("o_orderstatus") == k), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias(n))
    both = side("F", "a").join(side("O", "b"), "o_custkey")
    return both.groupBy(L.compare_features(F.col("a"), F.col("b"), F.lit("+"), F.lit("+")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "SELECT x.l_orderkey AS read, x.l_returnflag AS subject, x.l_partkey AS hit1, y.l_partkey AS hit2, greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1 AS span FROM "
    "(SELECT *, l_suppkey AS lo, l_suppkey + 9 AS hi, l_quantity > 25 AS fwd FROM lineitem WHERE l_linenumber = 1) x JOIN (SELECT *, l_suppkey AS lo, l_suppkey + 9 AS hi, l_quantity > 25 AS fwd FROM lineitem WHERE l_linenumber = 2) y USING (l_orderkey, l_returnflag) "
    "WHERE greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1 BETWEEN 10 AND 60 AND CASE WHEN x.lo <= y.lo THEN x.fwd AND NOT y.fwd ELSE y.fwd AND NOT x.fwd END"
)
def paired_hits(spark, d):
    h = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("mate"), F.col("l_returnflag").alias("subject"), F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + 9).alias("hi"),
        F.when(F.col("l_quantity") > 25, "+").otherwise("-").alias("strand"), F.col("l_partkey").alias("hit"),
    )
    return L.pair_hits(h, 10, 60)


@query(
    "SELECT o_custkey, o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders JOIN (SELECT * FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY max(o_totalprice) DESC, o_orderpriority) AS k "
    "FROM orders GROUP BY 1, 2) WHERE k <= 2) USING (o_custkey, o_orderpriority) QUALIFY rank <= 2"
)
def hit_lists(spark, d):
    return L.hit_list(t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey", 2, 2).select("o_custkey", "o_orderpriority", "o_orderkey", "rank")


@query(
    f"SELECT o_custkey, CAST(part AS BIGINT) AS part, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS part FROM (SELECT *, CASE WHEN lo - lag(hi) OVER w > 2.5 * (lag(hi) OVER w - lag(lo) OVER w + 1) OR lag(hi) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM {S_SQL} WINDOW w AS (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey))) GROUP BY 1, 2"
)
def joined_compartments(spark, d):
    return L.join_compartments(spans(spark, d), "o_custkey", 2.5).groupBy("o_custkey", "part").agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, l_linenumber, round(100.0 * m / (m + x + g), 6) AS pct_identity, round(100.0 * (m + x) / 60, 6) AS pct_coverage, round(CASE WHEN m + x > 0 THEN 100.0 * m / (m + x) ELSE 0 END, 6) AS pct_identity_ungapped, "
    "round(m * 1.0 / (m + x + g) * (1 - exp(-0.02 * (m + x + g))), 6) AS weighted_identity FROM (SELECT *, CAST(l_quantity AS BIGINT) AS m, l_linenumber AS x, l_suppkey % 3 AS g FROM lineitem)"
)
def alignment_score_table(spark, d):
    m, x, g = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey") % 3
    s = L.alignment_scores(m, x, g, m + x, F.lit(60))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in s.items()])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE k <= ceil(n * 0.25)")
def trimmed_share(spark, d):
    return L.trim_pct(t(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 0.25).select("o_custkey", "o_orderkey")


@query()
def global_alignments(spark, d):
    """Score and CIGAR of each part's sequence against the next part's."""
    x = dna(spark, d)
    y = x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("seq").alias("next"))
    pairs = x.join(y, "p_partkey").select("p_partkey", "seq", "next")
    # parts of one name share their sequence: each pair of sequences is aligned once; nulls meet as before
    made = dealt(pairs.select("seq", "next").distinct(), "seq", "next", rows=512).select(F.col("seq").alias("_a"), F.col("next").alias("_b"), A.global_cigar("seq", "next").alias("g"))
    return pairs.join(made, F.col("seq").eqNullSafe(F.col("_a")) & F.col("next").eqNullSafe(F.col("_b"))).select("p_partkey", "g.*")


# --- sparse sets ----------------------------------------------------------------


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT DISTINCT o_custkey * 37 AS id FROM orders)")
def sparse_rank(spark, d):
    return R.sparse_rank(t(spark, d, "orders").select((F.col("o_custkey") * 37).alias("id")), "id")


@query("SELECT o_custkey, k, CAST(coalesce(a, 0) + coalesce(b, 0) AS BIGINT) AS added, a IS NOT NULL AND b IS NULL AS only_a FROM (SELECT o_custkey, o_orderpriority AS k, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) FULL JOIN (SELECT o_custkey, o_orderpriority AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) USING (o_custkey, k)")
def score_vectors_combined(spark, d):
    """Sums and differences of two sparse vectors a key, by one grouping."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    g = t(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey", F.col("o_orderpriority").alias("k")).agg(n("F").alias("a"), n("O").alias("b"))
    return g.select("o_custkey", "k", (F.col("a") + F.col("b")).alias("added"), ((F.col("a") > 0) & (F.col("b") == 0)).alias("only_a"))


# --- row-addressed tables -------------------------------------------------------


@query("SELECT c_custkey || ',' || CASE WHEN regexp_matches(c_mktsegment, '[\",\\n\\r]') THEN '\"' || replace(c_mktsegment, '\"', '\"\"') || '\"' ELSE c_mktsegment END || ',' || c_nationkey AS value FROM customer WHERE c_custkey BETWEEN 1 AND 40 OR c_custkey = 77 OR c_custkey BETWEEN 100 AND 120")
def dump_csv(spark, d):
    return B.dump(B.chosen(t(spark, d, "customer").where(B.in_rows(F.col("c_custkey"), "1-30,77,100-120,20-40")), ["c_custkey", "c_mktsegment", "c_nationkey"]), "csv")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def dump_json(spark, d):
    return B.dump(B.chosen(t(spark, d, "nation"), without=["n_regionkey"]), "json")


@query("SELECT 'c_custkey' AS name, 'bigint' AS type, count(c_custkey) AS filled, 1 AS least, 1 AS most, true AS fixed FROM customer UNION ALL SELECT 'c_name', 'string', count(c_name), CAST(min(length(c_name)) AS INTEGER), CAST(max(length(c_name)) AS INTEGER), min(length(c_name)) = max(length(c_name)) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), CAST(min(length(c_mktsegment)) AS INTEGER), CAST(max(length(c_mktsegment)) AS INTEGER), min(length(c_mktsegment)) = max(length(c_mktsegment)) FROM customer")
def column_lengths(spark, d):
    return B.column_report(B.chosen(t(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"]))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN repeat('N', length(o_orderpriority)) ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS o_custkey FROM orders")
def redacted_copy(spark, d):
    return B.redact(t(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderpriority", "o_custkey"]).select("o_orderkey", "o_orderpriority", "o_custkey")


@query("SELECT key, min(id) AS first, count(*) AS n FROM (SELECT *, id - row_number() OVER (PARTITION BY key ORDER BY id) AS g FROM (SELECT o_orderstatus AS key, o_orderkey AS id FROM orders)) GROUP BY key, g")
def text_index_runs(spark, d):
    return B.text_index(t(spark, d, "orders"), "o_orderkey", "o_orderstatus")


@query("SELECT min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END IS NOT NULL")
def column_id_range(spark, d):
    return B.id_range(t(spark, d, "orders").withColumn("open", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))), "o_orderkey", "open")


@query("SELECT cache_key, subkey, version, touched_us FROM (SELECT user_id AS cache_key, event_type AS subkey, event_id AS version, epoch_us(ts) AS touched_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND cache_key IN (SELECT c_custkey FROM customer)")
def cache_newest(spark, d):
    """Newest versions of the keys that customers have; ``cache_newest_all`` asks for all keys."""
    e = t(spark, d, "events").select(F.col("user_id").alias("cache_key"), F.col("event_type").alias("subkey"), F.col("event_id").alias("version"), F.unix_micros(F.col("ts").cast("timestamp")).alias("touched_us"))
    keys = t(spark, d, "customer").select(F.col("c_custkey").alias("cache_key"))
    return B.cache_get(e, keys)


@query("SELECT cache_key, subkey, version, touched_us FROM (SELECT user_id AS cache_key, event_type AS subkey, event_id AS version, epoch_us(ts) AS touched_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def cache_newest_all(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("cache_key"), F.col("event_type").alias("subkey"), F.col("event_id").alias("version"), F.unix_micros(F.col("ts").cast("timestamp")).alias("touched_us"))
    return B.cache_get(e, e.select("cache_key").distinct())


@query(f"SELECT p_brand, CAST(sum(length(seq)) AS BIGINT) AS total, md5(string_agg(seq, '' ORDER BY p_partkey)) AS md5 FROM {D_SQL} GROUP BY 1")
def reference_checksums(spark, d):
    return B.id_checksums(dna(spark, d), "p_brand", "p_partkey", "seq").select("p_brand", "total", "md5")


# --- text and edits -------------------------------------------------------------


@query(
    "SELECT o_orderkey, CASE WHEN op = 'upsert' THEN q ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'upsert' END, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber) AS op, "
    "arg_max(l_partkey, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey WHERE op IS DISTINCT FROM 'delete'"
)
def edited_orders(spark, d):
    """Orders after the committed edits that lines stand for."""
    e = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("upsert").alias("op"),
        (F.col("l_linestatus") == "F").alias("committed"), F.col("l_partkey").alias("o_custkey"),
    )
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return G.apply_edits(o, e.join(o.select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey")


@query("SELECT doc_id, least(CASE WHEN instr(text, 'token') > 0 THEN instr(text, 'token') ELSE 1000000000 END, CASE WHEN instr(text, 'data') > 0 THEN instr(text, 'data') ELSE 1000000000 END) - 1 AS place FROM documents WHERE contains(text, 'token') OR contains(text, 'data')")
def text_multi_search(spark, d):
    place = X.fgrep(F.col("text"), ["token", "data"])
    return t(spark, d, "documents").where(place >= 0).select("doc_id", place.alias("place"))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_type, '^.*S.*$') AND NOT regexp_matches(p_type, '^E.*$') AND p_name NOT LIKE '%x'")
def text_wildcards(spark, d):
    return t(spark, d, "part").where(X.wildcard(F.col("p_type"), ["*S*"], ["E*"]) & X.wildcard(F.col("p_name"), exclude=["*x"])).select("p_partkey", "p_brand")


@query()
def text_approximate_search(spark, d):
    """Benchmark items by where a phrase stands in them with at most two edits."""
    return t(spark, d, "documents").select("doc_id", X.agrep(F.col("text"), "tokens", 2).alias("at")).where("at is not null")


#: Names of reads of a customer's number (k) and nation (n), and the tokens that they have.
_SPOTS = {
    "illumina": ("concat('Run', k, ':3:17:', n, ':-5')", "concat('name=Run', k, ';lane=3;tile=17;x=', n, ';y=-5')"),
    "abi": ("concat('r_', n, '_', k, '_7')", "concat('name=r;panel=', n, ';x=', k, ';y=7')"),
    "ion_torrent": ("concat('RUN5:', n, ':', k)", "concat('name=RUN5;row=', n, ';col=', k)"),
    "454": ("concat('ABCDEFG', lpad(n, 2, '0'), 'A1B2C')", "concat('name=ABCDEFG;region=', lpad(n, 2, '0'), ';xy=A1B2C')"),
    "helicos": ("concat('r-1-', n, '-3-', k, '-8')", "concat('name=r-1;channel=', n, ';field=3;camera=', k, ';position=8')"),
}


@query(" UNION ALL ".join(f"SELECT '{p}' AS platform, c_custkey, {want} AS tokens FROM (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS n, CAST(c_custkey AS VARCHAR) AS k FROM customer)" for p, (_, want) in _SPOTS.items()))
def spot_name_tokens(spark, d):
    """Coordinates of the read names of five platforms, as tokens of the names."""
    out = None
    own = dealt(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    for platform, (made, _) in _SPOTS.items():
        x = own.select("c_custkey", F.col("c_nationkey").cast("string").alias("n"), F.col("c_custkey").cast("string").alias("k")).select("c_custkey", F.expr(made).alias("spot"))
        x = x.withColumn("tok", X.spot_tokens(F.col("spot"), platform))
        text = F.array_join(F.transform("tok", lambda p: F.concat(p["name"], F.lit("="), F.substr("spot", p["start"] + 1, p["length"]))), ";")
        x = x.select(F.lit(platform).alias("platform"), "c_custkey", text.alias("tokens"))
        out = x if out is None else out.unionByName(x)
    return out
