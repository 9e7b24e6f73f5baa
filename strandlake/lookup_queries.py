"""Registered queries of lookups, sets of ids, mapped places, reports and jobs; registered with the others on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import lookups as L
from strandlake.operators.intervals import islands, overlap_join
from strandlake.plans.query import predicate
from strandlake.queries import D_SQL, S_SQL, _ab_spans, dna, query, spans, t
from strandlake.session import dealt

# --- lookups --------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rows_with_ids(spark, d):
    ids = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.with_ids(t(spark, d, "orders"), "o_custkey", ids).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def batch_deleted(spark, d):
    keys = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.without_ids(t(spark, d, "orders"), "o_orderkey", keys).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def cursor_updates(spark, d):
    """Rows at which a cursor stands, with new values."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    test = predicate("o_orderstatus = 'O' AND o_totalprice > 1000")
    return L.updated(o, test, {"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("X")}).drop("o_totalprice")


@query("SELECT l_orderkey, l_linenumber, substr(p_name, l_linenumber + 1, 4) AS part FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def sub_selected(spark, d):
    """Four characters of another table's cell, by row id; half of the ids have no row."""
    x = t(spark, d, "lineitem").withColumn("row", F.col("l_partkey") * 2)
    return L.fetched(x, "row", t(spark, d, "part"), "p_partkey", "p_name", F.col("l_linenumber"), F.lit(4), "part").select("l_orderkey", "l_linenumber", "part")


@query(
    "WITH k AS (SELECT DISTINCT 'NM_' || l_partkey AS a, l_linenumber AS v, 'NM_' || l_partkey || CASE WHEN l_linenumber > 4 THEN '' ELSE '.' || l_linenumber END AS id, l_linenumber > 4 AS bare FROM lineitem), "
    "s AS (SELECT DISTINCT 'NM_' || p_partkey AS a, p_partkey % 3 AS v, 'NM_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_partkey % 3 END AS id, p_partkey % 3 = 0 AS bare FROM part) "
    "SELECT DISTINCT s.id AS asked, k.id AS known FROM s JOIN k ON s.a = k.a WHERE s.bare OR k.bare OR s.v = k.v"
)
def id_synonyms(spark, d):
    known = t(spark, d, "lineitem").select(F.concat(F.lit("NM_"), "l_partkey", F.when(F.col("l_linenumber") > 4, "").otherwise(F.concat(F.lit("."), "l_linenumber"))).alias("id"))
    v = F.col("p_partkey") % 3
    asked = t(spark, d, "part").select(F.concat(F.lit("NM_"), "p_partkey", F.when(v == 0, "").otherwise(F.concat(F.lit("."), v.cast("string")))).alias("id"))
    return L.matching_ids(asked, known)


@query("SELECT o_orderkey AS gi, n_nationkey AS taxid, n_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def taxids(spark, d):
    """Ids to taxa and their names, by two lookups; ids without one stay."""
    owner = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("taxid"))
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("taxid"), F.col("n_name").alias("name"))
    return t(spark, d, "orders").join(owner, "o_custkey", "left").join(names, "taxid", "left").select(F.col("o_orderkey").alias("gi"), "taxid", "name")


def _customers(spark, d):
    """Keys that some fifty rows are made of each: their file is small and one task or two, so they are dealt before."""
    return dealt(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", rows=1 << 14)


SEG_SQL = "(SELECT c_custkey AS o_custkey, 8000 + k * 40 AS src_lo, 8000 + k * 40 + 29 AS src_hi, c_custkey * 100 + k AS dst, 1000 AS dst_lo, k % 2 = 0 AS forward FROM customer, (SELECT unnest(range(0, 66)) AS k))"


@query(
    "SELECT f, dst, dlo AS dst_lo, dlo + b - a AS dst_hi, CASE WHEN forward THEN strand WHEN strand = '+' THEN '-' ELSE '+' END AS strand, lo < src_lo OR hi > src_hi AS partial FROM (SELECT *, CASE WHEN forward THEN dst_lo + a - src_lo ELSE dst_lo + src_hi - b END AS dlo FROM "
    f"(SELECT s.o_orderkey AS f, s.lo, s.hi, CASE WHEN s.o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, g.*, greatest(s.lo, src_lo) AS a, least(s.hi, src_hi) AS b FROM {S_SQL} s JOIN {SEG_SQL} g ON s.o_custkey = g.o_custkey AND s.lo <= g.src_hi AND g.src_lo <= s.hi))"
)
def mapped_features(spark, d):
    """Features on the coordinates of the segments that their places are mapped to, half of them in reverse."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(65).cast("long"))).alias("k")
    seg = _customers(spark, d).select("o_custkey", k)
    seg = seg.select("o_custkey", (F.col("k") * 40 + 8000).alias("src_lo"), (F.col("k") * 40 + 8029).alias("src_hi"), (F.col("o_custkey") * 100 + F.col("k")).alias("dst"), F.lit(1000).alias("dst_lo"), (F.col("k") % 2 == 0).alias("forward"))
    f = spans(spark, d).select("o_custkey", F.col("o_orderkey").alias("f"), "lo", "hi", F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    return L.mapped(f, seg, "o_custkey", 64)


RANGE_SQL = f"(SELECT o_custkey, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS run FROM (SELECT *, CASE WHEN lo <= 20 + max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM (SELECT o_custkey, o_orderkey, greatest(lo - 5, 0) AS lo, hi + 5 AS hi FROM {S_SQL}))) GROUP BY o_custkey, run)"


@query(f"SELECT o_custkey, lo, hi, CAST(n AS BIGINT) AS n FROM {RANGE_SQL}")
def subject_ranges(spark, d):
    return L.range_sets(spans(spark, d), "o_custkey", 20, 5, width=128).withColumn("n", F.col("n").cast("long"))


@query(f"SELECT DISTINCT r.o_custkey, r.lo AS r_lo, s.o_orderkey % 10 AS query FROM {RANGE_SQL} r JOIN {S_SQL} s ON r.o_custkey = s.o_custkey AND r.lo <= s.hi AND s.lo <= r.hi")
def subject_range_queries(spark, d):
    hits = spans(spark, d)
    r = L.range_sets(hits, "o_custkey", 20, 5, width=128)
    return L.queries_of_ranges(r, hits.withColumn("query", F.col("o_orderkey") % 10), "o_custkey", "query", 64)


MODEL_SQL = "(SELECT c_custkey AS o_custkey, k AS model, 8000 + k * 55 AS m_lo, 8000 + k * 55 + 70 AS m_hi FROM customer, (SELECT unnest(range(0, 46)) AS k))"


@query(f"SELECT hit, model, overlap FROM (SELECT s.o_orderkey AS hit, m.model, least(s.hi, m.m_hi) - greatest(s.lo, m.m_lo) + 1 AS overlap, row_number() OVER (PARTITION BY s.o_orderkey ORDER BY least(s.hi, m.m_hi) - greatest(s.lo, m.m_lo) DESC, m.model) AS k FROM {S_SQL} s JOIN {MODEL_SQL} m ON s.o_custkey = m.o_custkey AND s.lo <= m.m_hi AND m.m_lo <= s.hi) WHERE k = 1")
def hits_distribution(spark, d):
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(45).cast("long"))).alias("model")
    models = _customers(spark, d).select("o_custkey", k).withColumns({"m_lo": F.col("model") * 55 + 8000, "m_hi": F.col("model") * 55 + 8070})
    return L.shared_out(spans(spark, d).withColumnRenamed("o_orderkey", "hit"), models, "o_custkey", "hit", "model", 64)


PAIR_SQL = f"(SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM {S_SQL} x JOIN {S_SQL} y ON x.o_custkey = y.o_custkey AND x.lo <= y.hi AND y.lo <= x.hi AND x.o_orderkey < y.o_orderkey)"


@query(f"SELECT o_orderkey FROM {S_SQL} x WHERE NOT EXISTS (SELECT 1 FROM (SELECT a, b FROM {PAIR_SQL} UNION ALL SELECT b, a FROM {PAIR_SQL}) p JOIN {S_SQL} y ON y.o_orderkey = p.b WHERE p.a = x.o_orderkey AND (y.s > x.s OR y.s = x.s AND y.o_orderkey < x.o_orderkey))")
def non_redundant(spark, d):
    """Spans that no overlapping span of better score stands for."""
    a, b = _ab_spans(spark, d)
    pairs = overlap_join(a, b, "o_custkey", 32).where("a < b").select("a", "b")
    return L.representatives(spans(spark, d), pairs, "o_orderkey", "s").select("o_orderkey")


BLOCK_SQL = f"(SELECT o_custkey, o_orderkey % 2 AS row, lo, hi FROM {S_SQL})"


@query(
    f"WITH b AS {BLOCK_SQL}, p AS (SELECT DISTINCT o_custkey, row, unnest(range(lo, hi + 1)) AS p FROM b), r AS (SELECT o_custkey, count(DISTINCT row) AS rows FROM b GROUP BY 1), c AS (SELECT o_custkey, p FROM p JOIN r USING (o_custkey) GROUP BY o_custkey, p, rows HAVING count(*) = rows) "
    "SELECT o_custkey, min(p) AS lo, max(p) AS hi FROM (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS g FROM c) GROUP BY o_custkey, g"
)
def shared_blocks(spark, d):
    """Stretches that blocks of every row of a key cover; neighbouring ones are one."""
    b = spans(spark, d).select("o_custkey", (F.col("o_orderkey") % 2).alias("row"), "lo", "hi")
    return islands(L.shared_blocks(b, "o_custkey", "row"), "o_custkey", gap=1).select("o_custkey", "lo", "hi")


@query(
    "SELECT q, s, min(lo) AS q_lo, max(hi) AS q_hi, min(lo) + dg AS s_lo, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY q, s, dg ORDER BY lo, hi, id) AS run FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY q, s, dg ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM "
    "(SELECT l_suppkey AS q, l_returnflag AS s, l_linenumber AS dg, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi, l_orderkey * 10 + l_linenumber AS id FROM lineitem))) GROUP BY q, s, dg, run"
)
def merged_alignments(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("s"), F.col("l_partkey").alias("q_lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("q_hi"), (F.col("l_partkey") + F.col("l_linenumber")).alias("s_lo"))
    return L.merged_on_diagonals(a, ["q", "s"]).withColumn("n", F.col("n").cast("long"))


@query(f"SELECT o_custkey, before, after, least(phi, lo) AS from_place, greatest(phi, lo) AS to_place, lo - phi - 1 AS gap FROM (SELECT o_custkey, lag(o_orderkey) OVER w AS before, o_orderkey AS after, lag(hi) OVER w AS phi, lo FROM {S_SQL} WINDOW w AS (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey)) WHERE before IS NOT NULL")
def segment_switches(spark, d):
    return L.switch_points(spans(spark, d).withColumnRenamed("o_orderkey", "name"), "o_custkey")


# --- sets of ids ----------------------------------------------------------------


@query("SELECT id, lag(id) OVER (ORDER BY id) AS before, lead(id) OVER (ORDER BY id) AS after, max(id) OVER (PARTITION BY g) + 1 AS gap FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM (SELECT DISTINCT l_partkey * 7 + l_linenumber AS id FROM lineitem))")
def sparse_neighbours(spark, d):
    """Ids before and after each id of a sparse set, and the next free one."""
    return L.neighbours(t(spark, d, "lineitem").select((F.col("l_partkey") * 7 + F.col("l_linenumber")).alias("id")), "id")


@query("SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders UNION ALL SELECT l_partkey * 40 FROM lineitem UNION ALL SELECT 0)")
def merged_id_blobs(spark, d):
    """Two sets as bitmaps, merged without being unfolded, and the ids that the union holds."""
    a = L.bitsets(t(spark, d, "orders").select(F.col("o_custkey").alias("id")).unionByName(spark.range(1)), "id")
    b = L.bitsets(t(spark, d, "lineitem").select((F.col("l_partkey") * 40).alias("id")), "id")
    return L.ids_of_bitsets(L.merged_bitsets(a, b), "id")


@query("SELECT min(id) AS first, max(id) AS last, CAST(c AS BIGINT) AS n FROM (SELECT id, c, id - row_number() OVER (PARTITION BY c ORDER BY id) AS g FROM (SELECT o_custkey AS id, count(*) AS c FROM orders GROUP BY 1)) GROUP BY c, g")
def id_count_runs(spark, d):
    """Stretches of ids with one count each."""
    x = t(spark, d, "orders").select("o_custkey", F.lit(1).alias("one"))
    return L.count_runs(x, "o_custkey", "one")


# --- reports and jobs -----------------------------------------------------------


@query("SELECT * FROM (SELECT event_id AS job, user_id, us FROM (SELECT *, epoch_us(ts) AS us FROM events) WHERE event_type = 'view' ORDER BY user_id IN (7, 9) DESC, user_id % 5 DESC, event_id LIMIT 25)")
def fetched_jobs(spark, d):
    """The next pending jobs: of two preferred affinities first, then by priority and id."""
    e = t(spark, d, "events").select(
        F.col("event_id").alias("job"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").cast("string").alias("affinity"), (F.col("user_id") % 5).alias("priority"),
        F.when(F.col("event_type") == "view", "Pending").otherwise("Done").alias("state"),
    )
    return L.next_jobs(e, 25, ["7", "9"]).select("job", "user_id", "us")


#: The subjects of the hit matrix: market segments are a fixed list in these tables.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT n_regionkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS) + f", count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment NOT IN {SEGMENTS}) AS other FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def hit_matrix(spark, d):
    """Hits by query and subject, each subject a column; subjects beyond the list, and null, are counted together."""
    x = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return L.count_matrix(x, "n_regionkey", "c_mktsegment", SEGMENTS)


@query("SELECT 'reads' AS module, 'count' AS key, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT 'reads', 'bases', CAST(sum(length(text)) AS VARCHAR) FROM documents UNION ALL SELECT 'reads', 'shortest', CAST(min(length(text)) AS VARCHAR) FROM documents UNION ALL SELECT 'reads', 'longest', CAST(max(length(text)) AS VARCHAR) FROM documents UNION ALL SELECT 'spots', 'first', CAST(min(doc_id) AS VARCHAR) FROM documents UNION ALL SELECT 'spots', 'last', CAST(max(doc_id) AS VARCHAR) FROM documents")
def read_set_report(spark, d):
    """Table-level counts as a key-value report of two modules."""
    n = F.length("text")
    modules = {"reads": {"count": F.count("*"), "bases": F.sum(n), "shortest": F.min(n), "longest": F.max(n)}, "spots": {"first": F.min("doc_id"), "last": F.max("doc_id")}}
    return L.key_values(t(spark, d, "documents"), modules)


@query("SELECT 0 AS place, 'r_regionkey' AS name, 'int' AS type, true AS nullable UNION ALL SELECT 1, 'r_name', 'string', true")
def result_metadata(spark, d):
    x = t(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
    return L.schema_table(x)


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_nationkey BETWEEN 3 AND 18 GROUP BY 1")
def parameterised_sql(spark, d):
    """A statement with parameters over named frames."""
    return spark.sql("SELECT c_mktsegment, count(*) AS n, sum(c_nationkey) AS total FROM {customers} WHERE c_nationkey BETWEEN :low AND :high GROUP BY 1", args={"low": 3, "high": 18}, customers=t(spark, d, "customer"))


# --- volumes, sets and titles ---------------------------------------------------


@query("SELECT o_orderkey, coalesce(n, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey, c_custkey + 1000000 AS n FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def mapped_ids(spark, d):
    """Ids by a mapping that knows some of them."""
    m = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1_000_000).alias("to"))
    return L.id_mapped(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", m)


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_orderkey) AS last, count(*) AS n FROM lineitem GROUP BY 1")
def merged_volumes(spark, d):
    """Three volumes of one table, merged by key."""
    x = t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_orderkey", "l_returnflag")
    volumes = [x.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"]
    return L.merged_volumes(volumes, "l_partkey", {"quantity": F.sum("q"), "last": F.max("l_orderkey"), "n": F.count("*")})


@query("SELECT l_suppkey AS q, string_agg(s || '(' || subjects || ')', ' ' ORDER BY s) AS sets FROM (SELECT l_suppkey, l_returnflag AS s, string_agg(n, ',' ORDER BY l_linenumber) AS subjects FROM (SELECT l_suppkey, l_returnflag, l_linenumber, l_linenumber || ':' || count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def assembly_sets(spark, d):
    """Alignments of a query by assembly and subject, nested; counts stand for the alignments."""
    n = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["n"].cast("string"))), ",")
    s = n.groupBy("l_suppkey", "l_returnflag").agg(text(F.array_sort(F.collect_list(F.struct("l_linenumber", "n")))).alias("subjects"))
    own = F.array_sort(F.collect_list(F.struct("l_returnflag", "subjects")))
    return s.groupBy(F.col("l_suppkey").alias("q")).agg(F.array_join(F.transform(own, lambda x: F.concat(x["l_returnflag"], F.lit("("), x["subjects"], F.lit(")"))), " ").alias("sets"))


@query("SELECT c_custkey, trim(c_name || CASE WHEN c_nationkey < 5 THEN ' strain ' || c_nationkey ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' THEN ', partial sequence' WHEN c_acctbal > 5000 THEN ', complete sequence' ELSE '' END) AS title FROM customer")
def definition_lines(spark, d):
    """Titles from the fields that a record has."""
    end = F.when(F.col("c_mktsegment") == "BUILDING", ", partial sequence").when(F.col("c_acctbal") > 5000, ", complete sequence").otherwise("")
    strain = F.when(F.col("c_nationkey") < 5, F.concat(F.lit(" strain "), F.col("c_nationkey").cast("string"))).otherwise("")
    return t(spark, d, "customer").select("c_custkey", F.trim(F.concat("c_name", strain, end)).alias("title"))


@query(
    f"WITH k AS (SELECT p_partkey, substr(seq, CAST(i AS INTEGER), 6) AS w FROM (SELECT p_partkey, seq, unnest(range(1, length(seq) - 4)) AS i FROM {D_SQL})), t AS (SELECT w FROM (SELECT w, count(*) AS n FROM k GROUP BY 1) ORDER BY n DESC, w LIMIT 5), "
    "n AS (SELECT DISTINCT substr(w, 1, i - 1) || b || substr(w, i + 1) AS near FROM (SELECT w, CAST(unnest(range(1, 7)) AS INTEGER) AS i FROM t), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)) SELECT p_partkey, count(*) AS hits FROM k JOIN n ON k.w = n.near GROUP BY 1 HAVING count(*) >= 2"
)
def tagged_reads(spark, d):
    """Reads with at least two words that are, but for one letter, among the five most frequent ones."""
    k = dna(spark, d).select("p_partkey", F.explode(S.kmers(F.col("seq"), 6)).alias("kmer"))
    top = k.groupBy(F.col("kmer").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(5)
    return L.tagged_reads(k, L.with_near_words(top.select("word")), "p_partkey", 2)
