"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cells as C
from strandlake.functions import seq as S
from strandlake.functions import text as X
from strandlake.operators import intervals as I
from strandlake.operators import rows as R
from strandlake.plans.query import predicate
from strandlake.session import ship, spread
from strandlake.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole values, v, for exact sums, and microseconds, us."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "ts", F.unix_micros("ts").alias("us"), F.floor(F.col("value") * 100).cast("long").alias("v"))


E_SQL = "(SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS v FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of days by customer."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("lo"), (day + 5 + F.col("o_orderkey") % 40).alias("hi"), F.floor("o_totalprice").cast("long").alias("s"))


S_SQL = "(SELECT o_orderkey, o_custkey, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS lo, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) + 5 + o_orderkey % 40 AS hi, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)"


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell an order: its lines' whole quantities, in order of line."""
    q = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"))))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q.alias("s")).select("l_orderkey", F.col("s.q").alias("c"))


C_SQL = "(SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS c FROM lineitem GROUP BY 1)"


def text_of(c: F.Column) -> F.Column:
    return F.array_join(c.cast("array<string>"), ",")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in sequence for each part: its name's checksum, in letters."""
    return t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.translate(F.md5(F.col("p_name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


D_SQL = "(SELECT p_partkey, p_brand, translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part)"


# --- predicates -----------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'X' GROUP BY ALL")
def query_filter_counts(spark, d):
    q = predicate("l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'X'")
    return t(spark, d, "lineitem").where(q).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25) <> (l_discount > 0.05) AND NOT l_returnflag = 'N'")
def query_xor_sub(spark, d):
    return t(spark, d, "lineitem").where(predicate("(l_quantity > 25 XOR l_discount > 0.05) SUB l_returnflag = 'N'")).select("l_orderkey", "l_linenumber")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'token') OR contains(source, 'src7') AND contains(text, 'the') GROUP BY 1")
def query_field_search(spark, d):
    return t(spark, d, "documents").where(predicate("'token' OR 'src7'[source] AND 'the'", ["text"])).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 60000 AND o_orderpriority LIKE '%-H%' AND NOT o_orderstatus IN ('P')")
def query_between_like(spark, d):
    return t(spark, d, "orders").where(predicate("o_totalprice BETWEEN 1000 AND 60000 AND o_orderpriority LIKE '%-H%' AND o_orderstatus NOT IN ('P')")).select("o_orderkey", "o_orderpriority")


# --- cells ----------------------------------------------------------------------


@query(f"SELECT l_orderkey, array_to_string(list_transform(range(1, len(c) + 1), lambda i: c[i] - CASE WHEN i > 1 THEN c[i - 1] ELSE 0 END), ',') AS d FROM {C_SQL}")
def cell_deriv(spark, d):
    return order_cells(spark, d).select("l_orderkey", text_of(C.deriv(F.col("c"))).alias("d"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CAST(list_sum(c[1:i]) AS BIGINT)), ',') AS s, array_to_string(c, ',') AS back FROM {C_SQL}")
def cell_integral(spark, d):
    x = order_cells(spark, d).select("l_orderkey", C.integral("c").alias("sums"))
    return x.select("l_orderkey", text_of(F.col("sums")).alias("s"), text_of(C.deriv(F.col("sums"))).alias("back"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(c, lambda x: greatest(10, least(30, x))), ',') AS clipped, array_to_string(list_transform(c, lambda x: greatest(x, 25)), ',') AS most, concat_ws(',', c[2], c[1]) AS cut FROM {C_SQL}")
def cell_clip_max_cut(spark, d):
    c = F.col("c")
    most = C.pairwise_max(c, F.transform(c, lambda x: F.lit(25).cast("long")))
    return order_cells(spark, d).select("l_orderkey", text_of(C.vclip(c, 10, 30)).alias("clipped"), text_of(most).alias("most"), text_of(C.cut(c, (1, 0))).alias("cut"))


@query(f"SELECT l_orderkey, CAST(list_sum(c) AS DOUBLE) AS total, array_to_string(list_transform(range(0, CAST(ceil(len(c) / 2.0) AS BIGINT)), lambda k: CAST(list_sum(c[2 * k + 1 : 2 * k + 2]) AS BIGINT)), ',') AS pairs, array_to_string(list_filter(c, lambda x: x <> l_orderkey AND x > 0), ',') AS others FROM {C_SQL}")
def cell_sums(spark, d):
    c = F.col("c")
    return order_cells(spark, d).select(
        "l_orderkey", C.vec_sum(c).alias("total"), text_of(F.transform(C.fixed_vec_sum(c, 2), lambda x: x.cast("long"))).alias("pairs"), text_of(C.not_my_row(c, F.col("l_orderkey"))).alias("others")
    )


@query(f"SELECT l_orderkey, array_to_string(c, ',') AS back, array_to_string(list_transform(c, lambda x: x | 4), ',') AS ored FROM {C_SQL}")
def cell_outlier_round_trip(spark, d):
    c = F.col("c")
    coded = C.outlier_decode(C.outlier_encode(c, 17), 17)
    return order_cells(spark, d).select("l_orderkey", text_of(coded).alias("back"), text_of(C.bit_or(c, F.transform(c, lambda x: F.lit(4).cast("long")))).alias("ored"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(x) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS f, CAST(ceil(x) AS BIGINT) AS c, CAST(trunc(x) AS BIGINT) AS t FROM (SELECT *, (l_quantity - 25) / 4 AS x FROM lineitem)")
def scalar_rounding(spark, d):
    x = (F.col("l_quantity") - 25) / 4
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 0).cast("long").alias("r"), F.floor(x).alias("f"), F.ceil(x).alias("c"), C.truncate(x).alias("t"))


# --- ordered rows ---------------------------------------------------------------

W_SQL = "PARTITION BY user_id ORDER BY us, event_id"


@query(f"SELECT event_id, v - coalesce(lag(v) OVER ({W_SQL}), 0) AS d, v AS back FROM {E_SQL}")
def rows_delta(spark, d):
    keys, order = ["user_id"], ["us", "event_id"]
    x = R.delta(events(spark, d), keys, order, "v", "d")
    return R.undelta(x, keys, order, "d", "back").select("event_id", "d", "back")


@query(f"SELECT user_id, run, min(event_type) AS value, count(*) AS n FROM (SELECT *, CAST(sum(o) OVER ({W_SQL}) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER ({W_SQL}) THEN 0 ELSE 1 END AS o FROM {E_SQL})) GROUP BY 1, 2")
def rows_run_lengths(spark, d):
    return R.run_lengths(events(spark, d), ["user_id"], ["us", "event_id"], "event_type")


@query(f"SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN CAST(floor(sum(v) OVER w / 5) AS BIGINT) END AS mean FROM {E_SQL} WINDOW w AS ({W_SQL} ROWS 4 PRECEDING)")
def rows_sliding_mean(spark, d):
    return R.sliding_mean(events(spark, d), ["user_id"], ["us", "event_id"], "v", 5).select("event_id", "mean")


@query(f"SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN list_sort(list(v) OVER w)[2] END AS stat FROM {E_SQL} WINDOW w AS ({W_SQL} ROWS 4 PRECEDING)")
def rows_sliding_rank(spark, d):
    return R.sliding_order_statistic(events(spark, d), ["user_id"], ["us", "event_id"], "v", 5, 2).select("event_id", "stat")


@query("SELECT o_custkey, rank, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def topk_orders(spark, d):
    return R.top_k(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "rank", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


# --- sets -----------------------------------------------------------------------

A_SQL, B_SQL = "(SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')", "(SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')"


def _ab(spark, d):
    o = t(spark, d, "orders")
    return tuple(o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")


@query(f"SELECT 'and' AS op, id FROM ({A_SQL} INTERSECT {B_SQL}) UNION ALL SELECT 'or', id FROM ({A_SQL} UNION {B_SQL}) UNION ALL SELECT 'sub', id FROM ({A_SQL} EXCEPT {B_SQL}) UNION ALL SELECT 'xor', id FROM (({A_SQL} UNION {B_SQL}) EXCEPT ({A_SQL} INTERSECT {B_SQL}))")
def set_algebra(spark, d):
    a, b = _ab(spark, d)
    tag = lambda op, x: x.select(F.lit(op).alias("op"), "id")
    return tag("and", R.both(a, b)).union(tag("or", R.either(a, b))).union(tag("sub", a.subtract(b))).union(tag("xor", R.only_one(a, b, "id")))


@query("SELECT CAST(id AS BIGINT) AS id FROM (SELECT DISTINCT c_nationkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000)")
def set_remap(spark, d):
    ids = t(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return R.remap(ids, t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")[0].select(F.col("c_nationkey").cast("long").alias("id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_unmapped(spark, d):
    return R.remap(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")[1]


@query("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders)")
def set_bitmap_count(spark, d):
    return R.bitmap_count(t(spark, d, "orders"), "o_custkey").agg(F.sum("n").alias("n"))


@query("SELECT array_to_string(list_sort(s), ',') AS suppliers, count(*) AS n FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) GROUP BY 1")
def group_by_id_set(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(text_of(F.sort_array(F.collect_set("l_suppkey"))).alias("suppliers"))
    return s.groupBy("suppliers").agg(F.count("*").alias("n"))


# --- intervals ------------------------------------------------------------------


def _ab_spans(spark, d):
    s = spans(spark, d)
    return s.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), s.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))


REL_SQL = "CASE WHEN x.lo = y.lo AND x.hi = y.hi THEN 'same' WHEN x.lo >= y.lo AND x.hi <= y.hi THEN 'subset' WHEN x.lo <= y.lo AND x.hi >= y.hi THEN 'superset' WHEN x.lo < y.lo THEN 'overlap_left' ELSE 'overlap_right' END"


@query(f"SELECT x.o_orderkey AS a, y.o_orderkey AS b, {REL_SQL} AS kind FROM {S_SQL} x JOIN {S_SQL} y ON x.o_custkey = y.o_custkey AND x.lo <= y.hi AND y.lo <= x.hi AND x.o_orderkey < y.o_orderkey")
def interval_overlaps(spark, d):
    a, b = _ab_spans(spark, d)
    pairs = I.overlap_join(a, b, "o_custkey", 32).where("a < b")
    return pairs.select("a", "b", I.relation(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")).alias("kind"))


ISLAND_SQL = f"(SELECT o_custkey, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS run FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM {S_SQL})) GROUP BY o_custkey, run)"


@query(f"SELECT o_custkey, lo, hi, n FROM {ISLAND_SQL}")
def interval_islands(spark, d):
    return I.islands(spans(spark, d), "o_custkey", width=128)


@query(f"SELECT * FROM (SELECT o_custkey, hi + 1 AS gap_lo, lead(lo) OVER (PARTITION BY o_custkey ORDER BY lo) - 1 AS gap_hi FROM {ISLAND_SQL}) WHERE gap_lo <= gap_hi")
def interval_complement(spark, d):
    return I.complement(spans(spark, d), "o_custkey", width=128)


@query(f"SELECT o_custkey, lo, hi, depth FROM (SELECT o_custkey, p AS lo, lead(p) OVER w - 1 AS hi, CAST(sum(d) OVER w AS BIGINT) AS depth FROM (SELECT o_custkey, p, sum(d) AS d FROM (SELECT o_custkey, lo AS p, 1 AS d FROM {S_SQL} UNION ALL SELECT o_custkey, hi + 1, -1 FROM {S_SQL}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_custkey ORDER BY p)) WHERE depth > 0")
def interval_coverage(spark, d):
    return I.coverage(spans(spark, d), "o_custkey", width=128)


@query(f"SELECT a, b, extra FROM (SELECT x.o_orderkey AS a, y.o_orderkey AS b, (y.hi - y.lo) - (x.hi - x.lo) AS extra, row_number() OVER (PARTITION BY x.o_orderkey ORDER BY (y.hi - y.lo) - (x.hi - x.lo), y.o_orderkey) AS k FROM {S_SQL} x JOIN {S_SQL} y ON x.o_custkey = y.o_custkey AND y.lo <= x.lo AND y.hi >= x.hi) WHERE k = 1")
def interval_best_container(spark, d):
    a, b = _ab_spans(spark, d)
    return I.smallest_container(a, b, "o_custkey", "a", "b", 32)


@query(f"SELECT o_orderkey FROM {S_SQL} x WHERE NOT EXISTS (SELECT 1 FROM {S_SQL} y WHERE y.o_custkey = x.o_custkey AND y.o_orderkey <> x.o_orderkey AND (y.s > x.s OR y.s = x.s AND y.o_orderkey < x.o_orderkey) AND y.lo <= x.hi AND x.lo <= y.hi AND y.lo <= x.lo + CAST(floor((x.hi - x.lo) * 0.1) AS BIGINT) AND y.hi >= x.hi - CAST(floor((x.hi - x.lo) * 0.1) AS BIGINT))")
def hits_best(spark, d):
    return I.best_hits(spans(spark, d), "o_custkey", "o_orderkey", "s", 32).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {S_SQL} x WHERE (SELECT count(*) FROM {S_SQL} y WHERE y.o_custkey = x.o_custkey AND (y.s > x.s OR y.s = x.s AND y.o_orderkey < x.o_orderkey) AND y.lo <= x.lo AND y.hi >= x.hi) < 2")
def hits_culled(spark, d):
    return I.culled(spans(spark, d), "o_custkey", "o_orderkey", "s", 32, 2).select("o_orderkey")


@query(f"SELECT o_custkey, CAST(part AS BIGINT) AS part, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS part FROM (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30 THEN 0 ELSE 1 END AS o FROM {S_SQL})) GROUP BY 1, 2")
def hits_compartments(spark, d):
    return I.compartments(spans(spark, d), "o_custkey", 30).groupBy("o_custkey", "part").agg(F.count("*").alias("n"))


# --- text -----------------------------------------------------------------------

WORD_SQL = "(SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM documents)"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"


def _terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), X.NO_WORD)).alias("w")).where("w <> ''")


def _term_counts(spark, d):
    """(doc_id, w, n), dealt by document: texts are shuffled, and words are made and counted where a document's rows are, about 8 MB of text a task."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-size // (1 << 23))), "doc_id")
    return docs.select("doc_id", F.explode(F.split(F.lower("text"), X.NO_WORD)).alias("w")).where("w <> ''").groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@query(f"SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {WORD_SQL} WHERE w NOT IN {STOP_SQL} GROUP BY 1 HAVING count(DISTINCT doc_id) > 5")
def text_word_frequencies(spark, d):
    """Words by occurrences and by documents; both are added up before anything is shuffled, a row for each word and partition."""
    words = t(spark, d, "documents").select(F.split(F.lower("text"), X.NO_WORD).alias("w"))
    once = words.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("docs"))
    all_ = words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return all_.join(once.where("docs > 5"), "w").where((F.col("w") != "") & ~F.col("w").isin(*X.STOP_WORDS)).select("w", "n", "docs")


@query(f"SELECT doc_id, rank, w, n FROM (SELECT doc_id, w, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w) AS INTEGER) AS rank FROM {WORD_SQL} GROUP BY doc_id, w) WHERE rank <= 5")
def text_top_terms(spark, d):
    tf = _term_counts(spark, d)
    return R.top_k(tf, ["doc_id"], [F.desc("n"), "w"], 5).select("doc_id", "rank", "w", "n")


@query("WITH k AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS k FROM conversations) SELECT a.conv_id, a.turn, levenshtein(a.k, b.k) AS dist FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def text_edit_distance(spark, d):
    """Distance of each turn of a conversation and the next, by their printable ASCII; ``text_edit_distance_all`` is on whole texts of all benchmark items."""
    k = t(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("k"))
    after = k.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("next"))
    return k.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.levenshtein("k", "next").cast("long").alias("dist"))


@query()
def text_edit_distance_all(spark, d):
    """Distances in characters of all pairs of benchmark items, on whole texts. Items lie in blocks, and each pair of blocks is one key of an equi-join, so no side is broadcast."""
    blocks = 32
    b = t(spark, d, "benchmark").withColumn("own", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    cells = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("item_id", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    left = cells.where("own = i").select("i", "j", F.col("item_id").alias("x"), F.col("text").alias("kx"))
    right = cells.where("own = j").select("i", "j", F.col("item_id").alias("y"), F.col("text").alias("ky"))
    pairs = left.join(right.hint("merge"), ["i", "j"]).where("i < j or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.levenshtein("kx", "ky").cast("long").alias("dist"))


@query("WITH h AS (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS HUGEINT)), lambda h, x: (h * 17 + x) % CAST(18446744073709551616 AS HUGEINT), CAST(0 AS HUGEINT)) AS h FROM customer) SELECT c_custkey, CAST(CASE WHEN h > 9223372036854775807 THEN h - CAST(18446744073709551616 AS HUGEINT) ELSE h END AS BIGINT) AS h FROM h")
def text_hash17(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.hash17(F.col("c_name")).alias("h"))


@query("SELECT prefix, width, count(*) AS n, min(k) AS least, max(k) AS most FROM (SELECT regexp_extract(c_name, '^([A-Za-z]+)[#_]?([0-9]+)', 1) AS prefix, length(regexp_extract(c_name, '^([A-Za-z]+)[#_]?([0-9]+)', 2)) AS width, CAST(regexp_extract(c_name, '^([A-Za-z]+)[#_]?([0-9]+)', 2) AS BIGINT) AS k FROM customer) GROUP BY 1, 2")
def accession_patterns(spark, d):
    prefix, digits = X.accession_parts(F.col("c_name"))
    a = t(spark, d, "customer").select(prefix.alias("prefix"), F.length(digits).cast("long").alias("width"), digits.cast("long").alias("k"))
    return a.groupBy("prefix", "width").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[a-z]+ion')) AS ions FROM documents")
def regex_find_all(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t(spark, d, "documents").select("doc_id", n("[0-9]+").alias("numbers"), n("[a-z]+ion").alias("ions"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def html_title_escape(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(X.html_escape(F.col("html"))).cast("long").alias("escaped"))


@query()
def text_stems(spark, d):
    return _terms(spark, d).groupBy("w").agg(F.count("*").alias("n")).withColumn("stem", X.stem("w")).groupBy("stem").agg(F.sum("n").alias("n"))


@query("WITH m AS (SELECT label, list(m ORDER BY k) AS m FROM (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), m), 6) AS cosine FROM embeddings JOIN m USING (label)")
def vector_cosine(spark, d):
    """Cosine of every vector and its label's mean vector."""
    v = t(spark, d, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("s")).select("label", F.col("s.m").alias("m"))
    return v.join(mean, "label").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("m")), 6).alias("cosine"))


# --- sequences ------------------------------------------------------------------


@query(f"SELECT substr(seq, i, 3) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM {D_SQL}) GROUP BY 1")
def kmer_counts(spark, d):
    return dna(spark, d).select(F.explode(S.kmers(F.col("seq"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, CAST(floor(100 * len(regexp_extract_all(seq, '[GC]')) / length(seq)) AS BIGINT) AS gc, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM {D_SQL}")
def sequence_gc_reverse(spark, d):
    return dna(spark, d).select("p_partkey", S.percent_gc(F.col("seq")).alias("gc"), S.reverse_complement(F.col("seq")).alias("rc"))


_CODON = "substr('" + S.CODE_1 + "', 1 + 16 * (instr('TCAG', seq[3 * i + 1]) - 1) + 4 * (instr('TCAG', seq[3 * i + 2]) - 1) + instr('TCAG', seq[3 * i + 3]) - 1, 1)"


@query(f"SELECT p_partkey, string_agg({_CODON}, '' ORDER BY i) AS protein FROM (SELECT p_partkey, seq, unnest(range(0, length(seq) // 3)) AS i FROM {D_SQL}) GROUP BY 1")
def sequence_translation(spark, d):
    return dna(spark, d).select("p_partkey", S.translate_dna(F.col("seq")).alias("protein"))


@query(f"SELECT pos, base, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY pos), 4) AS pct FROM (SELECT i AS pos, substr(seq, i, 1) AS base FROM (SELECT seq, CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS i FROM {D_SQL})) GROUP BY 1, 2")
def base_composition(spark, d):
    n = dna(spark, d).select(F.posexplode(S.kmers(F.col("seq"), 1)).alias("p", "base")).groupBy((F.col("p") + 1).alias("pos"), "base").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.expr("n * 100.0D / sum(n) over (partition by pos)"), 4))


@query(f"SELECT pos, base FROM (SELECT pos, base, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base) AS k FROM (SELECT i AS pos, substr(seq, i, 1) AS base FROM (SELECT seq, CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS i FROM {D_SQL})) GROUP BY pos, base) WHERE k = 1")
def consensus(spark, d):
    n = dna(spark, d).select(F.posexplode(S.kmers(F.col("seq"), 1)).alias("p", "base")).groupBy((F.col("p") + 1).alias("pos"), "base").agg(F.count("*").alias("n"))
    return n.groupBy("pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("b")).select("pos", F.col("b.base").alias("base"))


@query("SELECT k, round(-0.75 * ln(1 - 4 * p / 3), 6) AS jukes_cantor, round(-ln(1 - p), 6) AS poisson, round(-ln(1 - p - 0.2 * p * p), 6) AS kimura, round(p * (2 + p) / (2 * (1 - p)), 6) AS grishin FROM (SELECT l_linenumber AS k, CAST(count(*) FILTER (l_quantity > 25) AS DOUBLE) / count(*) * 0.7 AS p FROM lineitem GROUP BY 1)")
def sequence_distances(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.count_if(F.col("l_quantity") > 25).cast("double") / F.count("*") * 0.7).alias("p"))
    r = lambda c, n: F.round(c(F.col("p")), 6).alias(n)
    return p.select("k", r(S.jukes_cantor, "jukes_cantor"), r(S.poisson, "poisson"), r(S.kimura, "kimura"), r(S.grishin, "grishin"))


@query("SELECT l_linenumber AS pos, count(*) AS n, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def position_statistics(spark, d):
    q = F.col("l_quantity")
    at = lambda x: F.percentile(q, F.lit(x))
    return t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("pos")).agg(
        F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), at(0.5).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.min(q).alias("least"), F.max(q).alias("most")
    )


# --- tables and jobs ------------------------------------------------------------


@query("SELECT o_custkey, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row FROM orders GROUP BY 1")
def index_row_ranges(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"))


@query("SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1")
def job_counts(spark, d):
    return J.state_counts(t(spark, d, "events").select(F.col("event_type").alias("state")))


@query(f"SELECT coalesce(b, '') AS before, event_type AS after, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER ({W_SQL}) AS b FROM {E_SQL}) GROUP BY 1, 2")
def job_transitions(spark, d):
    return J.transitions(events(spark, d).withColumnRenamed("event_type", "state"), "user_id", ["us", "event_id"])


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM {E_SQL}) WHERE k = 1")
def job_latest(spark, d):
    return J.latest(events(spark, d).select("user_id", "us", "event_id", "event_type"), "user_id", ["us", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2")
def job_windows(spark, d):
    w = J.windowed_counts(events(spark, d).withColumnRenamed("event_type", "state"), "ts", "1 hour", "10 minutes")
    return w.select(F.unix_micros("start").alias("start_us"), "state", "n")
