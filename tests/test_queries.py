"""Every query with SQL against DuckDB, and fixed cases of the functions."""

import duckdb
import pytest

from strandlake import coding_queries, domain_queries, format_queries, lookup_queries, queries as own, read_queries, restore_queries, search_queries  # noqa: F401  the others register their own
from strandlake.functions import cells as C
from strandlake.functions import seq as S
from strandlake.functions import text as X
from strandlake.plans.query import Executor, parse, predicate
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, db, name):
    df = own.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    r = db.execute(own.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(dict(zip(names, x))[c] for c in cols)) for x in r.fetchall())




def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return list(row)


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_cells(spark):
    big = lambda *v: arr(*v).cast("array<long>")
    assert one(spark, C.deriv(big(5, 7, 4)), C.deriv(big(9, 9)), C.integral(big(5, 2, -3))) == [[5, 2, -3], [9, 0], [5, 7, 4]]
    assert one(spark, C.vclip(arr(-1, 2, 9), 0, 3), C.pairwise_max(arr(1, 5), arr(4, 2)), C.cut(arr("a", "b", "c"), (2, 0))) == [[0, 2, 3], [4, 5], ["c", "a"]]
    assert one(spark, C.trim(arr(0, 0, 3, 0), 0), C.trim(arr(0, 0, 3, 0), 0, 1), C.trim(arr(0, 0), 0)) == [[3, 0], [0, 0, 3], []]
    assert one(spark, C.not_my_row(arr(7, 0, -1, 9), F.lit(7)), C.outlier_encode(big(9, 3, 9, 4), 9), C.outlier_decode(big(1, 6, 7, 8), 9)) == [[9], [1, 6, 7, 8], [9, 3, 9, 4]]
    assert one(spark, C.bit_or(arr(1, 4), arr(2, 4)), C.bit_or(arr(1), arr(2, 4)), C.bit_or(arr(1), arr(2, 4), 1)) == [[3, 4], [3, 4], [2, 5]]
    assert one(spark, C.restore_quality(arr(10, 11), arr(False, True, False, True), 30)) == [[30, 10, 30, 11]]
    assert one(spark, C.redimension(arr(1, 2, 3), 2), C.fixed_vec_sum(arr(1.0, 2.0, 3.0), 2)) == [[[1, 2], [3]], [3.0, 3.0]]
    with pytest.raises(Exception, match="outside"):
        one(spark, C.range_validate(arr(1, 6), 0, 5))


def test_text(spark):
    assert one(spark, X.hash17(F.lit("ab")), X.jaccard(arr("a", "b"), arr("b", "c")), X.divergence(F.lit("abcd"), F.lit("abxy"))) == [1747, 1 / 3, 0.5]
    h = lambda raw: (lambda v: v - 2**64 if v >= 2**63 else v)(sum((b - 256 if b > 127 else b) * 17 ** (len(raw) - 1 - k) for k, b in enumerate(raw)) % 2**64)
    texts = ["Customer#000000001", "", "é", "日本 x" * 9, "z" * 40]
    assert h(b"Customer#000000001") == 3782830818561783542
    assert one(spark, *[X.hash17(F.lit(x)) for x in texts], X.hash17(F.lit(None).cast("string"))) == [*[h(x.encode()) for x in texts], None]
    assert one(spark, X.title_modifiers(F.lit("x [organism=a b] [n=1]"))) == [{"organism": "a b", "n": "1"}]
    assert one(spark, X.html_escape(F.lit('<a b="&">'))) == ["&lt;a b=&quot;&amp;&quot;&gt;"]
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "hopeful": "hope", "goodness": "good", "adoption": "adopt", "effective": "effect", "rate": "rate", "controlling": "control"}
    assert {w: X.porter(w) for w in words} == words


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("AACGT")), S.nmer_code(F.lit("CA")), S.percent_gc(F.lit("GGAT"))) == ["ACGTT", 13, 50]
    assert one(spark, S.translate_dna(F.lit("ATGGCNTAAC")), F.round(S.jukes_cantor(F.lit(0.3)), 6)) == ["MX*", 0.383119]
    assert one(spark, S.kmers(F.lit("abcd"), 3), S.kmers(F.lit("ab"), 3), S.reference_span(F.lit("5M2I3D1S"))) == [["abc", "bcd"], [], 8]


def test_query_trees(spark):
    assert parse("a = 1 AND NOT (b < 2 OR c IN (1, 'x'))").show().split("\n")[0] == "and"
    df = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, None)], "n int, s string")
    assert [r.n for r in df.where(predicate("n BETWEEN 1 AND 2 AND s LIKE '%o%'")).collect()] == [1]
    assert [r.n for r in df.where(predicate("'blue'", ["s"])).collect()] == [2]
    e = Executor()
    with pytest.raises(ValueError, match="unknown function"):
        e.column(parse("nosuch(n) = 1"))
    with pytest.raises(ValueError, match="default fields"):
        e.column(parse("'bare'"))
    e.register("twice", lambda c: c * 2)
    assert [r.n for r in df.where(e.column(parse("twice(n) = 4"))).collect()] == [2]
    with pytest.raises(ValueError, match="ends too early"):
        parse("a =")
