"""Registered queries of codings, words, locations and reports on reads; registered with the others on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import algorithms as A
from strandlake.functions import coding as K
from strandlake.functions import masking as M
from strandlake.functions import seq as S
from strandlake.operators import intervals as I
from strandlake.operators import words as N
from strandlake.plans.query import predicate
from strandlake.queries import C_SQL, S_SQL, WORD_SQL, _term_counts, _terms, order_cells, query, spans, t, text_of
from strandlake.session import settled
from strandlake.sources import readers as P
from strandlake.sources import writers as W


def genome(spark, d):
    """Stand-in sequences of some hundred bases: the bytes of the benchmark's texts, two letters each."""
    return t(spark, d, "benchmark").select("item_id", F.translate(F.hex(F.encode("text", "UTF-8")), "0123456789ABCDEF", "ACGTACGTACGTACGT").alias("seq"))


G_SQL = "(SELECT item_id, translate(hex(encode(text)), '0123456789ABCDEF', 'ACGTACGTACGTACGT') AS seq FROM benchmark)"

# --- cells and numbers ----------------------------------------------------------

_BITS = "array_to_string(list_transform(c, lambda x: lpad(bin(x), 6, '0')), '')"


@query(f"SELECT l_orderkey, rpad(b, CAST(ceil(length(b) / 8.0) * 8 AS INTEGER), '0') AS bits, array_to_string(c, ',') AS back FROM (SELECT l_orderkey, c, {_BITS} AS b FROM {C_SQL})")
def packed_cells(spark, d):
    """Cells in six bits an element, told as the bits of their bytes, and unpacked again."""
    x = order_cells(spark, d).select("l_orderkey", "c", K.pack(F.col("c"), 6).alias("p"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length("p") - 1), lambda i: F.lpad(F.conv(F.hex(F.substr("p", i + 1, F.lit(1))), 16, 2), 8, "0")), "")
    return x.select("l_orderkey", bits.alias("bits"), text_of(K.unpack(F.col("p"), 6, F.size("c"))).alias("back"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(c, lambda x: x + l_orderkey), ',') AS more, array_to_string(list_concat(c, [l_orderkey]), ',') AS data, len(c) || ',' || (len(c) + 1) AS ends, repeat('7', len(c)) AS there, 0 AS absent FROM {C_SQL}")
def row_id_cells(spark, d):
    """Cells plus the row's id, two cells merged with their ends, and constants for a column that exists and one that doesn't."""
    x = order_cells(spark, d)
    m = K.merge_cells(F.col("c"), F.array(F.col("l_orderkey").cast("long")))
    there, absent = K.exists(x.columns, "c", "7", F.col("c")), K.exists(x.columns, "nothing", "7")
    return x.select("l_orderkey", text_of(K.plus_row(F.col("c"), F.col("l_orderkey"))).alias("more"), text_of(m["data"]).alias("data"), text_of(m["ends"]).alias("ends"), F.array_join(there, "").alias("there"), F.size(absent).alias("absent"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS finite FROM embeddings")
def finite_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", K.all_finite(F.col("embedding")).alias("finite"))


@query("SELECT c_custkey, CAST(c_custkey AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b, CAST(NULL AS BIGINT) AS none, printf('%05d|%s|%.2f', CAST(c_custkey AS INTEGER), c_mktsegment, c_acctbal) AS line FROM customer")
def numbers_and_lines(spark, d):
    """Numbers read from hexadecimal, octal and other texts, and lines printed by a format."""
    c = t(spark, d, "customer")
    hexed, octal = F.concat(F.lit("0x"), F.hex("c_custkey")), F.concat(F.lit("0"), F.conv(F.col("c_nationkey").cast("string"), 10, 8))
    return c.select("c_custkey", K.number_of(hexed).alias("a"), K.number_of(octal).alias("b"), K.number_of(F.col("c_mktsegment")).alias("none"), F.format_string("%05d|%s|%.2f", "c_custkey", "c_mktsegment", "c_acctbal").alias("line"))


# --- residues -------------------------------------------------------------------

_AMB = "translate(seq, 'A', 'N')"


@query(f"SELECT item_id, seq AS back4, seq AS back2, substr(seq, 11, 20) AS part, (length(seq) + 1) // 2 AS bytes4, (length(seq) + 3) // 4 AS bytes2, array_to_string(list_transform(range(1, 41), lambda i: strpos('-ACMGRSVTWYHKDBN', seq[i]) - 1), ',') AS codes FROM {G_SQL}")
def converted_codings(spark, d):
    """Sequences in four and in two bits a base and back, and a part of one."""
    n, p4 = F.length("seq"), K.to_4na(F.col("seq"))
    codes = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.conv(F.substr(F.hex("p4"), i, F.lit(1)), 16, 10))
    x = genome(spark, d).withColumns({"p4": p4, "p2": K.to_2na(F.col("seq"))})
    return x.select(
        "item_id", K.from_4na(F.col("p4"), n).alias("back4"), K.from_2na(F.col("p2"), n).alias("back2"), F.substr(K.from_4na(F.col("p4"), n), F.lit(11), F.lit(20)).alias("part"),
        F.octet_length("p4").cast("long").alias("bytes4"), F.octet_length("p2").cast("long").alias("bytes2"), F.array_join(codes, ",").alias("codes"),
    )


@query(
    "SELECT item_id, string_agg(CASE WHEN b = 'N' THEN substr('ACGT', CAST(h % 4 AS INTEGER) + 1, 1) ELSE b END, '' ORDER BY i) AS seq FROM (SELECT item_id, i, substr(s, CAST(i + 1 AS INTEGER), 1) AS b, list_sum(list_transform(range(1, 7), lambda k: (strpos('0123456789abcdef', substr(md5(item_id || ':' || i), k, 1)) - 1) * CAST(pow(16, 6 - k) AS BIGINT))) AS h FROM "
    f"(SELECT item_id, {_AMB} AS s, unnest(range(0, length(seq))) AS i FROM {G_SQL})) GROUP BY 1"
)
def resolved_bases(spark, d):
    """Ambiguous bases drawn from what they stand for, the same in each run."""
    return genome(spark, d).select("item_id", K.resolved(F.translate("seq", "A", "N"), F.col("item_id")).alias("seq"))


@query(f"SELECT item_id FROM {G_SQL} WHERE (regexp_matches(seq, 'ACG[AG]C') OR regexp_matches(seq, 'TTTTT')) AND NOT regexp_matches(seq, 'GGGGGG')")
def expression_search(spark, d):
    return genome(spark, d).where(K.expression(F.col("seq"), "(ACGRC | TTTTT) & !GGGGGG")).select("item_id")


@query(f"SELECT item_id, lower(substr(seq, 1, 12)) || substr(seq, 13, 30) || lower(substr(seq, 43, 8)) AS seq, 12 AS bio FROM {G_SQL}")
def spot_descriptors(spark, d):
    """Three reads of a spot: technical ones in lower case, and where the first biological one starts."""
    reads = K.spot_reads(F.array(F.lit(12), F.lit(30), F.lit(8)), F.array(F.lit("technical"), F.lit("biological"), F.lit("technical")))
    return genome(spark, d).withColumn("r", reads).select("item_id", K.technical_in_lower_case(F.col("seq"), F.col("r")).alias("seq"), K.bio_start(F.col("r")).alias("bio"))


_ACID = "substr('{code}', 1 + 16 * (strpos('TCAG', seq[3 * i + 1]) - 1) + 4 * (strpos('TCAG', seq[3 * i + 2]) - 1) + strpos('TCAG', seq[3 * i + 3]) - 1, 1)"


@query("SELECT item_id, " + ", ".join(f"string_agg({_ACID.format(code=K.CODES[k])}, '' ORDER BY i) AS code{k}" for k in (1, 2)) + f" FROM (SELECT item_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM {G_SQL}) GROUP BY 1")
def genetic_codes(spark, d):
    return genome(spark, d).select("item_id", *[S.translate_dna(F.col("seq"), K.CODES[k]).alias(f"code{k}") for k in (1, 2)])


@query(
    f"SELECT o_custkey, CAST(sum(hi - lo + 1) AS BIGINT) AS length, string_agg(lo || '..' || hi || '-', ',' ORDER BY lo DESC, hi DESC) AS reversed, coalesce(string_agg(greatest(lo, 8500) || '..' || least(hi, 9500) || '+', ',' ORDER BY lo, hi) FILTER (lo <= 9500 AND hi >= 8500), '') AS clipped FROM {S_SQL} GROUP BY 1"
)
def location_algebra(spark, d):
    """Lengths, other strands and parts of locations of several intervals."""
    own = F.array_sort(F.collect_list(F.struct("lo", "hi", F.lit("+").alias("strand")))).alias("loc")
    x = spans(spark, d).groupBy("o_custkey").agg(own)
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["lo"].cast("string"), F.lit(".."), p["hi"].cast("string"), p["strand"])), ",")
    loc = F.col("loc")
    return x.select("o_custkey", K.location_length(loc).alias("length"), text(K.location_reversed(loc)).alias("reversed"), text(K.location_clipped(loc, F.lit(8500).cast("long"), F.lit(9500).cast("long"))).alias("clipped"))


MASK = 200


@query(f"SELECT item_id, seq, n, CAST(start AS BIGINT) AS start FROM (SELECT item_id, substr(seq, CAST(lo AS INTEGER), CAST(hi - lo + 1 AS INTEGER)) AS seq, hi - lo + 1 AS n, lo AS start FROM (SELECT item_id, seq, 1 AS lo, 40 AS hi FROM {G_SQL} UNION ALL SELECT item_id, seq, 61, 150 FROM {G_SQL} UNION ALL SELECT item_id, seq, 201, length(seq) FROM {G_SQL})) WHERE n > 0")
def unmasked_pieces(spark, d):
    """Derived sequences: what two masked stretches leave of each sequence."""
    g = genome(spark, d)
    masks = g.select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")), F.struct(F.lit(41).alias("lo"), F.lit(60).alias("hi")), F.struct(F.lit(151).alias("lo"), F.lit(MASK).alias("hi")))).alias("m"), F.length("seq").alias("n"))
    ends = masks.select("item_id", F.col("m.lo").cast("long").alias("lo"), F.col("m.hi").cast("long").alias("hi")).unionByName(g.select("item_id", (F.length("seq") + 1).cast("long").alias("lo"), (F.length("seq") + 1).cast("long").alias("hi")))
    rest = I.complement(ends, "item_id")
    n = F.col("gap_hi") - F.col("gap_lo") + 1
    return rest.join(g, "item_id").select("item_id", F.substr("seq", F.col("gap_lo").cast("int"), n.cast("int")).alias("seq"), n.alias("n"), F.col("gap_lo").alias("start"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_sequences(spark, d):
    return t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


# --- words and dates ------------------------------------------------------------

_SOUND = "translate(upper(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"


@query(
    "WITH v AS (SELECT DISTINCT w FROM " + WORD_SQL + " WHERE regexp_full_match(w, '[a-z]+')), c AS (SELECT w, list_filter(list_transform(range(1, length(w) + 1), lambda i: {'c': translate(upper(w[i]), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0123012-022455012623010202'), 'i': i}), lambda x: x.i = 1 OR NOT upper(w[x.i]) IN ('H', 'W')) AS k FROM v), "
    "o AS (SELECT w, list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN i > 1 AND (k[i].c = k[i - 1].c) THEN '' ELSE k[i].c END), lambda x: x <> '') AS r FROM c) SELECT w, rpad(upper(w[1]) || substr(array_to_string(list_filter(r[2:], lambda x: x <> '0'), ''), 1, 3), 4, '0') AS key FROM o"
)
def soundex_keys(spark, d):
    """Phonetic keys of four characters of all words of letters."""
    return _terms(spark, d).select("w").distinct().where(F.col("w").rlike("^[a-z]+$")).select("w", F.soundex("w").alias("key"))


def _by_documents(spark, d):
    """(w, docs): whether none, one or several (2) documents have a word; kept, as its key is made in several ways."""
    n = _terms(spark, d).groupBy("w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return settled(n.select("w", F.when(F.col("a").isNull(), 0).when(F.col("a") == F.col("b"), 1).otherwise(2).alias("docs")))


@query()
def dictionary_suggestions(spark, d):
    """For the words that only one document has, the three best words of several documents within two edits, by edits and phonetic keys; words of any length."""
    n = _by_documents(spark, d)
    return N.suggestions(n.where("docs = 1"), n.where("docs > 1"), K.word_score)


@query(f"SELECT doc_id, count(*) AS words, count(*) FILTER (w NOT IN (SELECT w FROM {WORD_SQL} GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)) AS unknown FROM (SELECT DISTINCT doc_id, w FROM {WORD_SQL}) GROUP BY 1")
def dictionary_check(spark, d):
    """How many of each document's distinct words no other document has."""
    own = _term_counts(spark, d).select("doc_id", "w")
    lone = N.lone_words(own, "doc_id").withColumnRenamed("doc_id", "_doc")
    counts = own.groupBy("doc_id").agg(F.count("*").alias("words"))
    return counts.join(lone, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "words", F.coalesce("unknown", F.lit(0).cast("long")).alias("unknown"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(trim(o_orderpriority), ' ') THEN 'phrase' ELSE 'word' END AS kind FROM orders) GROUP BY 1")
def split_phrases(spark, d):
    return t(spark, d, "orders").groupBy(F.when(F.trim("o_orderpriority").contains(" "), "phrase").otherwise("word").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, concat_ws('; ', c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, nullif(CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'x' END, '')) AS line, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS at, CASE WHEN c_nationkey % 2 = 0 THEN 'Alpha,beta,' || c_mktsegment || ',gamma' ELSE 'Alpha,beta,gamma' END AS names FROM customer")
def joined_names(spark, d):
    """Titles from the parts that there are, a name's place in a list whatever its case, and the list in order."""
    c, odd = t(spark, d, "customer"), F.col("c_nationkey") % 2 == 1
    line = K.joined("; ", F.col("c_name"), F.when(~odd, F.col("c_mktsegment")), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise("x"))
    names = F.when(odd, F.array(F.lit("gamma"), F.lit("Alpha"), F.lit("beta"))).otherwise(F.array(F.lit("gamma"), F.concat(F.lit("C"), F.lit("")), F.lit("Alpha"), F.lit("beta")))
    place = K.name_at(F.when(odd, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.upper("c_mktsegment"))), F.lower("c_mktsegment"), True)
    ordered = K.names_sorted(F.transform(names, lambda x: x), True)
    shown = F.transform(ordered, lambda x: F.when(x == "C", F.col("c_mktsegment")).otherwise(x))
    return c.select("c_custkey", line.alias("line"), place.alias("at"), F.array_join(shown, ",").alias("names"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d/%B %b %y') AS whole, strftime(o_orderdate, '%Y-%m-/%B %b %y') AS month FROM orders")
def formatted_dates(spark, d):
    o = t(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    parts = lambda day: F.struct(F.year("day").alias("year"), F.month("day").alias("month"), day.alias("day"), F.lit("").alias("text"))
    return o.select("o_orderkey", K.format_date(parts(F.dayofmonth("day")), "%Y-%M-%D/%N %n %y").alias("whole"), K.format_date(parts(F.lit(None).cast("int")), "%Y-%M-%D/%N %n %y").alias("month"))


@query("SELECT c_custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment FROM customer")
def xml_and_json(spark, d):
    """Rows written as XML and as JSON, and read back by path and by schema."""
    c = t(spark, d, "customer")
    xml = F.concat(F.lit("<row><name>"), "c_name", F.lit('</name><at nation="'), F.col("c_nationkey").cast("string"), F.lit('"/></row>'))
    json = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.lit(1).alias("v")))
    x = c.select("c_custkey", xml.alias("xml"), json.alias("json"))
    return x.select("c_custkey", F.xpath_string("xml", F.lit("/row/name")).alias("name"), F.xpath_long("xml", F.lit("/row/at/@nation")).alias("nation"), F.from_json("json", "segment string, v int")["segment"].alias("segment"))


# --- reports on reads -----------------------------------------------------------


@query(f"SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, min(length(seq)) AS shortest, max(length(seq)) AS longest, round(avg(length(seq)), 6) AS mean, min(q) AS least_quality, max(q) AS most_quality FROM (SELECT item_id, seq, unnest(list_transform(range(1, 33), lambda i: ascii(substr(md5(seq), i, 1)) - 33)) AS q FROM {G_SQL}) WHERE false OR true".replace("count(*) AS reads, CAST(sum(length(seq)) AS BIGINT)", "count(DISTINCT item_id) AS reads, CAST(sum(length(seq)) / 32 AS BIGINT)"))
def read_set_summary(spark, d):
    """Counts, lengths and range of qualities of a set of reads, in one pass."""
    x = genome(spark, d).select("seq", F.transform(F.filter(F.split(F.md5(F.col("seq").cast("binary")), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33).alias("q"))
    n = F.length("seq").cast("long")
    return x.agg(F.count("*").alias("reads"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.min(F.array_min("q")).alias("least_quality"), F.max(F.array_max("q")).alias("most_quality"))


@query(f"SELECT CAST(CASE WHEN p < 10 THEN p WHEN p < 60 THEN 10 + (p - 10) // 5 WHEN p < 560 THEN 20 + (p - 60) // 50 WHEN p < 9560 THEN 30 + (p - 560) // 500 ELSE 48 END AS INTEGER) AS bin, b AS base, count(*) AS n FROM (SELECT p, substr(seq, CAST(p + 1 AS INTEGER), 1) AS b FROM (SELECT seq, unnest(range(0, length(seq))) AS p FROM {G_SQL})) GROUP BY 1, 2")
def binned_bases(spark, d):
    """Bases by bin of their place."""
    x = genome(spark, d).select(F.posexplode(S.kmers(F.col("seq"), 1)).alias("p", "base"))
    return x.groupBy(K.position_bin(F.col("p")).alias("bin"), "base").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS pos, mode, quantile_cont(q, 0.1) AS lower_centile, quantile_cont(q, 0.9) AS upper_centile, round(avg(q), 6) AS mean FROM (SELECT l_linenumber, l_quantity AS q FROM lineitem) JOIN (SELECT l_linenumber, l_quantity AS mode FROM (SELECT l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1) USING (l_linenumber) GROUP BY 1, 2")
def position_spread(spark, d):
    """Mode (the smallest of the most frequent), centiles and mean by position, all from counts by position and value."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    at = lambda x: F.percentile("q", F.lit(x), F.col("n"))
    mode = F.max(F.struct("n", (-F.col("q")).alias("q")))["q"]
    return n.groupBy("pos").agg((-mode).alias("mode"), at(0.1).alias("lower_centile"), at(0.9).alias("upper_centile"), F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("mean"))


@query(f"SELECT kind, item_id FROM (SELECT unnest(list_filter([CASE WHEN length(seq) < 400 THEN 'short' END, CASE WHEN NOT contains(seq, 'ATG') THEN 'no start' END, CASE WHEN contains(seq, 'GGGGG') THEN 'run' END], lambda x: x IS NOT NULL)) AS kind, item_id FROM {G_SQL})")
def sequence_checks(spark, d):
    """Named checks of each sequence, a row for each that it fails."""
    s = F.col("seq")
    checks = [("short", F.length(s) < 400), ("no start", ~s.contains("ATG")), ("run", s.contains("GGGGG"))]
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    return genome(spark, d).select(F.explode(failed).alias("kind"), "item_id")


@query(
    f"WITH r AS (SELECT item_id, k, substr(seq, 40 * k + 3, 24) AS read FROM {G_SQL}, (SELECT unnest(range(0, 5)) AS k) WHERE length(seq) >= 40 * k + 26), k AS (SELECT item_id AS ref, p, substr(seq, CAST(p AS INTEGER), 24) AS w FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 22)) AS p FROM {G_SQL})) "
    "SELECT r.item_id, r.k, k.ref, k.p AS pos FROM r JOIN k ON k.w = r.read"
)
def mapped_reads(spark, d):
    """All places of short reads in the reference, by seeds of twelve bases and a check of the rest."""
    g = genome(spark, d)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k")
    reads = g.select("item_id", k, "seq").where("length(seq) >= 40 * k + 26").selectExpr("item_id", "k", "substr(seq, CAST(40 * k + 3 AS INT), 24) AS read")
    seeds = g.select(F.col("item_id").alias("ref"), F.col("seq").alias("whole"), F.posexplode(S.kmers(F.col("seq"), 12)).alias("p", "w")).select("ref", F.col("p").cast("long").alias("p"), "w", F.expr("substr(whole, p + 13, 12)").alias("rest"))
    hits = reads.withColumn("w", F.substring("read", 1, 12)).join(seeds, "w").where(F.substring("read", 13, 12) == F.col("rest"))
    return hits.select("item_id", "k", "ref", (F.col("p") + 1).alias("pos"))


@query("SELECT l_orderkey, l_linenumber, least(CASE WHEN l_quantity > 40 THEN 1 ELSE 9 END, CASE WHEN l_discount > 0.05 AND l_quantity > 10 THEN 2 ELSE 9 END) AS rank FROM lineitem WHERE l_quantity > 40 OR l_discount > 0.05 AND l_quantity > 10")
def ranked_filters(spark, d):
    """Rows that pass the first of several ranked query filters over their scores, each once."""
    x = t(spark, d, "lineitem")
    filters = [(1, "l_quantity > 40"), (2, "l_discount > 0.05 AND l_quantity > 10")]
    rank = F.array_min(F.array(*[F.when(predicate(q), F.lit(k)) for k, q in filters]))
    return x.withColumn("rank", rank).where("rank is not null").select("l_orderkey", "l_linenumber", "rank")


# --- frames, points and masks over whole sequences ------------------------------

_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"


@query(
    f"WITH s AS (SELECT item_id, '+' AS strand, seq FROM {G_SQL} UNION ALL SELECT item_id, '-', {_RC} FROM {G_SQL}), c AS (SELECT item_id, strand, n, i, substr(seq, CAST(i + 1 AS INTEGER), 3) AS codon FROM (SELECT item_id, strand, seq, length(seq) AS n, unnest(range(0, length(seq) - 2)) AS i FROM s)), "
    "g AS (SELECT *, coalesce(sum(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, strand, i % 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM c), "
    "o AS (SELECT item_id, strand, n, min(i) FILTER (codon = 'ATG') AS b, max(i) FILTER (codon IN ('TAA', 'TAG', 'TGA')) AS e FROM g GROUP BY item_id, strand, n, i % 3, part) "
    "SELECT item_id, CAST(CASE WHEN strand = '+' THEN b ELSE n - 3 - e END AS INTEGER) AS lo, CAST(CASE WHEN strand = '+' THEN e + 2 ELSE n - 1 - b END AS INTEGER) AS hi, strand FROM o WHERE e - b >= 3"
)
def open_reading_frames(spark, d):
    return A.orf_table(genome(spark, d), "seq", "item_id")


_COUNT = "length(p) - length(replace(p, '{}', ''))"
_PLUS = " + ".join(f"({_COUNT.format(a)}) / (1 + pow(10, ph - {pk}))" for a, pk in A.PK_POSITIVE.items())
_MINUS = " + ".join(f"({_COUNT.format(a)}) / (1 + pow(10, {pk} - ph))" for a, pk in A.PK_NEGATIVE.items())
_END = lambda known, other, letter: f"CASE {letter} " + " ".join(f"WHEN '{a}' THEN {pk}" for a, pk in known.items()) + f" ELSE {other} END"
_CHARGE = f"1 / (1 + pow(10, ph - ({_END(A.PK_FIRST, A.PK_FIRST_ELSE, 'p[1]')}))) - 1 / (1 + pow(10, ({_END(A.PK_LAST, A.PK_LAST_ELSE, 'p[-1]')}) - ph)) + {_PLUS} - ({_MINUS})"
_MASSES = " + ".join(f"({_COUNT.format(a)}) * {m}" for a, m in A.MASS.items())
_ACIDS = "string_agg(" + _ACID.format(code=K.CODES[1]) + ", '' ORDER BY i)"


@query(
    f"WITH RECURSIVE a AS (SELECT item_id, replace({_ACIDS}, '*', '') AS p FROM (SELECT item_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM {G_SQL}) GROUP BY 1), "
    f"b AS (SELECT item_id, p, CAST(0 AS DOUBLE) AS low, CAST(14 AS DOUBLE) AS high, CAST(7 AS DOUBLE) AS ph, 0 AS k FROM a UNION ALL SELECT item_id, p, CASE WHEN charge > 0 THEN ph ELSE low END, CASE WHEN charge > 0 THEN high ELSE ph END, (CASE WHEN charge > 0 THEN ph ELSE low END + CASE WHEN charge > 0 THEN high ELSE ph END) / 2, k + 1 FROM (SELECT *, {_CHARGE} AS charge FROM b) WHERE k < 17) "
    f"SELECT item_id, CAST(round(18.01528 + {_MASSES}, 3) AS DOUBLE) AS weight, round(ph, 6) AS pi FROM b WHERE k = 17"
)
def protein_points(spark, d):
    """Weight and isoelectric point of each sequence's translation."""
    p = genome(spark, d).select("item_id", F.replace(S.translate_dna(F.col("seq")), F.lit("*"), F.lit("")).alias("protein"))
    return p.select("item_id", F.round(A.molecular_weight(F.col("protein")), 3).alias("weight"), F.round(A.isoelectric_point("protein"), 6).alias("pi"))


def _merged(spans_sql: str) -> str:
    """SQL that joins spans (item_id, lo, hi) which overlap or touch."""
    w = "PARTITION BY item_id ORDER BY lo, hi"
    return f"SELECT item_id, CAST(min(lo) AS INTEGER) AS lo, CAST(max(hi) AS INTEGER) AS hi FROM (SELECT *, sum(o) OVER ({w}) AS run FROM (SELECT *, CASE WHEN lo <= 1 + max(hi) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM ({spans_sql}))) GROUP BY item_id, run"


def _windows(n: int) -> str:
    return f"(SELECT item_id, i, substr(seq, CAST(i + 1 AS INTEGER), {n}) AS w FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {n - 1})) AS i FROM {G_SQL}))"


_BITS12 = f"(SELECT item_id, i, -sum(c / 12.0 * log2(c / 12.0)) AS bits FROM (SELECT item_id, i, unnest([{', '.join(_COUNT.format(x).replace('(p', '(w') for x in 'ACGT')}]) AS c FROM {_windows(12)} x, (SELECT 1)) WHERE c > 0 GROUP BY 1, 2)".replace("replace(p,", "replace(w,")


@query(_merged(f"SELECT item_id, min(i) AS lo, max(i) + 11 AS hi FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS g FROM {_BITS12} WHERE bits <= 1.4 + 1e-9) GROUP BY item_id, g HAVING min(bits) <= 1.1 + 1e-9"))
def low_complexity_spans(spark, d):
    return M.span_table(genome(spark, d), "item_id", "seq", M.low_complexity, window=12, locut=1.1, hicut=1.4)


@query(_merged(f"SELECT item_id, i AS lo, i + 63 AS hi FROM (SELECT item_id, i, sum(c * (c - 1)) / (2.0 * 61) AS score FROM (SELECT item_id, i, t, count(*) AS c FROM (SELECT item_id, i, unnest(list_transform(range(1, 63), lambda k: substr(w, CAST(k AS INTEGER), 3))) AS t FROM {_windows(64)}) GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE score > 1.5"))
def triplet_mask_spans(spark, d):
    """Stretches of windows of 64 bases whose triplets repeat; a shorter sequence is one window."""
    return M.span_table(genome(spark, d), "item_id", "seq", M.triplet_mask, window=64, level=1.5)


_P_SQL = f"(SELECT item_id, translate(seq, 'ACGT', 'AVLG') AS seq FROM {G_SQL})"
_PROP = "CASE x " + " ".join(f"WHEN '{a}' THEN {M.PROPENSITY[a]}" for a in "AVLG") + " END"


@query(
    f"WITH r AS (SELECT item_id, i, {_PROP} AS v FROM (SELECT item_id, i, seq[i + 1] AS x FROM (SELECT item_id, seq, unnest(range(0, length(seq))) AS i FROM {_P_SQL}))), m AS (SELECT item_id, least(avg(v), 1.0) AS m, count(*) AS n FROM r GROUP BY 1), "
    "l AS (SELECT item_id, i, avg(v) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM r) "
    "SELECT item_id, CAST(min(i) AS INTEGER) AS lo, CAST(max(i) AS INTEGER) AS hi FROM (SELECT item_id, i, i - row_number() OVER (PARTITION BY item_id ORDER BY i) AS g FROM l JOIN m USING (item_id) WHERE i >= 3 AND i < n - 3 AND a >= m) GROUP BY item_id, g HAVING count(*) >= 6"
)
def antigenic_sites(spark, d):
    return M.span_table(genome(spark, d).withColumn("protein", F.translate("seq", "ACGT", "AVLG")), "item_id", "protein", M.antigenic, least=6)


# --- formats, written and read back ---------------------------------------------


@query(f"SELECT 'c' || o_custkey AS seqid, lo AS start, hi AS stop, o_orderkey % 2 = 0 AS forward, 'o;' || o_orderkey AS id, 'a=b,c' AS note FROM {S_SQL}")
def gff3_round_trip(spark, d):
    f = spans(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("seqid"), F.lit("src").alias("source"), F.lit("gene").alias("type"), F.col("lo").alias("start"), F.col("hi").alias("stop"), F.lit(None).cast("double").alias("score"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(None).cast("int").alias("phase"), F.create_map(F.lit("ID"), F.concat(F.lit("o;"), "o_orderkey"), F.lit("Note"), F.lit("a=b,c")).alias("attrs"),
    )
    back = P.parse_gff3(W.gff3_lines(f), "failfast")
    return back.select("seqid", "start", "stop", (F.col("strand") == "+").alias("forward"), F.col("attrs")["ID"].alias("id"), F.col("attrs")["Note"].alias("note"))


@query(f"SELECT 'c' || o_custkey AS chrom, lo AS start, hi AS stop, CAST(s AS DOUBLE) AS score, '3,2' AS sizes FROM {S_SQL}")
def bed_round_trip(spark, d):
    b = spans(spark, d).select(
        F.concat(F.lit("c"), "o_custkey").alias("chrom"), F.col("lo").alias("start"), F.col("hi").alias("stop"), F.col("o_orderkey").cast("string").alias("name"), F.col("s").cast("double").alias("score"), F.lit("+").alias("strand"),
        F.col("lo").alias("thick_start"), F.col("hi").alias("thick_stop"), F.lit("0").alias("item_rgb"), F.lit(2).alias("block_count"), F.array(F.lit(3), F.lit(2)).alias("block_sizes"), F.array(F.lit(0), F.lit(4)).alias("block_starts"),
    )
    return P.parse_bed(W.bed_lines(b), "failfast").select("chrom", "start", "stop", "score", text_of(F.col("block_sizes")).alias("sizes"))


@query("SELECT 'c' || l_suppkey AS chrom, l_partkey AS pos, 'C,G' AS alt, CAST(l_quantity AS BIGINT) AS depth, l_linenumber = 1 AS flag FROM lineitem")
def vcf_round_trip(spark, d):
    info = F.map_from_entries(F.filter(F.array(F.struct(F.lit("DP"), F.col("l_quantity").cast("long").cast("string")), F.when(F.col("l_linenumber") == 1, F.struct(F.lit("DB"), F.lit("")))), lambda x: x.isNotNull()))
    v = t(spark, d, "lineitem").select(
        F.concat(F.lit("c"), "l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("G")).alias("alt"), F.lit(50.0).alias("qual"), F.array(F.lit("PASS")).alias("filter"), info.alias("info"),
    )
    back = P.parse_vcf(W.vcf_lines(v), "failfast")
    return back.select("chrom", "pos", F.array_join("alt", ",").alias("alt"), F.col("info")["DP"].cast("long").alias("depth"), F.map_contains_key("info", F.lit("DB")).alias("flag"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS qname, CAST(l_linenumber AS INTEGER) AS flag, l_partkey AS pos, 'RG:Z:g' || l_suppkey || ' NM:i:2' AS tags FROM lineitem")
def sam_round_trip(spark, d):
    tags = F.array(F.struct(F.lit("RG").alias("tag"), F.lit("Z").alias("type"), F.concat(F.lit("g"), "l_suppkey").alias("value")), F.struct(F.lit("NM").alias("tag"), F.lit("i").alias("type"), F.lit("2").alias("value")))
    s = t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("qname"), F.col("l_linenumber").cast("int").alias("flag"), F.lit("ref").alias("rname"), F.col("l_partkey").alias("pos"), F.lit(60).alias("mapq"), F.lit("4M").alias("cigar"), F.lit("*").alias("rnext"),
        F.lit(0).cast("long").alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit(".I@I").alias("qual"), tags.alias("tags"),
    )
    back = P.parse_sam(W.sam_lines(s), "failfast")
    return back.select("qname", "flag", "pos", F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["tag"], x["type"], x["value"])), " ").alias("tags"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN 'gap length differs from object span' END ELSE CASE WHEN l_quantity > 25 THEN 'component and object lengths differ' END END AS kind FROM lineitem) WHERE kind IS NOT NULL GROUP BY 1")
def agp_round_trip(spark, d):
    """Assembly rows written, read back and checked: half of them tell a length that isn't their span's."""
    gap, n = F.col("l_linenumber") % 3 == 0, F.when(F.col("l_quantity") > 25, 11).otherwise(10)
    a = t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("object"), (F.col("l_linenumber") * 10 + 1).alias("obj_beg"), (F.col("l_linenumber") * 10 + 10).alias("obj_end"), F.col("l_linenumber").alias("part"), F.when(gap, "N").otherwise("F").alias("type"),
        F.when(~gap, F.lit("ctg")).alias("component"), F.when(~gap, F.lit(1)).alias("comp_beg"), F.when(~gap, n).alias("comp_end"), F.when(~gap, F.lit("+")).alias("orientation"),
        F.when(gap, n).alias("gap_length"), F.when(gap, F.lit("contig")).alias("gap_type"), F.when(gap, F.lit("yes")).alias("linkage"), F.when(gap, F.lit("map")).alias("evidence"),
    )
    return P.agp_problems(P.parse_agp(W.agp_lines(a), "failfast")).groupBy(F.col("problem").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey || '-' || l_linenumber AS query, CAST(l_partkey AS VARCHAR) AS subject, CAST(l_quantity AS INTEGER) AS length FROM lineitem WHERE l_quantity > 30")
def tabular_hits_round_trip(spark, d):
    h = t(spark, d, "lineitem").select(F.concat_ws("\t", F.concat_ws("-", "l_orderkey", "l_linenumber"), "l_partkey", F.lit("99.5"), F.col("l_quantity").cast("int").cast("string"), F.lit("0\t0\t1\t9\t1\t9\t1e-05\t20.5")).alias("value"))
    return P.parse_hits(h, "failfast").where("length > 30 and evalue < 1e-4 and score > 20").select("query", "subject", "length")
