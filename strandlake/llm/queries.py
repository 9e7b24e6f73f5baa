"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bloom_lm, bpe, centroids, chat, edit_counts, langid, lexical_search, near_vectors, ngram_join, packing, quality, sharding, topk_search
from strandlake.llm.common import table, written


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens along the Hilbert curve."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after five standing edits: pre-token trees are made and written, and edited from there."""
    kept = written(edit_counts.with_trees(table(spark, sf_dir, "documents").select("doc_id", "text")), "edit-trees")
    return edit_counts.apply_edits(edit_counts.standing_edits(kept))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of every conversation, parsed from its transcript's lines alone."""
    return chat.parse(table(spark, sf_dir, "conversations"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingle sets of every document, linked at a Jaccard similarity of 0.9: size and smallest id reached."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from trees that no held-out label has seen."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by rendezvous hashing, its slot there, and its shard once there is one more."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from machines that no held-out document has trained."""
    return langid.told(table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, smallest id reached and whether it stays, of every vector, at a cosine of 0.98 within its label."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components among 40 centroids after 5 rounds, with distances and sums of them."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by the log-frequency Bloom filter, learned from six sevenths of them; texts ask the filter in its ranges, so that all sizes go one way."""
    return bloom_lm.scored(table(spark, sf_dir, "documents"), broadcast=0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest score for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_token_counts, op3_bpe, op4_chat, op5_ngram_join, op6_quality, op7_topk, op8_sharding, op9_langid, op10_near_vectors, op11_centroids, op12_bloom_lm, op13_lexical)}


OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS l FROM words WHERE len(w) > 0
  ), unnest(l) AS u(s)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM q JOIN v d ON d.vec_id <> q.vec_id AND len(q.e) = len(d.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10
"""


def _op11_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    near = "(SELECT vec_id, row, cluster, distance FROM (SELECT p.vec_id, p.row, c.cluster, d AS distance, row_number() OVER (PARTITION BY p.row ORDER BY d, c.cluster) AS r FROM p, c{0} c, LATERAL (SELECT CAST(list_sum(list_transform(range(1, {1} + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS BIGINT) AS d) WHERE true) WHERE r = 1)"
    sql = f"""WITH p AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM p ORDER BY sha256('2:' || vec_id) LIMIT {k})"""
    for r in range(rounds):
        sql += f""", a{r} AS MATERIALIZED {near.format(r, dim)}, s{r} AS (
  SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT a.cluster, unnest(range(1, {dim} + 1)) AS i, unnest(p.x) AS v FROM a{r} a JOIN p USING (row)) GROUP BY 1, 2) GROUP BY 1
), c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(s{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN s{r} USING (cluster))"""
    return sql + f""", ends AS MATERIALIZED {near.format(rounds, dim)}
SELECT e.vec_id, e.cluster, e.distance, CAST(sum(e.distance) OVER (PARTITION BY e.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(e.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM ends e JOIN c{rounds} c USING (cluster)"""


OP13_SQL = """
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL)
), whole AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM words WHERE len(w) > 0
), tf AS (SELECT row, id, len(w) AS n, term, count(*) AS tf FROM (SELECT row, id, w, unnest(w) AS term FROM words) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM whole) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf GROUP BY 1
), scores AS (
  SELECT item_id, row, id AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * tf.n * whole.n) // whole.l))))) AS BIGINT) AS score
  FROM tf JOIN asked USING (term) JOIN weights USING (term), whole GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": OP5_SQL, "op7_topk": OP7_SQL, "op11_centroids": _op11_sql(), "op13_lexical": OP13_SQL}
