"""Exact top-k search by block-at-a-time pruning.

Vectors are documents whose terms are their dimensions, with integer weights
floor(scale * x). Documents are ordered by similarity (length, nearest of some
centres fitted on a bounded sample of ``SAMPLE`` rows, place along the centre's
widest direction) and cut into document ranges, and ranges into blocks. Ranges and
blocks keep every term's largest and least weight; a query's bound is the sum of
the term maxima times its weights (of the minima where its weight is negative).

Three steps. Every query's bounds over all ranges give the range of largest bound,
which is scored first; its k-th score is the query's first threshold. Only ranges
whose bound reaches the threshold are opened. In an opened range blocks are
taken by falling bound and scored through their forward index, the weights of
their documents, until the bounds fall below the k-th best score known.

Bounds over 64 dimensions can only prune where documents lie close together. On
isotropic vectors no block of two or more falls below the k-th score, and every
block is opened; ``search(..., report=True)`` tells the numbers.

Null vectors and those with null or non-finite components take no part; nor do
rows without id. Rows with the query's id are the query's own. Every other row is
a candidate, repeated ones each; equal rows among the queries are one query, and
different vectors of one query id share its k places. Vectors of other lengths
than the query's are no candidates; with none at all a query has no rows. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import released, written
from strandlake.session import ship

#: Documents of a range and of a block; queries, and ranges' bounds, that a task takes at once.
RANGE, BLOCK, GROUP, BOUNDS = 1024, 32, 2048, 4096
SAMPLE, CENTRES = 4096, 256

DOCS = "dim int, rng long, place int, vec_id long, weights binary, most binary, least binary"


def _weights(scale: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = [np.floor(scale * np.asarray(v, np.float64)) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "dim": [len(v) for v in x], "weights": [v.tobytes() for v in x]})

    return run


def _matrix(raw: pd.Series, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(n, -1)


def fit_centres(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres and one direction each, by length, from sampled (dim, weights) rows."""
    out = {}
    for dim in sorted({r["dim"] for r in rows if r["dim"]}):
        x = np.array(sorted(np.frombuffer(r["weights"]).tolist() for r in rows if r["dim"] == dim))
        x /= max(1.0, np.abs(x).max())
        k = max(1, min(CENTRES, len(x) // 8))
        centres = x[np.random.default_rng(3).permutation(len(x))[:k]]
        for _ in range(8):
            near = _nearest(x, centres)
            centres = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
        near, ways = _nearest(x, centres), np.zeros((k, dim))
        for j in range(k):
            own = x[near == j]
            ways[j] = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0] if len(own) > 1 else 1.0
        out[dim] = centres, ways
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _keyed(fitted: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows with their place in the order of similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            centre, way = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim, at in pdf.groupby("dim").indices.items():
                if dim in fitted:
                    x = _matrix(pdf["weights"].iloc[at], len(at))
                    x = x / max(1.0, np.abs(x).max())
                    centre[at] = _nearest(x, fitted[dim][0])
                    way[at] = np.einsum("ij,ij->i", x, fitted[dim][1][centre[at]])
            yield pdf.assign(centre=centre, way=way)

    return run


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition cut into ranges of one length; the first row of each has its term maxima and minima."""
    part, nth = TaskContext.get().partitionId(), 0
    rest = None
    for pdf in frames:
        rest = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
        while len(rest) > 2 * RANGE:
            yield from _range(rest.iloc[:RANGE], part, nth)
            nth += 1
            rest = rest.iloc[RANGE:].reset_index(drop=True)
    for at in range(0, len(rest) if rest is not None else 0, RANGE):
        yield from _range(rest.iloc[at : at + RANGE], part, nth)
        nth += 1


def _range(rows: pd.DataFrame, part: int, nth: int) -> Iterator[pd.DataFrame]:
    for k, (dim, own) in enumerate(rows.groupby("dim")):
        x = _matrix(own["weights"], len(own))
        rest = [None] * (len(own) - 1)
        yield pd.DataFrame({
            "dim": dim, "rng": (part << 40) + (nth << 8) + min(k, 255), "place": np.arange(len(own), dtype=np.int32), "vec_id": own["vec_id"].to_numpy(), "weights": own["weights"].to_numpy(),
            "most": [x.max(0).tobytes(), *rest], "least": [x.min(0).tobytes(), *rest],
        })


def bounds_of(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Largest score of each query in each range or block."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def best_of(q: np.ndarray, own: np.ndarray, kth: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[list[tuple], int]:
    """((query's place, id, score) of the k best at least of its ``kth``, and the blocks opened for all queries."""
    if d.shape[1] * float(np.abs(d).max(initial=0)) * float(np.abs(q).max(initial=0)) >= 2.0**53:
        d, q = d.astype(np.int64), q.astype(np.int64)  # doubles would round
    starts = np.arange(0, len(d), block)
    bounds = bounds_of(q, np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts))
    order = np.argsort(-bounds, axis=1, kind="stable")
    out, opened = [], 0
    for n in range(len(q)):
        scores, found, least = np.zeros(0, d.dtype), np.zeros(0, np.int64), kth[n]
        ranked = bounds[n, order[n]]
        at = 0
        while at < len(ranked) and ranked[at] >= least:
            # blocks a few at a time, more once the first ones have set the threshold
            some = order[n, at : at + (4 if not at else 16)]
            some = some[bounds[n, some] >= least]
            opened += len(some)
            rows = (some[:, None] * block + np.arange(block)).ravel()
            rows = rows[rows < len(d)]
            s, i = d[rows] @ q[n], ids[rows]
            keep = (i != own[n]) & (s >= least)
            scores, found = np.concatenate((scores, s[keep])), np.concatenate((found, i[keep]))
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
            if len(best) == k:
                least = max(least, float(scores[-1]))
            at += 4 if not at else 16
        out += zip([n] * len(found), found.tolist(), scores.astype(np.int64).tolist())
    return out, opened


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, report: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with the rows of ``vectors``, ties to smaller ids.

    With ``report`` instead one row: (blocks, opened), pairs of a query and a block of its length, and those that were scored.
    """
    spark = vectors.sparkSession
    ship(spark)

    def prepared(df: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        return rows.mapInPandas(_weights(scale), "vec_id long, dim int, weights binary")

    weighed = prepared(vectors)
    sample = weighed.orderBy(F.xxhash64("vec_id"), "vec_id", "weights").select("dim", "weights").limit(SAMPLE).collect()
    keyed = weighed.mapInPandas(_keyed(fit_centres(sample)), "vec_id long, dim int, weights binary, centre int, way double")
    order = ["dim", "centre", "way", "vec_id", "weights"]
    docs = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_ranges, DOCS), "topk-docs")
    asked = prepared(queries).distinct().withColumn("qry", F.xxhash64("vec_id", "weights"))
    asked = written(asked, "topk-queries")
    tops = written(docs.where("most is not null").select("dim", "rng", "most", "least"), "topk-bounds")
    groups, folds = max(1, -(-asked.count() // GROUP)), max(1, -(-tops.count() // BOUNDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("binary")

    def cells(q: DataFrame) -> DataFrame:
        """Queries (with their thresholds) and ranges' bounds in a grid of cells of bounded size."""
        return q.select(
            F.pmod("qry", F.lit(groups)).cast("int").alias("grp"), every(folds).alias("fold"), "dim", F.lit(True).alias("query"), F.col("qry").alias("id"), "kth", "weights", none.alias("least")
        ).unionByName(tops.select(
            every(groups).alias("grp"), F.pmod(F.xxhash64("rng"), F.lit(folds)).cast("int").alias("fold"), "dim", F.lit(False).alias("query"), F.col("rng").alias("id"),
            F.lit(0.0).alias("kth"), F.col("most").alias("weights"), "least",
        )).groupBy("grp", "fold", "dim")

    def bounded(first: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            q, r = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
            if not len(q) or not len(r):
                return pd.DataFrame({"qry": [], "rng": [], "bound": []}).astype({"qry": "int64", "rng": "int64"})
            b = bounds_of(_matrix(q["weights"], len(q)), _matrix(r["weights"], len(r)), _matrix(r["least"], len(r)))
            if first:
                a, c = np.arange(len(q)), b.argmax(1)
            else:
                # bounds beyond 2^53 may be rounded; they are let through from a little below
                kth = q["kth"].to_numpy(np.float64)[:, None]
                a, c = np.nonzero(b >= kth - np.abs(kth) * 1e-12)
            return pd.DataFrame({"qry": q["id"].to_numpy()[a], "rng": r["id"].to_numpy()[c], "bound": b[a, c]})

        return run

    def scored(pairs: DataFrame) -> DataFrame:
        """(query_id, qry, vec_id, score, blocks, opened) from the documents of each pair's range; one row at least for each pair."""
        busy = pairs.groupBy("rng").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("turns"))
        rows = docs.join(busy, "rng").select(
            "rng", "place", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("query"), F.lit(0).cast("long").alias("qry"), "vec_id", F.lit(0.0).alias("kth"), "weights"
        ).unionByName(
            pairs.join(busy, "rng").join(asked.select("qry", F.col("vec_id"), "weights"), "qry")
            .select("rng", F.lit(0).alias("place"), F.pmod(F.xxhash64("qry"), "turns").cast("int").alias("turn"), F.lit(True).alias("query"), "qry", "vec_id", "kth", "weights")
        )

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            q, d = pdf[pdf["query"]], pdf[~pdf["query"]]
            names = ["query_id", "qry", "vec_id", "score", "blocks", "opened"]
            if not len(q) or not len(d):
                return pd.DataFrame({c: [] for c in names}, dtype="int64")
            d = d.sort_values("place")
            x = _matrix(d["weights"], len(d))
            found, opened = best_of(_matrix(q["weights"], len(q)), q["vec_id"].to_numpy(), q["kth"].to_numpy(np.float64), x, d["vec_id"].to_numpy(), k)
            ids, qry = q["vec_id"].tolist(), q["qry"].tolist()
            out = [(ids[n], qry[n], i, s, 0, 0) for n, i, s in found]
            out.append((ids[0], qry[0], None, None, len(q) * -(-len(d) // BLOCK), opened))
            return pd.DataFrame(out, columns=names).astype({"vec_id": "Int64", "score": "Int64"})

        return rows.groupBy("rng", "turn").applyInPandas(run, "query_id long, qry long, vec_id long, score long, blocks long, opened long")

    low = F.lit(-float("inf"))
    best_range = F.max(F.struct("bound", "rng")).alias("top")
    first = cells(asked.withColumn("kth", low)).applyInPandas(bounded(True), "qry long, rng long, bound double").groupBy("qry").agg(best_range)
    first = written(first.select("qry", F.col("top.rng").alias("rng"), low.alias("kth")), "topk-first")
    rank = F.row_number().over(Window.partitionBy("qry").orderBy(F.desc("score")))
    kth = scored(first).where("vec_id is not null").select("qry", "score", rank.alias("rank")).where(F.col("rank") == k).select("qry", F.col("score").cast("double").alias("kth"))
    kth = written(kth, "topk-kth")
    started = asked.join(kth, "qry", "left").withColumn("kth", F.coalesce("kth", low))
    pairs = cells(started).applyInPandas(bounded(False), "qry long, rng long, bound double").join(started.select("qry", "kth"), "qry").select("qry", "rng", "kth")
    pairs = written(pairs, "topk-pairs")
    released(first)
    found = scored(pairs)
    if report:
        every_block = docs.groupBy("dim", "rng").agg(F.ceil(F.count("*") / BLOCK).alias("b")).groupBy("dim").agg(F.sum("b").alias("b"))
        whole = asked.groupBy("dim").count().join(every_block, "dim").agg(F.coalesce(F.sum(F.col("count") * F.col("b")), F.lit(0)).cast("long").alias("blocks"))
        return whole.crossJoin(found.agg(F.coalesce(F.sum("opened"), F.lit(0)).alias("opened")))  # one row each
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.where("vec_id is not null").select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
