"""Centroid clustering by the threshold algorithm over per-dimension sorted centroid lists.

Every dimension holds the centroids sorted by their component. For a vector each
list is walked outward from the vector's own value, the nearer side first. A
centroid met for the first time, in whatever list, gets its exact distance. The
squares of the distances to the lists' next entries add up to a bound under
which no centroid can lie that has not been met; the walk ends when that sum
strictly exceeds the best exact distance, so that ties are all met and the
smaller number wins. Many vectors walk at once as numpy arrays.

A round reads the written vectors once. Each task adds up its vectors by
centroid; the sums meet in ``MEETING`` groups and then as ``MEETING`` rows a
centroid at most on the driver, so nothing there grows with the rows. Sums are
Python integers, and so exact at any size. Centroids are a parameter's number of
rows and travel with the tasks.

Vectors that are null, of another length than asked, or with a null or
non-finite component are left out. Repeated rows are vectors each. Rows without
vec_id are assigned and counted as others, and are first centroids only where
rows with ids are too few. With fewer vectors than centroids each is one; with
none there are no rows. A distance or sum beyond 64 bits is null; what is
nearest is told exactly all the same. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import released, written
from strandlake.session import ship

#: Vectors that walk at once, and groups in which the tasks' sums meet.
STEP, MEETING = 1024, 64
#: Below this, squared distances of a few thousand components stay within 64 bits.
SMALL = 1 << 24
FAR = np.iinfo(np.int64).max


def _exact(rows: list[list[int]] | np.ndarray) -> np.ndarray:
    """64-bit integers where squares stay within them, else Python's."""
    a = np.array(rows, object)
    if not a.size or max(map(abs, (a.min(), a.max()))) < SMALL:
        return a.astype(np.int64)
    return a


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance, exact distances worked out) of each row of ``x``."""
    n, k = len(x), len(centroids)
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
        none: object = float("inf")
    else:
        none = FAR
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, 0)
    right = np.column_stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(x.shape[1])])
    left = right - 1
    dims = np.arange(x.shape[1])
    best = np.full((n, k), none, x.dtype)
    met = np.zeros((n, k), bool)
    walking, opened = np.arange(n), 0
    while len(walking):
        v, lo, hi = x[walking], left[walking], right[walking]
        below, above = v - lists[np.maximum(lo, 0), dims], lists[np.minimum(hi, k - 1), dims] - v
        down = (lo >= 0) & ((hi >= k) | (below <= above))
        took = order[np.where(down, lo, hi), dims]
        left[walking], right[walking] = lo - down, hi + ~down
        new = np.zeros((len(walking), k), bool)
        new[np.arange(len(walking))[:, None], took] = True
        a, c = np.nonzero(new & ~met[walking])
        met[walking[a], c] = True
        step = x[walking[a]] - centroids[c]
        best[walking[a], c] = (step * step).sum(1)
        opened += len(a)
        # the lists' next entries bound whatever has not been met
        walking = walking[~met[walking].all(1)]
        v, lo, hi = x[walking], left[walking], right[walking]
        below, above = v - lists[np.maximum(lo, 0), dims], lists[np.minimum(hi, k - 1), dims] - v
        front = np.where((lo >= 0) & ((hi >= k) | (below <= above)), below, above)
        walking = walking[(front * front).sum(1) <= best[walking].min(1)]
    number = best.argmin(1)
    return number, best[np.arange(n), number], opened


def _vectors(raw: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    if np.abs(x).max(initial=0) < SMALL:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x.tolist()], object)


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pc.list_flatten(batch.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in np.floor(scale * x)], pa.binary())], names=["vec_id", "x"])

    return run


def _summed(centroids: np.ndarray):
    """One row a centroid and task: its vectors and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, opened = [0] * len(centroids), [0] * len(centroids), 0
        for batch in batches:
            for at in range(0, len(batch), STEP):
                x = _vectors(batch.column(0).slice(at, STEP))
                number, _, some = nearest(x, centroids)
                opened += some
                for c in np.unique(number).tolist():
                    own = x[number == c]
                    count[c] += len(own)
                    total[c] = total[c] + own.sum(0).astype(object)
        some = [c for c in range(len(centroids)) if count[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([count[c] for c in some], pa.int64()), pa.array([json.dumps(total[c].tolist()) for c in some], pa.string()), pa.array([0 if k else opened for k in range(len(some))], pa.int64())],
            names=["cluster", "n", "sums", "opened"],
        )

    return run


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    out = [(c, int(own["n"].sum()), json.dumps([sum(v) for v in zip(*map(json.loads, own["sums"]))]), int(own["opened"].sum())) for c, own in pdf.groupby("cluster")]
    return pd.DataFrame(out, columns=["cluster", "n", "sums", "opened"])


SUMS = "cluster int, n long, sums string, opened long"


def moved(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after one round, and the exact distances that it worked out; those without vectors stay."""
    parts = vectors.select("x").mapInArrow(_summed(centroids), SUMS).withColumn("meet", F.spark_partition_id() % MEETING)
    rows = parts.groupBy("meet").applyInPandas(lambda pdf: _met(pdf), SUMS).collect()  # MEETING rows a centroid at most
    out = [[int(v) for v in row] for row in centroids.tolist()]
    for c in {r["cluster"] for r in rows}:
        own = [r for r in rows if r["cluster"] == c]
        n = sum(r["n"] for r in own)
        out[c] = [sum(v) // n for v in zip(*(json.loads(r["sums"]) for r in own))]
    return _exact(out), sum(r["opened"] for r in rows)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", report: bool = False) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` components.

    First centroids are the k vectors of smallest sha256 of ``seed:vec_id``. With ``report`` instead (round, distances, opened):
    pairs of a vector and a centroid, and those whose exact distance was worked out.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce((F.size("embedding") == dim) & finite, F.lit(False)))
    kept = written(rows.mapInArrow(_scaled(scale), "vec_id long, x binary"), "centroid-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(drawn.asc_nulls_last(), "vec_id", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "round int, distances long, opened long") if report else kept.select(
            "vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids, told = _exact([[int(c) for c in np.frombuffer(r["x"]).tolist()] for r in first]), []
    for _ in range(rounds):
        centroids, opened = moved(kept, centroids)
        told.append(opened)
    if report:
        pairs = kept.count() * len(centroids)
        return spark.createDataFrame([(r, pairs, n) for r, n in enumerate(told)], "round int, distances long, opened long")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                own = batch.slice(at, STEP)
                number, distance, _ = nearest(_vectors(own.column(1)), centroids)
                told = pa.array([int(d) if d <= FAR else None for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(number, pa.int32()), told], names=["vec_id", "cluster", "distance"])

    ends = written(kept.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "centroid-ends")
    released(kept)
    each = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in ends.groupBy("cluster").agg(each.alias("s")).collect()}  # a row a centroid
    fits = lambda v: int(v) if v is not None and v <= FAR else None
    whole = None if None in sums.values() else fits(sum(sums.values()))
    digest = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids.tolist()]
    told = spark.createDataFrame([(c, fits(s), whole, digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
