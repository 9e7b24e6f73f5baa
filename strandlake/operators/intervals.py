"""Interval operators: overlap join by bins, merging, coverage, subtraction, hit filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, lo: str, hi: str, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int, a_lo: str = "a_lo", a_hi: str = "a_hi", b_lo: str = "b_lo", b_hi: str = "b_hi") -> DataFrame:
    """Pairs of rows with equal ``key`` whose closed intervals meet, by an equi-join on bins.

    A pair is kept in the first bin that it shares, so nothing needs to be made distinct.
    Choose ``width`` near the usual length of intervals. Both sides are shuffled: rows by bin, and often the intervals themselves,
    come of ``explode``, whose rows Spark's estimate doesn't count, so that it would send far more than it thinks to the driver.
    """
    left, right = _binned(a, a_lo, a_hi, width, "_bin"), _binned(b, b_lo, b_hi, width, "_bin")
    first = F.floor(F.greatest(a_lo, b_lo) / width)
    return left.join(right.hint("merge"), [key, "_bin"]).where((F.col(a_lo) <= F.col(b_hi)) & (F.col(b_lo) <= F.col(a_hi)) & (F.col("_bin") == first)).drop("_bin")


def _merged(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("lo") > before + gap).cast("int"), F.lit(1))
    run = F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_open", opens).withColumn("_run", run).groupBy(*keys, "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_run")
    )


def islands(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi", gap: int = 0, width: int | None = None) -> DataFrame:
    """Union of closed intervals by key; those at most ``gap`` apart are joined. (key, lo, hi, n)

    Intervals of one start are one row before any window. With ``width``, those that start in one range of so many
    places are merged first, each range a task; of these only islands that another range may touch, and one row a
    range, are merged by key: for keys that hold many rows.
    """
    rows = df.groupBy(key, F.col(lo).alias("lo")).agg(F.max(hi).alias("hi"), F.count("*").alias("n"))
    if width is None:
        return _merged(rows, [key], gap)
    rows = _merged(rows.withColumn("_range", F.floor(F.col("lo") / width)), [key, "_range"], gap)
    w = Window.partitionBy(key).orderBy("_range")
    ends = rows.groupBy(key, "_range").agg(F.max("hi").alias("_hi"), F.min("lo").alias("_lo"))
    ends = ends.select(key, "_range", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_lo").over(w).alias("_next"))
    touched = F.coalesce(F.col("lo") <= F.col("_before") + gap, F.lit(False)) | F.coalesce(F.col("hi") + gap >= F.col("_next"), F.lit(False))
    rows = rows.join(ends.withColumnRenamed(key, "_key"), rows[key].eqNullSafe(F.col("_key")) & (rows["_range"] == ends["_range"])).select(rows[key].alias(key), "lo", "hi", "n", touched.alias("_touched"))
    return rows.where("not _touched").drop("_touched").unionByName(_merged(rows.where("_touched").drop("_touched"), [key], gap))


def coverage(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """Depth by sweep line: (key, lo, hi, depth) of every stretch with constant depth above 0.

    With ``width``, sums run within ranges of so many places, each a task, and only the ranges' totals by key: for keys that hold many rows.
    """
    ends = df.select(key, F.col(lo).alias("at"), F.lit(1).alias("d")).unionByName(df.select(key, (F.col(hi) + 1).alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy(key, "at").agg(F.sum("d").alias("d"))
    if width is None:
        w = Window.partitionBy(key).orderBy("at")
        return steps.select(key, F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("d").over(w).alias("depth")).where("depth > 0")
    steps = steps.withColumn("_range", F.floor(F.col("at") / width))
    whole = Window.partitionBy(key).orderBy("_range")
    totals = steps.groupBy(key, "_range").agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    totals = totals.select(key, "_range", (F.sum("_d").over(whole) - F.col("_d")).alias("_before"), F.lead("_first").over(whole).alias("_next"))
    w = Window.partitionBy(key, "_range").orderBy("at")
    inside = steps.select(key, "_range", F.col("at").alias("lo"), F.lead("at").over(w).alias("_at"), F.sum("d").over(w).alias("_depth")).join(totals, [key, "_range"])
    return inside.select(key, "lo", (F.coalesce("_at", "_next") - 1).alias("hi"), (F.col("_depth") + F.col("_before")).alias("depth")).where("depth > 0")


def complement(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi", width: int | None = None) -> DataFrame:
    """Gaps between the islands of a key; ``width`` as for ``islands``."""
    w = Window.partitionBy(key).orderBy("lo")
    return islands(df, key, lo, hi, width=width).select(key, (F.col("hi") + 1).alias("gap_lo"), (F.lead("lo").over(w) - 1).alias("gap_hi")).where("gap_lo <= gap_hi")


def smallest_container(loc: DataFrame, feat: DataFrame, key: str, loc_id: str, feat_id: str, width: int) -> DataFrame:
    """For each location (a_lo, a_hi) the feature (b_lo, b_hi) that contains it with fewest bases more, ties to the smaller id."""
    held = overlap_join(loc, feat, key, width).where("b_lo <= a_lo and b_hi >= a_hi").withColumn("extra", F.expr("(b_hi - b_lo) - (a_hi - a_lo)"))
    return held.groupBy(loc_id).agg(F.min(F.struct("extra", feat_id)).alias("m")).select(loc_id, F.col(f"m.{feat_id}").alias(feat_id), F.col("m.extra").alias("extra"))


def relation(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """How the first interval lies to the second."""
    return (
        F.when((a_lo == b_lo) & (a_hi == b_hi), "same").when((a_lo > b_hi) | (b_lo > a_hi), "apart").when((a_lo >= b_lo) & (a_hi <= b_hi), "subset")
        .when((a_lo <= b_lo) & (a_hi >= b_hi), "superset").when(a_lo < b_lo, "overlap_left").otherwise("overlap_right")
    )


def best_hits(hits: DataFrame, key: str, hit_id: str, score: str, width: int, overhang: float = 0.1) -> DataFrame:
    """Hits (lo, hi) that no hit of the same key and better score covers, its ends stretched by ``overhang`` of the hit's length.

    All hits are judged against all others at once, so the result doesn't depend on their order.
    """
    a = hits.select(key, F.col(hit_id).alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col(score).alias("a_s"))
    b = hits.select(key, F.col(hit_id).alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col(score).alias("b_s"))
    slack = F.floor((F.col("a_hi") - F.col("a_lo")) * overhang)
    better = (F.col("b_s") > F.col("a_s")) | ((F.col("b_s") == F.col("a_s")) & (F.col("b_id") < F.col("a_id")))
    covered = overlap_join(a, b, key, width).where(better & (F.col("a_id") != F.col("b_id")) & (F.col("b_lo") <= F.col("a_lo") + slack) & (F.col("b_hi") >= F.col("a_hi") - slack))
    return hits.join(covered.select(F.col("a_id").alias(hit_id)).distinct(), hit_id, "left_anti")


def culled(hits: DataFrame, key: str, hit_id: str, score: str, width: int, most: int) -> DataFrame:
    """Hits that fewer than ``most`` better hits of the same key contain."""
    a = hits.select(key, F.col(hit_id).alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col(score).alias("a_s"))
    b = hits.select(key, F.col(hit_id).alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col(score).alias("b_s"))
    better = (F.col("b_s") > F.col("a_s")) | ((F.col("b_s") == F.col("a_s")) & (F.col("b_id") < F.col("a_id")))
    over = overlap_join(a, b, key, width).where(better & (F.col("b_lo") <= F.col("a_lo")) & (F.col("b_hi") >= F.col("a_hi")))
    crowded = over.groupBy(F.col("a_id").alias(hit_id)).agg(F.count("*").alias("_over")).where(F.col("_over") >= most)
    return hits.join(crowded, hit_id, "left_anti")


def compartments(hits: DataFrame, key: str, gap: int) -> DataFrame:
    """``hits`` with ``part``: a new part where the distance to all hits before exceeds ``gap``."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("lo") - before > gap).cast("int"), F.lit(1))
    return hits.withColumn("_open", opens).withColumn("part", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")
