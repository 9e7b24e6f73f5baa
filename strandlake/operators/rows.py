"""Operators over ordered rows, sets of ids and top-k lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, out: str) -> DataFrame:
    """Value minus the one before, by key in order; the first is itself."""
    return df.withColumn(out, F.col(c) - F.coalesce(F.lag(c).over(_by(keys, order)), F.lit(0)))


def undelta(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(c).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str) -> DataFrame:
    """Runs of equal values: (keys, run, value, n), run from 1."""
    w = _by(keys, order)
    opens = F.coalesce((~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(opens)
    runs = df.withColumn("_open", first).withColumn("run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(c).alias("value"), F.count("*").alias("n"))


def run_values(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values that ``run_lengths`` came from, with their places from 1 within each run."""
    return runs.select(*keys, "run", "value", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))


def sliding_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, n: int, out: str = "mean") -> DataFrame:
    """Integer mean of the last ``n`` rows where there are that many."""
    w = _by(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count("*").over(w) == n, F.floor(F.sum(c).over(w) / n)))


def sliding_order_statistic(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, n: int, rank: int, out: str = "stat") -> DataFrame:
    """``rank``-th smallest (from 1) of the last ``n`` rows where there are that many."""
    w = _by(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count("*").over(w) == n, F.element_at(F.sort_array(F.collect_list(c).over(w)), rank)))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def only_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Symmetric difference of two id sets, by one shuffle of each."""
    return a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), key, "full_outer").where("_a is null or _b is null").select(key)


def remap(ids: DataFrame, mapping: DataFrame, key: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(distinct targets, ids without one)."""
    return ids.join(mapping, key).select(to).distinct(), ids.join(mapping, key, "left_anti")


def bitmap_count(ids: DataFrame, key: str) -> DataFrame:
    """Distinct ids by compressed bitmaps, one for each bucket of 32768 ids: (bucket, n)."""
    return ids.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(key))).alias("n"))


def sparse_rank(ids: DataFrame, key: str, width: int = 1 << 20) -> DataFrame:
    """(key, rank) of distinct ids of 0 or more, rank from 0 in order of id.

    Ranks are taken within ranges of ``width`` ids; only the ranges' counts, a row for each, go through one window.
    """
    bucketed = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.floor(F.col(key) / width))
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return bucketed.withColumn("_in", inside).join(before, "_b").select(key, (F.col("_before") + F.col("_in")).cast("long").alias("rank"))
