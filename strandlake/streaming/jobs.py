"""Job states over an event stream: counts, current states, overdue jobs, replicated writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of a job: fixed values.
STATES = ("Pending", "Running", "Canceled", "Failed", "Done", "Reading", "Confirmed", "ReadFailed")
#: Allowed moves: fixed values.
MOVES = {"": ("Pending",), "Pending": ("Running", "Canceled"), "Running": ("Pending", "Done", "Failed", "Canceled"), "Done": ("Reading",), "Reading": ("Confirmed", "ReadFailed", "Done"), "Failed": ("Pending",)}


def state_counts(states: DataFrame) -> DataFrame:
    """(state, n); a stream keeps one row of state for each."""
    return states.groupBy("state").agg(F.count("*").alias("n"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key, by a single partial aggregate."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("e")).select(key, "e.*")


def transitions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Moves by key in order: (before, after, n)."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    return events.select(before.alias("before"), F.col("state").alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


def invalid_moves(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    allowed = [f"{a}>{b}" for a, to in MOVES.items() for b in to]
    return transitions(events, key, order).where(~F.concat_ws(">", "before", "after").isin(*allowed))


def overdue(events: DataFrame, key: str, ts: str, now, seconds: int) -> DataFrame:
    """Keys whose last event is Pending and older than ``seconds``."""
    return latest(events, key, [ts]).where((F.col("state") == "Pending") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(ts) > seconds)).select(key)


def windowed_counts(events: DataFrame, ts: str, size: str, delay: str) -> DataFrame:
    """Counts by event-time window and state; late events beyond ``delay`` are dropped from a stream."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "state", "n")


def sync_log(log: DataFrame) -> DataFrame:
    """Last writer of each key: later time wins, then on one server the later record, then a write over any other event, then the larger server id."""
    return latest(log.withColumn("is_write", (F.col("op") == "write").cast("int")), "key", ["time", "record", "is_write", "server"]).drop("is_write")


def due(entries: DataFrame, now_us: int) -> DataFrame:
    """Entries (id, timeout_us) whose time has come, the earliest first."""
    return entries.where(F.col("timeout_us") <= now_us).orderBy("timeout_us", "id")


def without_batches(events: DataFrame, undone: DataFrame) -> DataFrame:
    """Events of batches that were not undone."""
    return events.join(undone.select("batch").distinct(), "batch", "left_anti")


def append_once(path: str):
    """Sink for ``foreachBatch``: a batch that is run again replaces its own files, so each counts once."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def mates(left: DataFrame, right: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    """Pairs of rows of two streams with one key and times (``ts``, ``ts2``) at most so far apart; state older than that and ``delay`` is dropped."""
    a, b = left.withWatermark("ts", delay), right.withColumnRenamed(key, "_key2").withWatermark("ts2", delay)
    far = F.expr(f"interval {seconds} seconds")
    return a.join(b, (F.col(key) == F.col("_key2")) & (F.col("ts2") >= F.col("ts") - far) & (F.col("ts2") <= F.col("ts") + far)).drop("_key2")
