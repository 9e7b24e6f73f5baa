"""The job registry over a stream: rules one at a time, and a stream out of order against them."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from strandlake.streaming import registry as R

START = datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


def test_rules():
    r = R.Registry({}, [], timeout=1000, tries=2)
    for op, job, client, at in (("fetch", None, "x", 0), ("fetch", None, "x", 1), ("submit", 5, None, 10), ("submit", 5, None, 11), ("submit", 3, None, 12), ("done", 5, "y", 13), ("fetch", None, "y", 20)):
        r.event(op, job, client, at)
    assert r.changes == [(5, "Pending", None, 0, 10, "submit"), (5, "Running", "x", 1, 10, "waited"), (3, "Pending", None, 0, 12, "submit"), (3, "Running", "y", 1, 20, "fetch")]
    r.late(1009)
    assert len(r.changes) == 4
    r.event("fetch", None, "z", 1005)
    r.late(1010)
    assert r.changes[4:] == [(5, "Pending", None, 1, 1010, "timeout"), (5, "Running", "z", 2, 1010, "waited")]
    r.event("done", 3, "y", 1015)
    r.event("cancel", 3, None, 1016)
    r.late(5000)
    assert r.changes[6:] == [(3, "Done", "y", 1, 1015, "done"), (5, "Failed", "z", 2, 2010, "timeout")]
    r.event("cancel", 5, None, 6000)
    assert len(r.changes) == 8


def test_stream_out_of_order(spark, tmp_path):
    """Three micro-batches, each shuffled; the same rules applied in the order of times, with deadlines as the watermark passes them."""
    before = spark.conf.get(STORE)
    R.with_state_store(spark)
    rng, batches = random.Random(4), []
    for b in range(3):
        rows = []
        for _ in range(60):
            at = START + timedelta(seconds=b * 100 + rng.randrange(0, 60), milliseconds=rng.randrange(0, 1000))
            rows.append((rng.choice("ab"), rng.randrange(0, 25), rng.choice(("submit", "submit", "fetch", "done", "fail", "cancel")), rng.choice(("x", "y", "z")), at))
        batches.append(rows + ([(None, 1, "submit", "x", START), ("a", 1, "submit", "x", None)] if b == 0 else []))
    (tmp_path / "in").mkdir()
    for b, rows in enumerate(batches):
        spark.createDataFrame(rng.sample(rows, len(rows)), R.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{b}")
    # a file a batch, in order
    import os
    import shutil

    (tmp_path / "all").mkdir()
    for b in range(3):
        name = next(f for f in os.listdir(tmp_path / "in" / f"b{b}") if f.endswith(".parquet"))
        shutil.copy(tmp_path / "in" / f"b{b}" / name, tmp_path / "all" / f"{b}.parquet")
        os.utime(tmp_path / "all" / f"{b}.parquet", (1_700_000_000 + b, 1_700_000_000 + b))
    stream = spark.readStream.schema(R.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    out = R.changes(stream, timeout_s=30, tries=2, delay="10 seconds")
    q = out.writeStream.outputMode("update").format("memory").queryName("registry_changes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set(STORE, before)
    assert q.exception() is None
    got = defaultdict(list)
    for r in spark.table("registry_changes").collect():
        got[r.affinity].append((r.job, r.state, r.client, r.tries, R._ms(r.at.replace(tzinfo=R.timezone.utc)), r.cause))
    ms = lambda at: R._ms(at.replace(tzinfo=R.timezone.utc))
    for affinity in "ab":
        want, newest = R.Registry({}, [], 30_000, 2), 0
        for rows in batches:
            want.late(newest - 10_000)  # the watermark of the batches before
            own = [r for r in rows if r[0] == affinity and r[4] is not None]
            for r in sorted(own, key=lambda r: (ms(r[4]), r[1], r[2], r[3])):
                want.event(r[2], r[1], r[3], ms(r[4]))
            newest = max([newest, *(ms(r[4]) for r in rows if r[0] and r[4])])
        want.late(newest - 10_000)
        assert sorted(got[affinity], key=repr) == sorted(want.changes, key=repr) and any(c[5] == "timeout" for c in want.changes)
    last = {}
    for r in R.counts(spark.table("registry_changes")).collect():
        last[r.affinity, r.state] = r.n
    assert sum(last.values()) == sum(len({c[0] for c in own}) for own in got.values())


def test_registry_of_events(spark, sf):
    """The registered query: one micro-batch of all events."""
    from pyspark.sql import functions as F

    from strandlake import queries as own, restore_queries  # noqa: F401  registers its queries

    got = {(r.affinity, r.state): r.n for r in own.queries()["job_registry"](spark, sf).collect()}
    e = own.events(spark, sf).select((F.col("user_id") % 8).cast("string").alias("a"), "event_id", "event_type", F.col("user_id").cast("string").alias("u"), F.floor(F.col("us") / 1000).alias("ms"), "us").collect()
    ops = {"view": "submit", "click": "fetch", "purchase": "cancel"}
    held, last = {}, {}
    for r in sorted((r for r in e if r.event_type in ops), key=lambda r: (round(r.us / 1000), r.event_id, ops[r.event_type])):
        held.setdefault(r.a, R.Registry({}, [], 3_600_000, 2)).event(ops[r.event_type], r.event_id, r.u, round(r.us / 1000))
    newest = max(r.us for r in e if r.event_type in ops)
    want = {}
    for a, x in held.items():
        x.late(newest // 1000 - 10_000)
        last = {}
        for c in x.changes:
            last[c[0]] = c[1]
        for state in last.values():
            want[a, state] = want.get((a, state), 0) + 1
    assert got == want
