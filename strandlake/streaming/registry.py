"""A registry of jobs, waiting clients and what each runs, kept by affinity over a stream of events.

Every affinity has its jobs in a map state (state, client, tries, deadline) and the clients that wait for one in a list state.
Events are ``submit`` (a job comes, Pending), ``fetch`` (a client asks for a job), ``done`` and ``fail`` (of a Running job) and ``cancel``.
A fetch gives out the pending job of smallest number, or else the client waits, and the next job that is submitted, or that
falls back, is given to the client that has waited longest. An affinity has a timer at the earliest deadline of the jobs given out: if the watermark passes a job's deadline, it
falls back to Pending, or fails once it has been tried ``tries`` times; that comes before the events of the next micro-batch.

Rows of one micro-batch and affinity apply in order of time, job and operation, however they arrive; events later than the
watermark are left out, as are those with a null affinity or time. An event that doesn't fit a job's state changes
nothing. A job that has ended is forgotten, so that states hold live jobs alone; its number may come again. Each change of a job is a row of the output: (affinity, job, state, client, tries, at, cause).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "affinity string, job long, op string, client string, ts timestamp"
CHANGES = "affinity string, job long, state string, client string, tries int, at timestamp, cause string"
#: States that end a job: fixed values.
ENDED = ("Done", "Failed", "Canceled")


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class Registry:
    """The rules, over any map of jobs and list of waiting clients; times are milliseconds.

    ``jobs`` maps a number to (state, client, tries, deadline). Pending jobs by number and running ones by deadline are heaps
    from which entries that hold no longer are dropped when they come up, so that an event costs the logarithm of the jobs;
    clients wait in a dict, in order.
    """

    def __init__(self, jobs, waiting: list[str], timeout: int, tries: int):
        self.jobs, self.waiting, self.timeout, self.tries = jobs, dict.fromkeys(waiting), timeout, tries
        self.changes: list[tuple] = []
        self._pending = [j for j, v in jobs.items() if v[0] == "Pending"]
        self._running = [(v[3], j) for j, v in jobs.items() if v[0] == "Running"]
        heapify(self._pending), heapify(self._running)

    def _put(self, job: int, state: str, client: str | None, tries: int, deadline: int, at: int, cause: str) -> None:
        if state in ENDED:
            self.jobs.pop(job, None)
        else:
            self.jobs[job] = (state, client, tries, deadline)
            heappush(*((self._pending, job) if state == "Pending" else (self._running, (deadline, job))))
        self.changes.append((job, state, client, tries, at, cause))

    def _give(self, job: int, client: str, at: int, cause: str) -> None:
        self._put(job, "Running", client, self.jobs[job][2] + 1, at + self.timeout, at, cause)

    def _offer(self, job: int, at: int) -> None:
        if self.waiting:
            client = next(iter(self.waiting))
            del self.waiting[client]
            self._give(job, client, at, "waited")

    def _first(self) -> int | None:
        """The pending job of smallest number."""
        while self._pending:
            if self.jobs.get(self._pending[0], ("",))[0] == "Pending":
                return self._pending[0]
            heappop(self._pending)
        return None

    def event(self, op: str, job: int | None, client: str | None, at: int) -> None:
        own = self.jobs.get(job) if job is not None else None
        if op == "submit" and job is not None and own is None:
            self._put(job, "Pending", None, 0, 0, at, "submit")
            self._offer(job, at)
        elif op == "fetch" and client is not None:
            if (first := self._first()) is not None:
                self._give(first, client, at, "fetch")
            else:
                self.waiting.setdefault(client)
        elif op in ("done", "fail") and own is not None and own[0] == "Running" and own[1] == client:
            self._put(job, "Done" if op == "done" else "Failed", client, own[2], 0, at, op)
        elif op == "cancel" and own is not None:
            self._put(job, "Canceled", own[1], own[2], 0, at, "cancel")

    def late(self, now: int) -> None:
        """What the passing of time does: jobs past their deadline fall back or fail, the earliest first, until none is left."""
        while self._running and self._running[0][0] <= now:
            deadline, job = heappop(self._running)
            own = self.jobs.get(job)
            if own is None or own[0] != "Running" or own[3] != deadline:
                continue
            _, client, tries, _ = own
            if tries >= self.tries:
                self._put(job, "Failed", client, tries, 0, deadline, "timeout")
            else:
                self._put(job, "Pending", None, tries, 0, deadline, "timeout")
                self._offer(job, deadline)


class _Processor(StatefulProcessor):
    def __init__(self, timeout: int, tries: int):
        self.timeout, self.tries = timeout, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job long", "state string, client string, tries int, deadline long")
        self.waiting = handle.getListState("waiting", "client string")

    def _held(self) -> Registry:
        jobs = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        self.stored = set(jobs)
        return Registry(jobs, [r[0] for r in self.waiting.get()] if self.waiting.exists() else [], self.timeout, self.tries)

    def _kept(self, key, held: Registry) -> Iterator[Row]:
        for job in dict.fromkeys(c[0] for c in held.changes):
            if job in held.jobs:
                self.jobs.updateValue((job,), held.jobs[job])
            elif job in self.stored:
                self.jobs.removeKey((job,))
        self.waiting.put([(c,) for c in held.waiting]) if held.waiting else self.waiting.clear()
        old = set(self.handle.listTimers())
        # one timer, of the earliest deadline: what it wakes sees to all that have passed
        now = {min(deadlines)} if (deadlines := [v[3] for v in held.jobs.values() if v[0] == "Running"]) else set()
        for at in now - old:
            self.handle.registerTimer(at)
        for at in old - now:
            self.handle.deleteTimer(at)
        for job, state, client, tries, at, cause in held.changes:
            yield Row(affinity=key[0], job=job, state=state, client=client, tries=tries, at=_at(at), cause=cause)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        held.late(timerValues.getCurrentWatermarkInMs())  # what has passed comes before what is new
        for _, job, op, client, at in sorted(((_ms(r.ts), r.job, r.op, r.client, _ms(r.ts)) for r in rows), key=lambda e: (e[0], e[1] is None, e[1] or 0, e[2] or "", e[3] or "")):
            held.event(op, job, client, at)
        yield from self._kept(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        held.late(timerValues.getCurrentWatermarkInMs())
        yield from self._kept(key, held)

    def close(self) -> None:
        pass


def changes(events: DataFrame, timeout_s: int, tries: int = 3, delay: str = "10 seconds") -> DataFrame:
    """``CHANGES`` of a stream of ``EVENTS``; needs the RocksDB state store, see ``with_state_store``."""
    rows = events.select("affinity", "job", "op", "client", "ts").where("affinity is not null and ts is not null").withWatermark("ts", delay)
    return rows.groupBy("affinity").transformWithState(_Processor(timeout_s * 1000, tries), CHANGES, "Update", "EventTime")


def with_state_store(spark) -> None:
    """The state store that keeps states of several kinds and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def counts(changed: DataFrame) -> DataFrame:
    """(affinity, state, n) of the last state of each job, from all changes so far."""
    last = changed.groupBy("affinity", "job").agg(F.max(F.struct("at", F.when(F.col("cause") == "timeout", 0).when(F.col("cause") == "submit", 1).otherwise(2).alias("o"), "tries", "state")).alias("m"))
    return last.groupBy("affinity", F.col("m.state").alias("state")).agg(F.count("*").alias("n"))
