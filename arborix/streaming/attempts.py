"""Limits and job states as folds over an append-only log of attempts, for streams with timers and for tables.

A run may dispatch until an attempt fails, until what it has spent reaches a cap, or until its time is over; a job goes from
submitted through running to an end, and is stalled when nothing is heard of it for long enough. In a stream each key's state
is kept by Spark (it survives restarts with the checkpoint), and timers end what no further row ends. Over a table the same folds are
windows. Rows of a key count in the order of (ts, id); a stream takes them batch by batch in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: What ends a job.
FINAL = ("succeeded", "failed", "cancelled", "expired")
GUARD = "run string, stopped_at timestamp, reason string, spent double, attempts long"
JOB = "job string, ts timestamp, status string, polls long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seconds(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def dispatched(attempts: DataFrame, cap: float, seconds: float) -> DataFrame:
    """``attempts`` (run, id, ts, status, cost) with ``spent_before``, ``elapsed`` and ``reason``: why it may not be dispatched, or null.

    An attempt may be dispatched if none before it failed ("error"), if what those before it cost is below ``cap``
    ("spend") and if less than ``seconds`` have passed since the run's first ("time"). Unknown costs count 0. Once stopped, a run stays so.
    """
    earlier = Window.partitionBy("run").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("spent_before", F.coalesce(F.sum(F.coalesce("cost", F.lit(0.0))).over(earlier), F.lit(0.0)))
    rows = rows.withColumn("_failed", F.coalesce(F.max(F.col("status") != "ok").over(earlier), F.lit(False)))
    rows = rows.withColumn("elapsed", _seconds("ts") - F.min(_seconds("ts")).over(Window.partitionBy("run")))
    return rows.withColumn("reason", F.when(F.col("_failed"), "error").when(F.col("spent_before") >= cap, "spend").when(F.col("elapsed") >= seconds, "time")).drop("_failed")


def guard(attempts: DataFrame, cap: float, seconds: float) -> DataFrame:
    """(run, stopped_at, reason, spent, attempts): where each run's log is refused first (null if nowhere), what it took before."""
    rows = dispatched(attempts, cap, seconds)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("ts", "id", "reason", "spent_before")))
    out = rows.groupBy("run").agg(first.alias("stop"), F.count_if(F.col("reason").isNull()).alias("attempts"), F.sum(F.when(F.col("reason").isNull(), F.coalesce("cost", F.lit(0.0)))).alias("spent"))
    return out.select("run", F.col("stop.ts").alias("stopped_at"), F.col("stop.reason").alias("reason"), F.coalesce("spent", F.lit(0.0)).alias("spent"), "attempts")


class Guard(StatefulProcessor):
    """The fold of ``guard`` over a stream: a row when a run stops, be it by a timer after its time is over."""

    def __init__(self, cap: float, seconds: float) -> None:
        self.cap, self.seconds = cap, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "start double, spent double, attempts long, failed boolean, stopped boolean")

    def _stop(self, run: str, at: float, reason: str, spent: float, attempts: int) -> pd.DataFrame:
        return pd.DataFrame([(run, pd.Timestamp(at, unit="s"), reason, spent, attempts)], columns=["run", "stopped_at", "reason", "spent", "attempts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)  # one batch's rows of a run
        log = pd.concat(parts).sort_values(["ts", "id"]) if parts else pd.DataFrame()
        start, spent, attempts, failed, stopped = self.state.get() if self.state.exists() else (None, 0.0, 0, False, False)
        for row in log.itertuples():
            at = row.ts.timestamp()
            if start is None:
                start = at
                self.handle.registerTimer(int((start + self.seconds) * 1000))
            if stopped:
                break
            reason = "error" if failed else "spend" if spent >= self.cap else "time" if at - start >= self.seconds else None
            if reason:
                stopped = True
                yield self._stop(key[0], at, reason, spent, attempts)
            else:
                spent, attempts, failed = spent + (0.0 if pd.isna(row.cost) else row.cost), attempts + 1, row.status != "ok"
        if start is not None:
            self.state.update((start, spent, attempts, failed, stopped))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, spent, attempts, failed, stopped = self.state.get()
        if not stopped:
            self.state.update((start, spent, attempts, failed, True))
            yield self._stop(key[0], start + self.seconds, "error" if failed else "spend" if spent >= self.cap else "time", spent, attempts)

    def close(self) -> None:
        pass


class Jobs(StatefulProcessor):
    """The last known status of each job: a row at each change, ``stalled`` when nothing is heard for ``seconds``; nothing follows an end."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, ts double, polls long")

    def _row(self, job: str, at: float, status: str, polls: int) -> tuple:
        return job, pd.Timestamp(at, unit="s"), status, polls

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, last, polls = self.state.get() if self.state.exists() else (None, 0.0, 0)
        out = []
        parts = list(rows)
        for row in (pd.concat(parts).sort_values(["ts", "id"]) if parts else pd.DataFrame()).itertuples():
            if status in FINAL:
                break
            polls, last = polls + 1, row.ts.timestamp()
            if row.status != status:
                status = row.status
                out.append(self._row(key[0], last, status, polls))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status is not None and status not in FINAL:
            self.handle.registerTimer(int((last + self.seconds) * 1000))
        self.state.update((status, last, polls))
        if out:
            yield pd.DataFrame(out, columns=["job", "ts", "status", "polls"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, polls = self.state.get()
        if status not in (*FINAL, "stalled"):
            self.state.update(("stalled", last, polls))
            yield pd.DataFrame([self._row(key[0], last + self.seconds, "stalled", polls)], columns=["job", "ts", "status", "polls"])

    def close(self) -> None:
        pass


def stream_guard(attempts: DataFrame, cap: float, seconds: float, late: str = "0 seconds") -> DataFrame:
    """GUARD rows of a stream of attempts (run, id, ts, status, cost); the session's state store must keep timers (ROCKS)."""
    rows = attempts.withWatermark("ts", late).groupBy("run")
    return rows.transformWithStateInPandas(Guard(cap, seconds), GUARD, "append", "EventTime")


def stream_jobs(polls: DataFrame, seconds: float, late: str = "0 seconds") -> DataFrame:
    """JOB rows of a stream of polls (job, id, ts, status)."""
    return polls.withWatermark("ts", late).groupBy("job").transformWithStateInPandas(Jobs(seconds), JOB, "append", "EventTime")


def job_states(polls: DataFrame, until: str, seconds: float) -> DataFrame:
    """(job, status, ts, polls) over a table of polls, as of the time ``until``: the last status before an end, or stalled."""
    earlier = Window.partitionBy("job").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin(*FINAL)).over(earlier), F.lit(False))
    last = polls.withColumn("_ended", ended).filter("NOT _ended").groupBy("job").agg(F.max(F.struct("ts", "id", "status")).alias("x"), F.count(F.lit(1)).alias("polls"))
    silent = _seconds(F.lit(until)) - _seconds("x.ts") >= seconds
    return last.select("job", F.when(silent & ~F.col("x.status").isin(*FINAL), "stalled").otherwise(F.col("x.status")).alias("status"), "x.ts", "polls")
