"""States of jobs from the log of what happens to them, as a stream and as a batch.

A job is queued, starts, and succeeds or fails; it may be cancelled until it has ended. A running job that nothing is
heard of for a while is interrupted, and may start again. What doesn't follow from a job's state is refused: it changes
nothing, and is told. The stream keeps one state a job, with a timer for recovery by event time; the batch folds each
job's events in their order. Both give the same rows for the same log.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states before each event and the one after it; a job without a state has none yet.
TRANSITIONS = {
    "queue": ((None,), "queued"), "start": (("queued", "interrupted"), "running"), "finish": (("running",), "succeeded"), "fail": (("running",), "failed"),
    "cancel": (("queued", "running", "interrupted"), "cancelled"), "recover": (("running",), "interrupted"),
}
RESULT = "job string, at timestamp, event string, status string, accepted boolean"


class Jobs(StatefulProcessor):
    """State of each job: its status, and when it was last heard of (microseconds)."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, at long")

    def _held(self) -> tuple:
        return self.state.get() if self.state.exists() else (None, 0)

    def _wait(self, status: str, at: int) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(at // 1000 + self.silence)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last = self._held()
        out = []
        for event in pd.concat(list(rows)).sort_values(["at", "event"]).itertuples():
            at = event.at.value // 1000
            if status == "running" and at > last + self.silence * 1000:
                last += self.silence * 1000
                status = "interrupted"
                out.append((key[0], pd.Timestamp(last, unit="us"), "recover", status, True))
            before, after = TRANSITIONS.get(event.event, ((), None))
            accepted = status in before and at >= last
            status, last = (after, at) if accepted else (status, last)
            out.append((key[0], event.at, event.event, status, accepted))
        if status is not None:
            self.state.update((status, last))
            self._wait(status, last)
        yield pd.DataFrame(out, columns=["job", "at", "event", "status", "accepted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self._held()
        if status == "running":
            last += self.silence * 1000
            self.state.update(("interrupted", last))
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), "recover", "interrupted", True)], columns=["job", "at", "event", "status", "accepted"])

    def close(self) -> None:
        pass


def followed(events: DataFrame, silence: timedelta, late: str = "0 seconds") -> DataFrame:
    """Rows (job, at, event, status, accepted) of a stream (job, at, event): what each event made of its job, refused ones
    and recoveries among them. Events of a job that come later than its last one are refused."""
    marked = events.select(F.col("job").cast("string").alias("job"), "at", "event").withWatermark("at", late)
    ms = int(silence.total_seconds() * 1000)
    return marked.groupBy("job").transformWithStateInPandas(Jobs(ms), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def _next(status: Column, event: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, (before, after) in TRANSITIONS.items():
        known = [b for b in before if b is not None]
        fits = status.isNull() if not known else status.isin(*known)
        found = F.when((event == name) & fits, after).otherwise(found)
    return found


def folded(events: DataFrame, silence: timedelta, until: Column | None = None) -> DataFrame:
    """The same rows of a whole log; `until` is the time up to which silence counts at its end (None: it doesn't)."""
    micros = int(silence.total_seconds() * 1_000_000)
    each = events.select(F.col("job").cast("string").alias("job"), F.struct(F.unix_micros("at").alias("at"), "event").alias("e"))
    row = lambda at, event, status, accepted: F.struct(at.alias("at"), event.alias("event"), status.alias("status"), accepted.alias("accepted"))
    none = F.expr("CAST(array() AS array<struct<at: bigint, event: string, status: string, accepted: boolean>>)")
    state = lambda status, last, rows: F.struct(status.cast("string").alias("status"), last.cast("long").alias("last"), rows.alias("rows"))

    def silent(s: Column, now: Column) -> Column:
        over = (s["status"] == "running") & (now > s["last"] + micros)
        told = F.concat(s["rows"], F.array(row(s["last"] + micros, F.lit("recover"), F.lit("interrupted"), F.lit(True))))
        return F.when(over, state(F.lit("interrupted"), s["last"] + micros, told)).otherwise(s)

    def step(s: Column, e: Column) -> Column:
        after = F.when(e["at"] >= s["last"], _next(s["status"], e["event"]))
        status = F.coalesce(after, s["status"])
        return state(status, F.when(after.isNotNull(), e["at"]).otherwise(s["last"]), F.concat(s["rows"], F.array(row(e["at"], e["event"], status, after.isNotNull()))))

    both = lambda s, e: F.element_at(F.transform(F.array(silent(s, e["at"])), lambda t: step(t, e)), 1)
    run = F.aggregate(F.sort_array(F.collect_list("e")), state(F.lit(None), F.lit(-(2**62)), none), both)
    ended = each.groupBy("job").agg(run.alias("s"))
    if until is not None:
        ended = ended.withColumn("s", silent(F.col("s"), F.unix_micros(until)))
    return ended.select("job", F.inline("s.rows")).select("job", F.timestamp_micros("at").alias("at"), "event", "status", "accepted")


def latest(rows: DataFrame) -> DataFrame:
    """(job, status, n_refused) after all rows."""
    return rows.groupBy("job").agg(F.max_by("status", F.struct("at", "event")).alias("status"), F.count_if(~F.col("accepted")).alias("n_refused"))
