"""Job states: the stream, in several batches and over a restart, against the batch and a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import job_states as J

SILENCE = timedelta(minutes=30)


def log(seed, n=200):
    rng, at = random.Random(seed), datetime(2026, 1, 1)
    out = []
    for _ in range(n):
        at += timedelta(minutes=rng.choice([1, 2, 5, 17]))
        out.append((f"j{rng.randrange(12)}", at, rng.choice(["queue", "queue", "start", "start", "finish", "fail", "cancel", "recover", "odd"])))
    return out


def plain(events, until=None):
    state, out = {}, []

    def silent(job, now):
        status, last = state.get(job, (None, datetime.min))
        if status == "running" and now > last + SILENCE:
            state[job] = ("interrupted", last + SILENCE)
            out.append((job, last + SILENCE, "recover", "interrupted", True))

    for job, at, event in sorted(events, key=lambda e: (e[1], e[2])):
        silent(job, at)
        status, last = state.get(job, (None, datetime.min))
        before, after = J.TRANSITIONS.get(event, ((), None))
        ok = status in before
        state[job] = (after, at) if ok else (status, last)
        out.append((job, at, event, state[job][0], ok))
    for job in list(state) if until else ():
        silent(job, until)
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    events = log(seed)
    df = spark.createDataFrame(events, "job string, at timestamp, event string").repartition(3)
    assert rows(J.folded(df, SILENCE)) == plain(events)


def test_stream_with_a_restart(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events, schema = log(3), "job string, at timestamp, event string"
    source = str(tmp_path / "log")

    def run():
        stream = J.followed(spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source), SILENCE)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    try:
        for i in range(0, len(events), 50):
            spark.createDataFrame(events[i : i + 50], schema).coalesce(1).write.mode("append").parquet(source)
            if i in (50, 150):  # two files each, then a restart from the checkpoint
                run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = max(at for _, at, _ in events)
    found = rows(spark.read.parquet(str(tmp_path / "out")))
    # a timer fires once the watermark has passed it
    assert found == plain(events, last) or found == plain(events)
    assert any(not r[4] for r in found) and any(r[2] == "recover" and r[4] for r in found)
    batch = rows(J.folded(spark.createDataFrame(events, schema), SILENCE, F.lit(last)))
    assert batch == plain(events, last)
