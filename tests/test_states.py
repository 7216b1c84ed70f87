"""States of runs: the stream's last word on each run is the batch's; late events and timers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import states

SCHEMA = "run string, event string, ts timestamp"


def play(spark, folder, batches, name):
    """Each batch of (run, event, hour) is a file of its own, and a micro-batch."""
    (folder / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    q = states.state_changes(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/check").start()
    try:
        for i, rows in enumerate(batches):
            stamp = lambda h: f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00.000Z"
            text = "".join(json.dumps({"run": r, "event": e, "ts": stamp(h)}) + "\n" for r, e, h in rows)
            (folder / f"{i}.tmp").write_text(text)
            (folder / f"{i}.tmp").rename(folder / "in" / f"{i}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    return [(r.run, r.state) for r in spark.table(name).collect()]


def test_timers_late_events_and_recovery(spark, tmp_path):
    batches = [
        [("a", "start", 0), ("b", "start", 1), ("c", "start", 2), ("other", "noise", 2)],
        [("b", "done", 10), ("c", "beat", 40)],
        [("clock", "start", 52)],  # 48 hours after a's last event, and more
        [("clock", "beat", 53), ("d", "failed", 53)],
        [("a", "beat", 54), ("late", "start", 5)],  # a goes on; the late start is behind the watermark
        [("d", "beat", 56), ("b", "start", 57)],  # failed and done are final
    ]
    found = play(spark, tmp_path, batches, "changes")
    assert [s for r, s in found if r == "a"] == ["RUNNING", "RUNNING-STALLED", "RUNNING"]
    assert [s for r, s in found if r == "b"] == ["RUNNING", "DONE"] and [s for r, s in found if r == "c"] == ["RUNNING"]
    assert [s for r, s in found if r == "d"] == ["STOPPED"] and [s for r, s in found if r == "clock"] == ["RUNNING"]
    assert {r for r, _ in found} == {"a", "b", "c", "d", "clock"}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_ends_as_the_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = sorted(((f"r{r.randrange(9)}", r.choice(["start", "beat", "beat", "beat", "beat", "done", "failed"] if r.random() < 0.3 else ["beat"]), r.randrange(1, 400)) for _ in range(60)), key=lambda x: x[2])
    batches = [rows[i : i + 8] for i in range(0, len(rows), 8)] + [[("clock", "beat", 430)], [("clock", "beat", 431)], [("clock", "beat", 431)]]
    last = dict(play(spark, tmp_path, batches, f"ends{seed}"))
    flat = [x for b in batches for x in b]
    events = spark.createDataFrame([(a, e, h * 3600) for a, e, h in flat], "run string, event string, s long").select("run", "event", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"))
    want = {x.run: x.state for x in states.run_states(events, F.timestamp_seconds(F.lit(1704067200 + 430 * 3600))).collect()}
    assert last == want and {"RUNNING-STALLED"} <= set(want.values())
