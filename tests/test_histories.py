"""Streams with timers over several batches, against the rules applied row by row."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.streaming import replay

HOUR = 3_600_000
EPOCH = pd.Timestamp("2024-01-01")


def stream_of(spark, folder, batches, schema):
    """A stream whose micro-batches are the given lists of rows, with a watermark of two hours on `at`."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
        # files are taken in the order of their times
    frame = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    return frame.withWatermark("at", "2 hours")


def at(hours):
    return (EPOCH + pd.Timedelta(hours=hours)).to_pydatetime()


LOG = "job_id long, step long, state string, progress int, at timestamp"


def test_job_lifecycle_over_batches(spark, tmp_path):
    batches = [
        [(1, 1, "QUEUED", 0, at(0)), (1, 2, "GENERATING", 40, at(1)), (2, 1, "QUEUED", None, at(1)), (1, 2, "GENERATING", 40, at(1))],
        [(1, 3, None, 20, at(2)), (2, 2, "FAILED", 170, at(3)), (2, 3, "GENERATING", 5, at(3)), (3, 1, "QUEUED", -5, at(3))],
        [(1, 3, None, 20, at(2)), (1, 4, "COMPLETED", 100, at(4)), (1, 5, "PROCESSING", 10, at(5))],  # a repeated entry, and one after the end
        [(9, 1, "QUEUED", 1, at(30))],  # the watermark goes on to hour 28: all older jobs expire
        [(3, 2, "GENERATING", 7, at(29)), (1, 9, "QUEUED", 0, at(3))],  # a job begins anew; an entry later than the watermark is passed over
        [(9, 2, "GENERATING", 2, at(60))]]
    told = replay.drain(replay.job_lifecycle(stream_of(spark, tmp_path, batches, LOG), 6 * HOUR), "jobs", "append", timers=True).collect()
    rows = {(r.job_id, r.entries, r.expired): (r.state, r.progress) for r in told}
    assert rows[1, 2, False] == ("GENERATING", 40) and rows[1, 3, False] == ("GENERATING", 20)  # progress may fall
    assert rows[1, 4, False] == rows[1, 4, True] == ("COMPLETED", 100)
    assert rows[2, 2, False] == rows[2, 2, True] == ("FAILED", 100) and not any(job == 2 and n > 2 for job, n, _ in rows)
    # a second life, after the first has expired
    assert sorted((r.began.hour, r.state) for r in told if r.job_id == 3 and r.expired) == [(3, "QUEUED"), (5, "GENERATING")]
    assert max(r.entries for r in told if r.job_id == 1) == 4 and (9, 2, True) not in rows and (9, 1, True) in rows


SEEN = "video_id long, frame long, class_name string, at timestamp"


@pytest.mark.parametrize("every", [1, 3])
def test_ball_history_has_a_row_for_every_frame(spark, tmp_path, every):
    rng = random.Random(every)
    rows = sorted((v, f, rng.choice(("ball", "person", "person")), at(f + 0.5)) for v in (1, 2) for f in rng.sample(range(30), 18) for _ in range(rng.randint(1, 2)))
    rows.sort(key=lambda r: r[3])
    last = max(r[1] for r in rows)
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    history = replay.ball_history(stream_of(spark, tmp_path, batches, SEEN), "ball", EPOCH.value // 1_000_000, HOUR, every)
    got = replay.drain(history, "history", "append", timers=True).collect()
    upto = last + 0.5 - 2  # hours that the watermark has reached
    want = {}
    for v in (1, 2):
        for f in range(0, 40, every):
            if f + 1 <= upto:
                n = sum(r[:3] == (v, f, "ball") for r in rows)
                want[v, f] = (n, "VISIBLE_FROM_SOURCE" if n else "UNKNOWN")
    assert {(r.video_id, r.frame): (r.candidates, r.status) for r in got} == want and len(got) == len(want)


def test_drained_batches_are_read_back_whole(spark, tmp_path):
    batches = [[(1, i, "ball", at(i))] for i in range(4)]
    stream = stream_of(spark, tmp_path, batches, SEEN)
    assert sorted(r.frame for r in replay.drain(stream, "rows", "append").collect()) == [0, 1, 2, 3]
    counted = replay.drain(stream.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")), "counts")
    assert [tuple(r) for r in counted.collect()] == [("ball", 4)]
    empty = spark.readStream.schema(SEEN).parquet(str(tmp_path / "003" / "none*"))
    assert replay.drain(empty, "none", "append").count() == 0


def test_a_job_asks_its_store_once_and_takes_plain_rows():
    from pyspark.sql import Row

    from spanloom.streaming.processors import JobLifecycle

    class Store:
        def __init__(self):
            self.asked, self.value = [], None

        def get(self):
            self.asked.append("get")
            return self.value

        def update(self, value):
            self.asked.append("update")
            self.value = value

        def registerTimer(self, at):
            self.asked.append(f"set {at}")

        def deleteTimer(self, at):
            self.asked.append(f"drop {at}")

        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    store, job = Store(), JobLifecycle(1000)
    job.handle = job.job = store
    entries = [Row(us=2_000_000, step=2, state=None, progress=None), Row(us=1_500_000, step=1, state="QUEUED", progress=-5)]
    assert [tuple(r) for r in job.handleInputRows((7,), iter(entries), store)] == [(7, 1_500_000, "QUEUED", 0, 2, False, 2_000_000)]
    assert store.asked == ["get", "set 3000", "update"]
    again = [tuple(r) for r in job.handleInputRows((7,), iter([Row(us=9_000_000, step=3, state="FAILED", progress=101)]), store)]
    assert again == [(7, 1_500_000, "QUEUED", 0, 2, True, 2_000_000), (7, 9_000_000, "FAILED", 100, 1, False, 9_000_000)]
    assert store.asked[3:] == ["get", "drop 3000", "set 10000", "update"]
