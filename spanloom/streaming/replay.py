"""Replays of a table of events as a stream, and stateful operators on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import MAX_LOST, TRACKED, Tracker, step
from ..sources.durable import fresh_path
from ..sources.shipping import ship_package
from .processors import HISTORY, JOB, BallHistory, JobLifecycle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with an event time that carries a watermark of a day."""
    ship_package(spark)
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    return stream.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, width: str, slide: str) -> DataFrame:
    return stream.groupBy(F.window("at", width, slide)).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what processors with timers need


def drain(stream: DataFrame, name: str, mode: str = "complete", timers: bool = False) -> DataFrame:
    """Runs a streaming query over what there is and returns its result. Every batch is written to a folder of its number, which a
    repeated batch overwrites; of a complete query the last batch is the result, of others all. The driver holds no batch.
    Queries with timers keep their state in RocksDB; the session's setting is as before afterwards."""
    spark = stream.sparkSession
    provider = spark.conf.get(PROVIDER)
    path, log = fresh_path(spark, name), fresh_path(spark, f"{name}-log")

    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    if timers:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, provider)
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema)
    return out.parquet(f"{path}/batch={numbers[-1]}") if mode == "complete" else out.option("recursiveFileLookup", "true").parquet(path)


SILENCE_MS = 31 * 3_600_000  # a video silent for longer than a lost track lives, in event time, gives up its state
STATE = "next_id long, ids array<long>, boxes array<array<double>>, lost array<int>, hits array<int>, frame long"


def _advance(every: int):
    """One video's new frames: the tracker's state is restored, moved on and kept; it ends when the video is silent."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = -1
        tracker = Tracker()
        if state.exists:
            next_id, ids, boxes, lost, hits, last = state.get
            tracker = Tracker(next_id, ids, boxes, lost, hits)
        out = []
        rows = pd.concat(list(frames)).sort_values(["frame", "det_id"])
        for frame, part in rows[rows.frame > last].groupby("frame"):
            if last >= 0:  # sampled frames that showed nothing; beyond these all tracks are gone anyway
                for _ in range(min((int(frame) - last) // every - 1, MAX_LOST + 1)):
                    step(tracker, part[:0])
            out += [(key[0], frame, *row) for row in step(tracker, part)]
            last = int(frame)
        state.update((tracker.next_id, tracker.ids, [list(map(float, b)) for b in tracker.boxes], tracker.lost, tracker.hits, int(last)))
        latest = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + SILENCE_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")]).astype({"det_id": "Int64"})

    return run


def track_stream(detections: DataFrame, every: int = 1) -> DataFrame:
    """The tracker on a stream of detections with their event time `at`, with a state for each video, of which every
    `every`-th frame is sampled: tracks miss those without detections. Frames that come late are passed over."""
    return detections.groupBy("video_id").applyInPandasWithState(_advance(every), TRACKED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- jobs and the ball's history

def job_lifecycle(log: DataFrame, ttl_ms: int) -> DataFrame:
    """A job's state after every batch with entries of it, and once more when it expires. log has a watermark on `at`; an entry
    (job_id, step) that comes again within it counts once, and one that comes later than it is passed over."""
    once = log.dropDuplicatesWithinWatermark(["job_id", "step"]).select(
        "job_id", "step", "state", F.col("progress").cast("int").alias("progress"), F.unix_micros("at").alias("us"), "at")
    told = once.groupBy("job_id").transformWithState(JobLifecycle(ttl_ms), JOB, "append", "EventTime")
    return told.withColumns({"began": F.timestamp_micros("began"), "updated": F.timestamp_micros("updated")})


def ball_history(detections: DataFrame, ball: str, epoch_ms: int, frame_ms: int, every: int = 1) -> DataFrame:
    """The history of a stream of detections (video_id, frame, class_name, at) with a watermark on `at`, from frame 0 on."""
    rows = detections.select("video_id", "frame", "class_name", "at")
    return rows.groupBy("video_id").transformWithStateInPandas(BallHistory(ball, epoch_ms, frame_ms, every), HISTORY, "append", "EventTime")
