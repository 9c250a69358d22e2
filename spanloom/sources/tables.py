"""Readers and writers, and the views that the track queries run on.

The views put per-frame observations on the ``events`` table: a user is a track,
ten videos share the users, an hour is a frame, value and props.k are a box's
centre, its size follows from the track, and the event type is the detected
class. Where a track has several events in a frame the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shipping import ship_package

EPOCH = "2024-01-01 00:00:00"
BALL = "purchase"
WIDTHS, HEIGHTS = 9, 11  # how many widths (20, 30, ...) and heights (50, 60, ...) boxes have, by track
FRAMES = 720
SPLIT_GAP = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed or line JSON with a given schema (no inference pass)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(df: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    """Writes a result as json, parquet, orc or csv, optionally partitioned."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def box_sizes(track: Column) -> list[Column]:
    """Width and height of a track's boxes."""
    return [(20.0 + 10.0 * F.pmod(track, F.lit(WIDTHS))).alias("w"), (50.0 + 10.0 * F.pmod(track, F.lit(HEIGHTS))).alias("h")]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a detection: video_id, track_id, frame, det_id, cx, cy, w, h, confidence, class_name, ts."""
    frame = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{EPOCH}', ts)").cast("long")
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).alias("video_id"), F.col("user_id").alias("track_id"), frame.alias("frame"),
        F.col("event_id").alias("det_id"), F.col("value").alias("cx"),
        F.get_json_object("props", "$.k").cast("double").alias("cy"), *box_sizes(F.col("user_id")),
        (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"), F.col("event_type").alias("class_name"), "ts")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track and frame; an aggregate, not a sort, picks the latest detection.

    Detections are dealt by track first: that one shuffle also serves the windows and aggregates by track that follow,
    where dealing by track and frame would need another (and would combine little, as frames have few repeats).
    """
    latest = F.max_by(F.struct("cx", "cy", "w", "h", "confidence", "class_name"), F.struct("ts", "det_id")).alias("o")
    return detections(spark, sf_dir).repartition("video_id", "track_id").groupBy("video_id", "track_id", "frame").agg(latest).select("video_id", "track_id", "frame", "o.*")


def fragment_rows(obs: DataFrame, gap: int = SPLIT_GAP) -> DataFrame:
    """Observations with the fragment they belong to: a track is split where more than `gap` frames are missing."""
    track = Window.partitionBy("video_id", "track_id").orderBy("frame")
    starts = (F.col("frame") - F.lag("frame").over(track) > gap).cast("int")
    return obs.withColumn("fragment_id", F.col("track_id") * 1000 + F.sum(F.coalesce(starts, F.lit(0))).over(track))


def frame_spine(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """Every frame of every video."""
    videos = detections(spark, sf_dir).select("video_id").distinct()
    return videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)).cast("array<bigint>")).alias("frame"))


def motion_series(spark: SparkSession, sf_dir: str, frames: int = FRAMES) -> DataFrame:
    """(video_id, frame, value): the summed values of a frame's detections, 0 where there are none."""
    seen = detections(spark, sf_dir).groupBy("video_id", "frame").agg(F.sum("cx").alias("value"))
    return frame_spine(spark, sf_dir, frames).join(seen, ["video_id", "frame"], "left").select(
        "video_id", "frame", F.coalesce("value", F.lit(0.0)).alias("value"))


# ---- the same views for the oracle

OBS = f"""
det AS (
  SELECT user_id % 10 AS video_id, user_id AS track_id,
    ((epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) // 3600000000)::BIGINT AS frame,
    event_id AS det_id, value AS cx, regexp_extract(props, '"k": *(-?[0-9.]+)', 1)::DOUBLE AS cy,
    20.0::DOUBLE + 10.0 * (user_id % {WIDTHS}) AS w, 50.0::DOUBLE + 10.0 * (user_id % {HEIGHTS}) AS h,
    (event_id % 100) / 100.0::DOUBLE AS confidence, event_type AS class_name, ts
  FROM events),
obs AS (
  SELECT video_id, track_id, frame, cx, cy, w, h, confidence, class_name FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY ts DESC, det_id DESC) AS rn FROM det)
  WHERE rn = 1)"""

FRAG_ROWS = OBS + f""",
marked AS (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame) > {SPLIT_GAP} THEN 1 ELSE 0 END AS starts
  FROM obs),
frows AS (
  SELECT video_id, track_id, frame, cx, cy, w, h, confidence, class_name,
    track_id * 1000 + (sum(starts) OVER (PARTITION BY video_id, track_id ORDER BY frame))::BIGINT AS fragment_id
  FROM marked)"""

SPINE = f"""
spine AS (SELECT v.video_id, unnest(range(0, {FRAMES}))::BIGINT AS frame FROM (SELECT DISTINCT video_id FROM det) v)"""

MOTION = SPINE + """,
motion AS (
  SELECT s.video_id, s.frame, coalesce(m.value, 0.0) AS value
  FROM spine s LEFT JOIN (SELECT video_id, frame, sum(cx) AS value FROM det GROUP BY video_id, frame) m
  ON s.video_id = m.video_id AND s.frame = m.frame)"""


def r6(sql: str, places: int = 6) -> str:
    scale = f"1e{places}"
    return f"(floor(({sql}) * {scale} + 0.5001)::DOUBLE / {scale})"
