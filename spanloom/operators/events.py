"""Motion events and the explained ranking of their subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, decay, first_tag, fixed, saturate
from ..sources.durable import cut_lineage
from .tracks import track_stats

MIN_DISPLACEMENT, FULL_DISPLACEMENT, MAX_CONFIDENCE = 40.0, 300.0, 0.99
# Fixed values of the ranking: weights and scales.
WEIGHTS = {"amplitude": 0.30, "persistence": 0.26, "continuity": 0.08, "event_proximity": 0.12, "spatial_relevance": 0.12, "event_confidence": 0.12}
BALL_WEIGHT = 0.15
AMPLITUDE_SCALE, PERSISTENCE_SCALE, PROXIMITY_SCALE, BALL_SCALE = 300.0, 120.0, 250.0, 140.0
TOP = 10
BUCKET = 16  # frames of which balls stand in one list


def motion_events(obs: DataFrame) -> DataFrame:
    """An event for each track of three rows or more that got further than 40 from where it began."""
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    middle = obs.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("video_id", "track_id")))
    peaks = middle.where((F.col("n") >= 3) & (F.col("place") == F.floor(F.col("n") / 2))).select("video_id", "track_id", F.col("frame").alias("peak_frame"))
    stats = track_stats(obs).where((F.col("n") >= 3) & (F.col("displacement") > MIN_DISPLACEMENT))
    return stats.join(peaks, ["video_id", "track_id"]).select(
        "video_id", "track_id", F.concat(F.lit("MOTION_"), F.col("track_id")).alias("event_id"),
        F.col("first_frame").alias("start_frame"), "peak_frame", F.col("last_frame").alias("end_frame"),
        F.least(F.lit(MAX_CONFIDENCE), F.col("displacement") / FULL_DISPLACEMENT).alias("confidence"),
        F.array(F.concat(F.lit("track:"), F.col("track_id")), F.concat(F.lit("displacement:"), fixed(F.col("displacement"), 2))).alias("evidence"))


def with_evidence(events: DataFrame) -> DataFrame:
    """The track and the displacement that an event's tags name; unreadable ones are null and 0."""
    return events.withColumns({
        "tag_track": first_tag(F.col("evidence"), "track").try_cast("long"),
        "tag_displacement": F.coalesce(first_tag(F.col("evidence"), "displacement").try_cast("double"), F.lit(0.0))})


def ball_evidence(obs: DataFrame, ball: str) -> DataFrame:
    """Per video: how many ball observations, their first and last frame, and the median frame (rounded down)."""
    balls = obs.where(F.col("class_name") == ball)
    return balls.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("balls"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.floor(F.percentile("frame", F.lit(0.5))).cast("long").alias("focus_frame"))


def ball_centres(obs: DataFrame, ball: str) -> DataFrame:
    """One ball a video and frame: that of the greatest track."""
    return obs.where(F.col("class_name") == ball).groupBy("video_id", "frame").agg(
        F.max_by("cx", "track_id").alias("bx"), F.max_by("cy", "track_id").alias("by"))


def nearest_distance(obs: DataFrame, balls: DataFrame) -> DataFrame:
    """Each track's least distance to a ball, at the track's observation nearest in time (of two equally near, the earlier).

    An observation is the nearest for the frames from the middle between it and the one before to the middle between it and
    the next. It enters the buckets of BUCKET frames that these touch, and meets there the list of the bucket's balls. A track has
    no more rows on this way than observations and buckets together, and no pair of a ball and a track is shuffled.
    """
    track = ["video_id", "track_id"]
    bucket = F.floor(F.col("frame") / BUCKET)
    lists = cut_lineage(balls.where(F.col("frame").isNotNull()).groupBy("video_id", bucket.alias("bucket")).agg(
        F.collect_list(F.struct("frame", "bx", "by")).alias("balls"), F.min("frame").alias("first"), F.max("frame").alias("last")), "balls")
    ends = lists.groupBy("video_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    seen = obs.where(F.col("frame").isNotNull()).groupBy(*track, "frame").agg(F.max(F.struct("cx", "cy")).alias("at"))
    order = Window.partitionBy(*track).orderBy("frame")
    middles = seen.withColumns({"after": (F.lag("frame").over(order) + F.col("frame")) / 2, "upto": (F.lead("frame").over(order) + F.col("frame")) / 2})
    spans = middles.join(ends, "video_id").select(*track, "at", F.greatest("after", F.col("first") - 1).alias("after"), F.least("upto", "last").alias("upto"))
    entered = spans.where(F.col("after") < F.col("upto")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("after") / BUCKET), F.floor(F.col("upto") / BUCKET))))
    mine = F.filter("balls", lambda b: (b["frame"] > F.col("after")) & (b["frame"] <= F.col("upto")))
    away = F.array_min(F.transform(mine, lambda b: F.hypot(F.col("at.cx") - b["bx"], F.col("at.cy") - b["by"])))
    met = entered.join(lists.select("video_id", "bucket", "balls"), ["video_id", "bucket"])  # a track's spans hold all balls of its video
    return met.groupBy(*track).agg(F.min(away).alias("ball_distance"))


def hero_signals(events: DataFrame, stats: DataFrame, focus: DataFrame, distances: DataFrame, height: float) -> DataFrame:
    """Events with the value of each signal and the weighted score. Videos with a ball have one signal more."""
    seen = with_evidence(events).withColumn("track", F.coalesce("tag_track", F.col("track_id"))).drop("track_id").withColumnRenamed("track", "track_id")
    seen = (seen.join(stats.select("video_id", "track_id", "n", "continuity", "displacement", "mean_y"), ["video_id", "track_id"], "left")
            .join(focus.select("video_id", "focus_frame", "balls"), "video_id", "left").join(distances, ["video_id", "track_id"], "left"))
    own_focus = events.groupBy("video_id").agg(F.floor(F.percentile(F.coalesce("peak_frame", "end_frame", "start_frame"), F.lit(0.5))).cast("long").alias("event_focus"))
    seen = seen.join(own_focus, "video_id", "left")
    amplitude = F.when(F.col("tag_displacement") > 0, F.col("tag_displacement")).otherwise(F.coalesce("displacement", F.lit(0.0)))
    focus_frame = F.coalesce("focus_frame", "event_focus")
    has_ball = F.col("balls") > 0
    signals = {
        "amplitude": saturate(amplitude, AMPLITUDE_SCALE),
        "persistence": saturate(F.coalesce("n", F.lit(0)).cast("double"), PERSISTENCE_SCALE),
        "continuity": F.coalesce("continuity", F.lit(0.0)),
        "event_proximity": F.coalesce(decay(F.abs(F.coalesce("peak_frame", "end_frame", "start_frame") - focus_frame), PROXIMITY_SCALE), F.lit(0.0)),
        "spatial_relevance": F.coalesce(clamp(F.col("mean_y") / height), F.lit(0.0)),
        "event_confidence": clamp(F.col("confidence"))}
    ball = F.coalesce(decay(F.col("ball_distance"), BALL_SCALE), F.lit(0.0))
    base = sum((F.lit(WEIGHTS[name]) * value for name, value in signals.items()), F.lit(0.0))
    score = F.when(has_ball, (base + F.lit(BALL_WEIGHT) * ball) / F.lit(sum(WEIGHTS.values()) + BALL_WEIGHT)).otherwise(base)
    return seen.select("video_id", "track_id", "event_id", *(value.alias(name) for name, value in signals.items()),
                       F.when(has_ball, ball).alias("ball_proximity"), amplitude.alias("amplitude_px"),
                       F.coalesce("n", F.lit(0)).alias("persistence_frames"), score.alias("score"))


def rank_heroes(signals: DataFrame, top: int = TOP) -> DataFrame:
    """The best events of each video, in a total order."""
    order = Window.partitionBy("video_id").orderBy(
        F.desc(fixed(F.col("score"), 12)), F.desc("persistence_frames"), F.desc(fixed(F.col("amplitude_px"), 6)), F.desc("event_id"))
    return signals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
