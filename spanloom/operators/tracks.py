"""Track statistics, fragments, ranges and robust velocities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, fixed

TRACK = ["video_id", "track_id"]
MAD_FLOOR = 0.75
HIGH, LOW = 0.5, 0.1  # fixed values: bands of confidence
RECENT, EDGE = 6, 5
PERSON_WIDTH, PERSON_HEIGHT = 90.0, 140.0  # fixed values: the largest mean box of a person


def stride_sample(frames: DataFrame, every: int, most: int) -> DataFrame:
    """Every `every`-th frame of a video, the first `most` of them (0: all)."""
    kept = frames.select("video_id", "frame").distinct().where(F.col("frame") % every == 0)
    if not most:
        return kept
    order = Window.partitionBy("video_id").orderBy("frame")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def class_rollup(detections: DataFrame, person: str, ball: str, confident: float = 0.25) -> DataFrame:
    return detections.groupBy("video_id").agg(
        F.count_distinct("frame").alias("frames"), F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("class_name") == person).alias("persons"), F.count_if(F.col("class_name") == ball).alias("balls"),
        F.count_if(F.col("confidence") >= confident).alias("confident"), F.count_distinct("track_id").alias("tracks"))


def with_box(obs: DataFrame) -> DataFrame:
    """Box corners (of centre, width w and height h), extent, area, aspect, and a crop clamped to whole pixels of at least one."""
    half_width, half_height = F.col("w") / 2, F.col("h") / 2
    box = obs.select("*", (F.col("cx") - half_width).alias("x1"), (F.col("cy") - half_height).alias("y1"),
                     (F.col("cx") + half_width).alias("x2"), (F.col("cy") + half_height).alias("y2")).drop("w", "h")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    left = F.greatest(F.lit(0), F.floor("x1").cast("long"))
    return box.select("*", w.alias("w"), h.alias("h"), (w * h).alias("area"), (w / (h + EPS)).alias("aspect"),
                      left.alias("crop_left"), F.greatest(left + 1, F.floor("x2").cast("long")).alias("crop_right"))


def track_stats(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Length, span, continuity, displacement from first to last, where the centre was, and (where boxes have sizes) the mean size."""
    keys = keys or TRACK
    sizes = [name for name in ("w", "h") if name in obs.columns]
    first, last = F.min_by(F.struct("cx", "cy"), "frame"), F.max_by(F.struct("cx", "cy"), "frame")
    stats = obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        first.alias("a"), last.alias("z"), F.avg("cx").alias("mean_x"), F.avg("cy").alias("mean_y"),
        F.min("cx").alias("min_x"), F.max("cx").alias("max_x"), F.avg("confidence").alias("mean_confidence"), *(F.avg(name).alias(f"mean_{name}") for name in sizes))
    span = F.col("last_frame") - F.col("first_frame") + 1
    return stats.select(
        *keys, "n", "first_frame", "last_frame", span.alias("span"), F.least(F.lit(1.0), F.col("n") / span).alias("continuity"),
        F.hypot(F.col("z.cx") - F.col("a.cx"), F.col("z.cy") - F.col("a.cy")).alias("displacement"),
        "mean_x", "mean_y", "min_x", "max_x", "mean_confidence", F.col("a.cx").alias("start_x"), F.col("a.cy").alias("start_y"),
        F.col("z.cx").alias("end_x"), F.col("z.cy").alias("end_y"), *(f"mean_{name}" for name in sizes))


def person_sized(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each track whether its mean box is a person's: larger ones are something in front, not a player."""
    small = (F.avg("w") <= PERSON_WIDTH) & (F.avg("h") <= PERSON_HEIGHT)
    return obs.groupBy(*(keys or TRACK)).agg(F.coalesce(small, F.lit(False)).alias("person_sized"))


def confidence_band(confidence: Column, high: float = HIGH, low: float = LOW) -> Column:
    """HIGH from `high` on, LOW from `low` on, else BELOW; a missing confidence counts as 0."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= high, "HIGH").when(c >= low, "LOW").otherwise("BELOW")


def of_persons(obs: DataFrame) -> DataFrame:
    """The observations of person-sized tracks."""
    return obs.join(person_sized(obs).where("person_sized"), TRACK, "left_semi")


def keyframes(tracks: DataFrame, most: int = 8) -> DataFrame:
    """Of each track every n-th observation in order, from the first on, where n is its length over `most`, rounded down, but 1 at least."""
    track = Window.partitionBy(*TRACK)
    placed = tracks.select("*", (F.row_number().over(track.orderBy("frame")) - 1).alias("place"), F.count(F.lit(1)).over(track).alias("length"))
    return placed.where(F.col("place") % F.greatest(F.lit(1), F.floor(F.col("length") / most)) == 0).drop("place", "length")


def track_ranges(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def moving_ranges(obs: DataFrame, least: float = 1e-3) -> DataFrame:
    """First frame, last frame that moved against the one before (else the first), and the moved frames."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    moved = F.hypot(F.col("cx") - F.lag("cx").over(order), F.col("cy") - F.lag("cy").over(order)) > least
    return obs.withColumn("moved", moved).groupBy(*TRACK).agg(
        F.min("frame").alias("first_frame"),
        F.coalesce(F.max(F.when(F.col("moved"), F.col("frame"))), F.min("frame")).alias("last_moving"),
        F.max("frame").alias("last_frame"), F.count_if("moved").alias("moving_frames"))


def edge_velocity(rows: DataFrame, keys: list[str], at_start: bool = False, recent: int = RECENT) -> DataFrame:
    """Median velocity over the last (or first) few steps of a series, its spread, and the plain velocity over the `EDGE` outermost steps."""
    order = Window.partitionBy(*keys).orderBy("frame")
    ranked = rows.withColumn("place", F.row_number().over(order if at_start else Window.partitionBy(*keys).orderBy(F.desc("frame"))))
    near = ranked.where(F.col("place") <= recent + 1)
    dt = F.col("frame") - F.lag("frame").over(order)
    steps = near.select(*keys, "frame", dt.alias("dt"), ((F.col("cx") - F.lag("cx").over(order)) / dt).alias("vx"),
                        ((F.col("cy") - F.lag("cy").over(order)) / dt).alias("vy"), "cx", "cy", F.when(F.col("place") <= EDGE + 1, F.col("frame")).alias("edge"))
    steps = steps.withColumn("speed", F.hypot("vx", "vy"))
    gathered = steps.groupBy(*keys).agg(
        F.median("vx").alias("vx"), F.median("vy").alias("vy"), F.median("speed").alias("mid"), F.count("dt").alias("samples"),
        F.sort_array(F.collect_list("speed")).alias("speeds"),  # at most `recent`
        F.min("frame").alias("a"), F.max("frame").alias("z"),
        ((F.max_by("cx", "edge") - F.min_by("cx", "edge")) / F.nullif(F.max("edge") - F.min("edge"), F.lit(0))).alias("edge_vx"))
    off = F.sort_array(F.transform("speeds", lambda s: F.abs(s - F.col("mid"))))
    n = F.size("speeds")
    mad = (F.try_element_at(off, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(off, F.floor((n + 2) / 2).cast("int"))) * 0.5
    return gathered.select(
        *keys, F.coalesce("vx", F.lit(0.0)).alias("vx"), F.coalesce("vy", F.lit(0.0)).alias("vy"),
        F.coalesce(F.hypot("vx", "vy"), F.lit(0.0)).alias("speed"),
        F.when(F.col("samples") > 0, F.greatest(mad, F.lit(MAD_FLOOR))).otherwise(F.lit(MAD_FLOOR)).alias("dispersion"),
        "samples", F.when(F.col("samples") > 0, F.col("z") - F.col("a")).otherwise(F.lit(0)).alias("support"),
        F.exists("speeds", lambda s: s > EPS).alias("moving"), F.coalesce("edge_vx", F.lit(0.0)).alias("edge_vx"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({name: fixed(F.col(name), places) for name in names})
