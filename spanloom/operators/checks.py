"""Guards on raw rows, frame lookups, validation of uploads, timeouts, scans of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, decay
from .asof import as_of
from .spatial import nearest_distance_to


def guarded_boxes(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose box (array of strings) has four numbers, with the frame, or the row's place where that is no number."""
    numbers = [F.try_element_at("box", F.lit(i + 1)).try_cast("double") for i in range(4)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1
    cast = raw.select(*keys, "place", F.coalesce(F.col("frame").try_cast("long"), place.cast("long")).alias("frame"), *(n.alias(c) for n, c in zip(numbers, ("x1", "y1", "x2", "y2"), strict=True)))
    return cast.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")


def probed(rate: Column, frames: Column, seconds: Column) -> dict[str, Column]:
    """Frames a second of a rate like `30000/1001` (without a divisor: 1; a rate of nothing, or over 0: null), and the frames of
    a video: those stated, else its length in them, halves to even."""
    parts = F.split(rate, "/")
    top, under = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1))
    fps = F.try_divide(top, F.when(F.coalesce(under, F.lit("")) == "", F.lit(1.0)).otherwise(under.try_cast("double")))
    return {"fps": fps, "frames": F.coalesce(frames.cast("long"), F.bround(seconds * fps, 0).cast("long"))}


def event_window(peak: Column, fps: float, seconds: float, frames: int) -> tuple[Column, Column]:
    """The frames around a peak, inside the video."""
    return clamp(peak - seconds * fps, 0, frames - 1).cast("long"), clamp(peak + seconds * fps, 0, frames - 1).cast("long")


def nearest_frames(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """For each wanted (video_id, frame) the nearest frame that is there, of two the earlier."""
    met = as_of(wanted.select("video_id", "frame").distinct(), there.select("video_id", "frame"), ["video_id"], "frame", [], "nearest")
    return met.select("video_id", "frame", F.col("match.at").alias("nearest"))


def ball_proximity(points: DataFrame, balls: DataFrame, scale: float) -> DataFrame:
    """Least distance of a point (video_id, id, x, y) to any ball of its video, and its decay; of videos with balls."""
    near = nearest_distance_to(points, balls, "x", "y", "bx", "by").where("distance IS NOT NULL").select("video_id", "id", "distance")
    return near.withColumn("proximity", decay(F.col("distance"), scale))


def nearest_rejected(links: DataFrame) -> DataFrame:
    """Each source's rejected link of least gap (then lowest target)."""
    best = F.min_by(F.struct("tgt", "gap", "rejection_reason"), F.struct("gap", "tgt"))
    return links.where("decision = 'REJECTED'").groupBy("video_id", "src").agg(best.alias("b")).select("video_id", "src", "b.*")


def upload_verdict(name: Column, size: Column, most: int, kinds: tuple[str, ...]) -> Column:
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(size.isNull() | (size <= 0), "EMPTY").when(size > most, "TOO_LARGE").when(~kind.isin(*kinds), "BAD_TYPE").otherwise("OK")


def timeouts(log: DataFrame, seconds: int, retries: int, base: int) -> DataFrame:
    """Per job: waits between entries that exceed the limit, the backoff that retries would have taken, and the state it ends in."""
    order = Window.partitionBy("job_id").orderBy("at_us", "step")
    waits = log.withColumn("wait", (F.col("at_us") - F.lag("at_us").over(order)) / 1_000_000)
    late = F.count_if(F.col("wait") > seconds)
    tries = F.least(late, F.lit(retries))
    return waits.groupBy("job_id").agg(late.alias("late"), (tries * (tries + 1) / 2 * base).cast("long").alias("backoff"),
                                       F.when(late > retries, "FAILED").otherwise("COMPLETED").alias("state"))


def progress(polls: Column) -> Column:
    """Three for each poll, up to 85."""
    return F.least(F.lit(85), polls * 3).cast("long")


def crop_window(cx: Column, cy: Column, crop: Column, bias: Column, width: float, height: float) -> dict[str, Column]:
    """A crop of the picture's shape around a centre, the subject at the biased height, inside the picture; null without a centre."""
    w, h = crop * width, crop * height
    left = F.when(cx.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(width) - w, cx - w / 2)))
    top = F.when(cy.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(height) - h, cy - h * bias)))
    return {"left": left, "top": top, "crop_w": w, "crop_h": h}


def above_percentile(values: Column, share: float) -> Column:
    """How many of an array's values exceed its percentile (linear between neighbours)."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(values)))
    limit = a + (b - a) * (at - low)
    return F.size(F.filter(ordered, lambda x: x > limit))


def term_scan(texts: DataFrame, key: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """Which forbidden terms a text holds, in any case, joined in order; only texts with any."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*(F.when(low.contains(term.lower()), F.lit(term)) for term in terms)))
    return texts.select(key, F.array_join(found, ",").alias("terms")).where("terms <> ''")


def missing_classes(targets: DataFrame, names: DataFrame) -> DataFrame:
    """Targets that no name contains. Either is a short list of labels."""
    return targets.join(names, F.lower(F.col("name")).contains(F.lower(F.col("target"))), "left_anti")
