"""Constraints over ordered rows: partitions of time, bounds, contracts and allowed values, as arrays of errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import SPEED_MAX, SPEED_MIN

# States that evidence may have.
EVIDENCE_STATES = ("VISIBLE_FROM_SOURCE", "TEMPORALLY_INFERRED", "DEPTH_INFERRED", "MULTI_VIEW_SUPPORTED", "GENERATED_ESTIMATE", "UNKNOWN")


@dataclass(frozen=True)
class Rule:
    """Where `broken` holds, a row (or a whole) has the error `text`. Rules of one `place` are told together, in the rows' order."""

    place: int
    broken: Column
    text: Column


def partition_rule(place: int, begins: str, ends: str, name: str, code: str, order: Window) -> Rule:
    """Rows follow each other without a gap or an overlap, from 0 on."""
    expected = F.coalesce(F.lag(ends).over(order) + 1, F.lit(0))
    return Rule(place, expected != F.col(begins), F.concat(F.lit(f"{code}:"), F.col(name), F.lit(":"), F.col(begins), F.lit("!="), expected))


def bound_rule(place: int, value: str, low: float, high: float, name: str, code: str) -> Rule:
    """The value, if any, lies within the bounds, but for a millionth."""
    return Rule(place, ~F.col(value).between(low - 1e-6, high + 1e-6), F.concat(F.lit(f"{code}:"), F.col(name), F.lit(":"), F.col(value)))


def member_rule(place: int, value: str, allowed: tuple[str, ...], name: str, code: str) -> Rule:
    """The value is one of a short list; a null is none."""
    return Rule(place, ~F.coalesce(F.col(value).isin(*allowed), F.lit(False)), F.concat(F.lit(f"{code}:"), F.col(name), F.lit(":"), F.coalesce(value, F.lit("null"))))


def _broken(rules: list[Rule]) -> Column:
    """The rules that don't hold in a row; one whose condition is null holds."""
    return F.filter(F.array(*(F.struct(F.lit(r.place).alias("place"), r.broken.alias("broken"), r.text.alias("text")) for r in rules)), lambda e: e["broken"])


def _told(error: Column) -> Column:
    return F.struct(error["place"].alias("place"), error["text"].alias("text"))


def _texts(errors: str, place: int) -> Column:
    return F.transform(F.filter(errors, lambda e: e["place"] == place), lambda e: e["text"])


def row_errors(rows: DataFrame, keys: list[str], order: list[str], rules: list[Rule]) -> DataFrame:
    """(*keys, errors): of each whole with any, its rows' errors as an array of (place, text), by place and then in the rows' order.
    The rows of a whole are one ordered window; of them only errors are kept."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    told = rows.select(*keys, at.alias("at"), _broken(rules).alias("found"))
    each = told.select(*keys, "at", F.explode("found").alias("e")).select(*keys, F.struct(F.col("e.place").alias("place"), "at", F.col("e.text").alias("text")).alias("e"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("e")), _told).alias("errors"))


def validate_plans(shots: DataFrame, plans: DataFrame, key: str = "plan_id", extra: tuple[Rule, ...] = ()) -> DataFrame:
    """(key, status, errors, shots, expected_frames): what is wrong with each plan.

    shots: key, shot_id, start_frame, end_frame, effective_factor (null: not resolved). plans: key, total_frames,
    duration_preserved, hero_track, followed_track. Shots must part the frames, in their order, up to the total; the
    duration must be preserved, resolved speeds lie within the bounds, and a hero be the followed track. `extra` are
    rules over shots, told after these. A plan without shots ends at 0.
    """
    order = Window.partitionBy(key).orderBy("start_frame", "shot_id")
    rules = [partition_rule(0, "start_frame", "end_frame", "shot_id", "timeline_gap", order),
             bound_rule(3, "effective_factor", SPEED_MIN, SPEED_MAX, "shot_id", "speed_out_of_bounds"), *extra]
    rows = row_errors(shots, [key], ["start_frame", "shot_id"], rules)
    ends = shots.groupBy(key).agg(F.count(F.lit(1)).alias("shots"), (F.max_by("end_frame", F.struct("start_frame", "shot_id")) + 1).alias("expected_frames"))
    p = plans.join(ends, key, "left").join(rows, key, "left").withColumns(
        {"shots": F.coalesce("shots", F.lit(0)), "expected_frames": F.coalesce("expected_frames", F.lit(0))})
    of_plan = [Rule(1, F.col("expected_frames") != F.col("total_frames"), F.concat(F.lit("timeline_end:"), F.col("expected_frames"), F.lit("!="), F.col("total_frames"))),
               Rule(2, ~F.coalesce("duration_preserved", F.lit(False)), F.lit("duration_not_preserved")),
               Rule(4, F.col("hero_track").isNotNull() & ~F.col("followed_track").eqNullSafe(F.col("hero_track")), F.lit("hero_camera_contract"))]
    none = F.array().cast("array<struct<place: int, text: string>>")
    told = F.concat(F.coalesce("errors", none), F.transform(_broken(of_plan), _told))
    places = sorted({rule.place for rule in (*rules, *of_plan)})
    p = p.withColumn("told", told).withColumn("errors", F.concat(*(_texts("told", place) for place in places)))
    return p.select(key, F.when(F.size("errors") == 0, "OK").otherwise("QC_REJECTED").alias("status"), "errors", "shots", "expected_frames")
