"""One-to-one assignment of boxes to boxes by overlap, for all frames of all videos at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut_lineage, cut_lineage_counted
from ..sources.shipping import ship_package
from .tracking import assign

CELL = 160.0  # the side of a spatial cell: a box enters every cell that it touches
DENSE = 1 << 22  # pairs of a frame's boxes up to which they are compared where they are assigned, and never written
_TAKEN = "comp struct<video_id:bigint,frame:bigint,node:bigint>, left bigint, right bigint, overlap double"


def _iou(a: str, b: str) -> Column:
    def side(first: str, last: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(f"{a}_{last}", f"{b}_{last}") - F.greatest(f"{a}_{first}", f"{b}_{first}"))

    def area(p: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{p}_x2") - F.col(f"{p}_x1")) * F.greatest(F.lit(0.0), F.col(f"{p}_y2") - F.col(f"{p}_y1"))

    inter = side("x1", "x2") * side("y1", "y2")
    return inter / (area(a) + area(b) - inter + F.lit(1e-9))


def overlapping_boxes(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """(video_id, frame, left, right, overlap) of the pairs of a frame's boxes (id, x1, y1, x2, y2) that overlap.

    An equi-join on cells; a pair that shares several is taken in the one with its overlap's upper left corner.
    """
    def entered(boxes: DataFrame, p: str) -> DataFrame:
        def across(first: str, last: str) -> Column:
            return F.sequence(F.floor(F.col(first) / cell), F.floor(F.col(last) / cell))

        fine = boxes.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))
        spread = fine.select("*", F.explode(across("x1", "x2")).alias("i")).select("*", F.explode(across("y1", "y2")).alias("j"))
        return spread.select("video_id", "frame", "i", "j", F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")))

    met = entered(left, "left").join(entered(right, "right"), ["video_id", "frame", "i", "j"])
    corner = (F.floor(F.greatest("left_x1", "right_x1") / cell) == F.col("i")) & (F.floor(F.greatest("left_y1", "right_y1") / cell) == F.col("j"))
    return met.where(corner).select("video_id", "frame", "left", "right", _iou("left", "right").alias("overlap")).where("overlap > 0")


def _components(pairs: DataFrame) -> DataFrame:
    """pairs with `comp`: the least left box that each is connected with, over boxes that overlap the same box."""
    here = ["video_id", "frame"]
    pairs = cut_lineage(pairs.withColumn("comp", F.col("left")), "overlaps")
    while True:
        by_right = pairs.groupBy(*here, "right").agg(F.min("comp").alias("r"))
        low = pairs.join(by_right, [*here, "right"]).groupBy(*here, "left").agg(F.min("r").alias("l"))
        moved, count = cut_lineage_counted(pairs.join(low, [*here, "left"]).withColumn("moved", F.col("l") < F.col("comp")).withColumn("comp", F.col("l")).drop("l"),
                                           "overlaps", moved=F.count_if("moved"))
        pairs = moved.drop("moved")
        if not count["moved"]:
            return pairs


def _solve(table: pa.Table) -> pa.Table:
    """The assignment of a component's boxes of greatest total overlap. Lefts stand in falling order: of two that are as good for a
    right, the greater gets it."""
    left, right = (table.column(c).to_numpy() for c in ("left", "right"))
    rows, i = np.unique(-left, return_inverse=True)
    rows = -rows
    cols, j = np.unique(right, return_inverse=True)
    overlap = np.zeros((len(rows), len(cols)))
    overlap[i, j] = table.column("overlap").to_numpy()
    found = [(a, b) for a, b in assign(-overlap) if overlap[a, b] > 0]
    return pa.table({"comp": table.column("comp").slice(0, 1).take(pa.array([0] * len(found), pa.int32())), "left": pa.array(rows[[a for a, _ in found]], pa.int64()),
                     "right": pa.array(cols[[b for _, b in found]], pa.int64()), "overlap": pa.array([overlap[a, b] for a, b in found], pa.float64())})


def _assigned_components(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    here = ["video_id", "frame"]
    pairs = cut_lineage(_components(overlapping_boxes(left, right, cell)), "components")
    size = pairs.groupBy(*here, "comp").agg(F.count(F.lit(1)).alias("size"))
    sized = pairs.join(size, [*here, "comp"])
    alone = sized.where("size = 1").select(*here, "left", "right", "overlap")
    key = F.struct(F.col("video_id").cast("long").alias("video_id"), F.col("frame").cast("long").alias("frame"), F.col("comp").cast("long").alias("node")).alias("comp")
    solved = sized.where("size > 1").select(key, "left", "right", "overlap").groupBy("comp").applyInArrow(_solve, _TAKEN)
    return alone.unionByName(solved.select(F.col("comp.video_id").alias("video_id"), F.col("comp.frame").alias("frame"), "left", "right", "overlap"))


def _solve_frame(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """What `_components` and `_solve` give for one frame, from its boxes alone. Lefts stand in falling order, rights in rising."""
    def box(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in ("id", "x1", "y1", "x2", "y2")]

    (a, ax1, ay1, ax2, ay2), (b, bx1, by1, bx2, by2) = box(left), box(right)

    def side(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.minimum(a2[:, None], b2) - np.maximum(a1[:, None], b1))

    inter = side(ax1, ax2, bx1, bx2) * side(ay1, ay2, by1, by2)
    met = inter / (((ax2 - ax1) * (ay2 - ay1))[:, None] + (bx2 - bx1) * (by2 - by1) - inter + 1e-9)
    lefts, i = np.unique(-a, return_inverse=True)
    rights, j = np.unique(b, return_inverse=True)
    overlap = np.zeros((len(lefts), len(rights)))
    p, q = np.nonzero(met > 0)
    overlap[i[p], j[q]] = met[p, q]
    touch, label, none = overlap > 0, np.arange(len(lefts)), len(lefts)
    found = []
    while len(lefts) and len(rights):
        by_right = np.where(touch, label[:, None], none).min(axis=0)
        low = np.minimum(label, np.where(touch, by_right, none).min(axis=1))
        if (low == label).all():
            break
        label = low
    for component in np.unique(label[touch.any(axis=1)]) if touch.size else ():
        rows, cols = np.flatnonzero(label == component), np.flatnonzero(by_right == component)
        own = overlap[np.ix_(rows, cols)]
        found += [(rows[r], cols[c]) for r, c in ([(0, 0)] if own.size == 1 else assign(-own)) if own[r, c] > 0]
    at, to = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    here = [pa.array(np.full(len(found), k.as_py(), np.int64)) for k in key]
    return pa.table(dict(zip(("video_id", "frame", "left", "right", "overlap"), (*here, pa.array(-lefts[at]), pa.array(rights[to]), pa.array(overlap[at, to])), strict=True)))


def _assigned_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """The assignment of each frame's boxes where a frame is a task's work: nothing but the boxes is shuffled or written."""
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)

    def dealt(boxes: DataFrame):
        fine = boxes.where("x1 < x2 AND y1 < y2 AND video_id IS NOT NULL AND frame IS NOT NULL").select(
            F.col("video_id").cast("long").alias("video_id"), F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias("id"), *((F.col(c) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))  # new columns: one side may come from the other
        return fine.repartition(parts, "video_id", "frame").groupBy("video_id", "frame")

    return dealt(left).cogroup(dealt(right)).applyInArrow(_solve_frame, "video_id long, frame long, left long, right long, overlap double")


def assign_boxes(left: DataFrame, right: DataFrame, least: float, cell: float = CELL, dense: int = DENSE) -> DataFrame:
    """(video_id, frame, left, right, overlap, status): the assignment of each frame's boxes of greatest total overlap, of which
    pairs below `least` are let go again, and the boxes of either side that have none (status MATCHED, UNMATCHED_LEFT, UNMATCHED_RIGHT).

    Boxes are (video_id, frame, id, x1, y1, x2, y2). Boxes connected by overlaps are components, which can be assigned each by
    itself. A frame of up to `dense` pairs is compared and assigned at once, and its pairs are never written. Of larger ones,
    which one task might not hold, overlapping pairs come from a join on spatial cells; those that overlap nothing else are
    settled by counts alone, and larger components, some boxes of one frame each, are solved one by one.
    """
    ship_package(left.sparkSession)
    here = ["video_id", "frame"]
    many = left.groupBy(*here).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*here).agg(F.count(F.lit(1)).alias("r")), here).where(F.col("l") * F.col("r") > dense)
    large = cut_lineage(many.select(*here), "large")
    if large.isEmpty():
        taken = _assigned_frames(left, right)
    else:
        taken = _assigned_frames(*(side.join(large, here, "left_anti") for side in (left, right))).unionByName(
            _assigned_components(*(side.join(large, here, "left_semi") for side in (left, right)), cell))
    taken = cut_lineage(taken.where(F.col("overlap") >= least), "assigned")

    def without(boxes: DataFrame, side: str) -> DataFrame:
        other = "right" if side == "left" else "left"
        own = boxes.select(*here, F.col("id").alias(side)).join(taken.select(*here, side), [*here, side], "left_anti")
        return own.select(*here, side, F.lit(None).cast("long").alias(other), F.lit(None).cast("double").alias("overlap"), F.lit(f"UNMATCHED_{side.upper()}").alias("status"))

    return taken.withColumn("status", F.lit("MATCHED")).unionByName(without(left, "left")).unionByName(without(right, "right"))
