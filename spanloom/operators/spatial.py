"""Nearest points in the plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut_lineage, cut_lineage_counted

GROWTH = 4.0  # how much wider the cells of each round are
SIDE, LEVELS = 32, 8  # cells along a side of a grid, and how many grids stand about each other
CELLS = "{key} long, level int, i int, j int, x0 double, y0 double, reach double, near array<struct<x: double, y: double>>"


def _finite(*columns: str) -> Column:
    return F.coalesce(sum((F.abs(F.col(c)) for c in columns), F.lit(0.0)) < 1e300, F.lit(False))


def nearest_distance_to(points: DataFrame, targets: DataFrame, x: str, y: str, tx: str, ty: str, key: str = "video_id", out: str = "distance") -> DataFrame:
    """points with their distance to the nearest target of the same key; null where there is none or a coordinate is no finite number.

    A planar grid searched in growing rings. A key's cells are as wide as its targets are apart on average, and each cell has
    the list of the targets in it and the eight around it. A point meets the list of its cell by an equi-join; if the nearest in
    it is no farther than a cell is wide, none outside the nine cells can be nearer, and the point is settled. The others go
    on to cells four times as wide. Points are never multiplied, each is written once when it is settled, and the lists are
    some ten targets long where most points are settled.
    """
    targets = targets.where(_finite(tx, ty)).select(key, F.col(tx).alias("__x"), F.col(ty).alias("__y"))
    extent = F.greatest(F.max("__x") - F.min("__x"), F.max("__y") - F.min("__y")) / F.ceil(F.sqrt(F.count(F.lit(1))))
    sizes = cut_lineage(targets.groupBy(key).agg(F.when(extent > 0, extent).otherwise(F.lit(1.0)).alias("__size")), "sizes")
    placed = cut_lineage(targets.join(sizes, key), "targets")
    left, settled, scale = points.join(sizes, key, "left"), [], 1.0
    neighbours = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    while True:
        width = F.col("__size") * scale

        def cell(a: str, b: str, width=width):
            return F.floor(F.col(a) / width), F.floor(F.col(b) / width)

        own = cell("__x", "__y")
        around = placed.select(key, "__x", "__y", own[0].alias("__i"), own[1].alias("__j"), neighbours.alias("__n")).groupBy(
            key, (F.col("__i") + F.col("__n.i")).alias("__i"), (F.col("__j") + F.col("__n.j")).alias("__j")).agg(
            F.collect_list(F.struct("__x", "__y")).alias("__near"))
        at = cell(x, y)
        met = left.withColumns({"__i": at[0], "__j": at[1]}).join(around, [key, "__i", "__j"], "left")
        away = F.array_min(F.transform("__near", lambda t: F.hypot(F.col(x) - t["__x"], F.col(y) - t["__y"])))
        step = met.withColumn(out, away)
        known = _finite(x, y) & F.col("__size").isNotNull()
        done = ~known | F.coalesce(F.col(out) <= width, F.lit(False))
        step = step.withColumn("__done", done).withColumn(out, F.when(known, F.col(out))).select(*points.columns, out, "__size", "__done")
        step, count = cut_lineage_counted(step, "nearest", open=F.count_if(~F.col("__done")))
        settled.append(step.where("__done").select(*points.columns, out))
        if not count["open"]:
            break
        left, scale = step.where("NOT __done").drop(out, "__done"), scale * GROWTH
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def nearest_cells(targets: DataFrame, tx: str, ty: str, key: str = "video_id") -> DataFrame:
    """For each key and cell of the plane the targets that are nearest to some point in it, for `distance_by_cells`.

    Grids of SIDE x SIDE cells about the middle of a key's targets, each GROWTH times as wide as the one before; all that is beyond
    the last has one cell with all targets. A target is left out of a cell if another is nearer to all its points. There are
    some 8000 cells a key, whatever the number of points; one task makes a grid from one key's targets.
    """
    fine = targets.where(_finite(tx, ty)).select(F.col(key).cast("long").alias(key), F.col(tx).alias("x"), F.col(ty).alias("y"))
    levels = fine.withColumn("level", F.explode(F.array(*(F.lit(level) for level in range(LEVELS + 1)))))
    columns = [c.split()[0] for c in CELLS.format(key=key).split(", ")[:8]]

    def grid(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf[["x", "y"]].to_numpy(), axis=0)
        x0, y0 = np.median(pdf[["x", "y"]].to_numpy(), axis=0)
        reach = 2 * float(np.median(np.abs(pdf[["x", "y"]].to_numpy() - (x0, y0)).max(axis=1))) or 1.0
        level = int(group[1])

        def rows(cells: list) -> pd.DataFrame:
            return pd.DataFrame([(group[0], level, i, j, x0, y0, reach, [{"x": x, "y": y} for x, y in near]) for i, j, near in cells], columns=columns)

        if level == LEVELS:
            return rows([(0, 0, points)])
        half = reach * GROWTH**level
        width = 2 * half / SIDE
        low = np.arange(SIDE) * width - half
        slack = 1e-6 * width  # a point may be put in a cell that it misses by a rounding
        out, inner = [], range(SIDE * 3 // 8 + 1, SIDE * 5 // 8 - 1)  # what lies further inside belongs to the grid before
        edges = np.stack([low - slack, low + width + slack], 1)
        away = [np.square(edges[:, :, None] + middle - points[:, axis]) for axis, middle in ((0, x0), (1, y0))]
        for i in range(SIDE):
            corners = (away[0][i][None, :, None, :] + away[1][:, None, :, :]).reshape(SIDE, 4, -1)
            kept = np.ones((SIDE, len(points)), bool)
            for corner in range(4):  # against the target nearest to a corner: who is farther from all four corners is farther from all points
                rival = np.take_along_axis(corners, corners[:, corner].argmin(axis=1)[:, None, None], axis=2)
                kept &= (corners <= rival * (1 + 1e-12)).any(axis=1)
            out += [(i, j, points[kept[j]]) for j in range(SIDE) if not (level and i in inner and j in inner)]
        return rows(out)

    return levels.groupBy(key, "level").applyInPandas(grid, CELLS.format(key=key))


def grids_of(cells: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, grid): where the grids of a key's cells stand."""
    return cells.where(F.col("level") == LEVELS).select(key, F.struct("x0", "y0", "reach").alias("grid"))


def distance_by_cells(points: DataFrame, cells: DataFrame, x: str, y: str, grid: str, out: str, key: str = "video_id") -> DataFrame:
    """points (with their key's `grid`, null where it has no targets) with their distance to the nearest target, as `nearest_distance_to`
    has it, by one look into a broadcast table: for points that are too many to be shuffled or written."""
    g = F.col(grid)
    dx, dy = F.col(x) - g["x0"], F.col(y) - g["y0"]
    away = F.greatest(F.abs(dx), F.abs(dy)) / g["reach"]
    level = F.when(~_finite(x, y), None).when(away <= 1, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log(away) / F.log(F.lit(GROWTH))))).cast("int")
    half = g["reach"] * F.pow(F.lit(GROWTH), F.col("__level"))

    def place(d: Column) -> Column:
        return F.when(F.col("__level") < LEVELS, F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor((d + half) * SIDE / (2 * half))))).otherwise(0).cast("int")

    placed = points.withColumn("__level", level).withColumns({"__i": place(dx), "__j": place(dy)})
    table = cells.select(key, F.col("level").alias("__level"), F.col("i").alias("__i"), F.col("j").alias("__j"), "near")
    distance = F.array_min(F.transform("near", lambda t: F.hypot(F.col(x) - t["x"], F.col(y) - t["y"])))
    return placed.join(F.broadcast(table), [key, "__level", "__i", "__j"], "left").select(*points.columns, distance.alias(out))
