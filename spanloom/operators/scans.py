"""Recurrences over ordered series, as blocked scans: exponential smoothing with resets and holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import cut_lineage, cut_lineage_counted
from .asof import as_of

BLOCK = 64  # places of the order that one array holds


def affine_scan(rows: DataFrame, keys: list[str], at: str, a: Column, b: Column, block: int = BLOCK) -> DataFrame:
    """rows with `before` and `after`: the value of each key's series before and after a row, where a row takes v to a + b v.

    A series begins with 0. `at` orders it: a whole number, unique in the key. Affine maps compose, so a row's value
    follows from the map of all rows of its block up to it and from the value with which the block begins; and these values
    are those of the same scan over one row a block. Each round handles blocks of `block` places, so no task needs a whole
    series, and the rounds are as many as the logarithm of its length to that base. All stays in the JVM; within a block
    rows are composed one by one, so that the sums have the order of the series.
    """
    fields = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    item = ", ".join(f"{'`' + c + '`'}: {kinds[c]}" for c in fields)
    held = rows.select(*keys, F.floor(F.col(at) / block).alias("__block"),
                       F.struct(F.col(at).alias("at"), F.struct(*fields).alias("row"), a.cast("double").alias("a"), b.cast("double").alias("b")).alias("step"))
    grouped = held.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    none = F.array().cast(f"array<struct<row: struct<{item}>, a: double, b: double, a0: double, b0: double>>")

    def onward(acc: Column, step: Column) -> Column:
        met = F.struct(step["row"].alias("row"), step["a"].alias("a"), step["b"].alias("b"), acc["a"].alias("a0"), acc["b"].alias("b0"))
        return F.struct((step["a"] + step["b"] * acc["a"]).alias("a"), (step["b"] * acc["b"]).alias("b"), F.concat(acc["done"], F.array(met)).alias("done"))

    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), none.alias("done"))
    folded = grouped.select(*keys, "__block", F.aggregate("steps", start, onward).alias("f"))
    folded, count = cut_lineage_counted(folded, "scan-blocks", more=F.count_if(F.col("__block") != 0))
    whole = folded.select(*keys, "__block", F.lit(0.0).alias("carry"))
    if count["more"]:
        ends = folded.select(*keys, "__block", F.col("f.a").alias("a"), F.col("f.b").alias("b"))
        whole = affine_scan(ends, keys, "__block", F.col("a"), F.col("b"), block).select(*keys, "__block", F.col("before").alias("carry"))
    out = folded.join(whole, [*keys, "__block"]).select(*keys, "carry", F.explode("f.done").alias("d"))
    before = F.col("d.a0") + F.col("d.b0") * F.col("carry")
    return out.select(*keys, "d.row.*", before.alias("before"), (F.col("d.a") + F.col("d.b") * before).alias("after"))


def smooth_with_resets(rows: DataFrame, keys: list[str], at: str, value: str, restart: str, hold: str, alpha: float, out: str = "smooth") -> DataFrame:
    """Exponential smoothing of a series that is set anew where `restart` is true, and kept as it was where `hold` is (a null is
    neither). Whoever calls makes a series begin with a restart."""
    again, still = (F.coalesce(F.col(c), F.lit(False)) for c in (restart, hold))
    x = F.col(value)
    a = F.when(again, x).when(still, 0.0).otherwise(F.lit(alpha) * x)
    b = F.when(again, 0.0).when(still, 1.0).otherwise(F.lit(1.0 - alpha))
    return affine_scan(rows, keys, at, a, b).withColumnRenamed("after", out).drop("before")


def shot_smoothing(obs: DataFrame, shots: DataFrame, alpha: float = 0.35) -> DataFrame:
    """The smoothed centre of each track over a video's shots (video_id, start_frame, transition_in).

    At the first row in another shot than the row before, a hard cut sets the centre anew; any other transition keeps it
    as it was for that row. A track's first row sets it.
    """
    track = ["video_id", "track_id"]
    turns = obs.select(*track).distinct().join(shots.select("video_id", F.col("start_frame").alias("frame"), "transition_in"), "video_id")
    met = as_of(obs.select(*track, "frame", "cx"), turns, track, "frame", ["transition_in"])
    before = Window.partitionBy(*track).orderBy("frame")
    first, changed = F.lag("frame").over(before).isNull(), ~F.lag("match.at").over(before).eqNullSafe(F.col("match.at"))
    rows = met.select(*track, "frame", "cx", (first | (changed & (F.col("match.transition_in") == "HARD_CUT"))).alias("restart"), (~first & changed).alias("hold"))
    return smooth_with_resets(cut_lineage(rows, "shot-rows"), track, "frame", "cx", "restart", "hold", alpha, "smooth_x").select(
        "video_id", "track_id", "frame", "restart", (F.col("hold") & ~F.col("restart")).alias("hold"), "smooth_x")
