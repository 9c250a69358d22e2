"""Pairs of fragments, measured and scored a block of sources against a block of targets at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS
from .spatial import GROWTH, LEVELS, SIDE

SOURCES, TARGETS, STEP = 256, 1024, 32  # fragments of a block, and how many sources are looked at together
SHARES = 4  # parts that a bucket's blocks of sources are dealt into
A = ("src", "src_last", "n", "mean_w", "mean_h", "vx", "vy", "dispersion", "norm", "vector", "end_x", "end_y", "moving")
B = ("tgt", "tgt_first", "n", "mean_w", "mean_h", "vx", "vy", "dispersion", "norm", "vector", "start_x", "start_y")
COUNTS, FLAGS = ("src", "tgt", "gap", "a_n", "b_n"), ("a_moving",)
MEASURES = ("error", "velocity_off", "tolerance", "diagonals", "widths", "heights", "per_frame", "size_off", "aspect_off", "cosine", "mid_x", "mid_y", "ball_distance", "score")


def blocks_of(rows: DataFrame, frame: str, width: int, size: int, *place: str) -> DataFrame:
    """(video_id, bucket, block, rows): the rows of each `width` frames of a video in lists of at most `size`, in order of the frame
    and of their place, so that what is measured on neighbours is alike and files of it are small."""
    placed = rows.withColumn("bucket", F.floor(F.col(frame) / width)).where(F.col("bucket").isNotNull() & F.col("video_id").isNotNull())
    number = F.row_number().over(Window.partitionBy("video_id", "bucket").orderBy(frame, *place)) - 1
    return placed.withColumn("block", F.floor(number / size)).groupBy("video_id", "bucket", "block").agg(
        F.collect_list(F.struct(*(c for c in rows.columns if c != "video_id"))).alias("rows"))


def block_pairs(a: DataFrame, b: DataFrame, least_gap: int, most: int) -> DataFrame:
    """(video_id, a, b): blocks of sources beside those of targets that may begin `least_gap` to `most` frames after one of them.

    An equi-join on buckets of a fifth of `most` frames; no row is larger than two blocks, however many fragments there are."""
    width, spark = max(1, most // 5), a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    a = blocks_of(a, "src_last", width, SOURCES, "end_x", "end_y", "src").select("video_id", F.pmod("block", F.lit(SHARES)).alias("share"), F.col("rows").alias("a"), F.explode(F.sequence(
        F.floor((F.col("bucket") * width + least_gap) / width), F.floor((F.col("bucket") * width + width - 1 + most) / width))).alias("bucket"))
    b = blocks_of(b, "tgt_first", width, TARGETS, "start_x", "start_y", "tgt").select("video_id", "bucket", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")).alias("share"), F.col("rows").alias("b"))
    keys = ["video_id", "bucket", "share"]
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).select("video_id", "a", "b")


def grids_with_cells(cells: DataFrame) -> DataFrame:
    """One row a video with its cells (of `spatial.nearest_cells`, some 8000), for `score_blocks`."""
    place = ((F.col("level") * SIDE + F.col("i")) * SIDE + F.col("j")).alias("place")
    return cells.groupBy("video_id").agg(F.struct(F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("reach").alias("reach"),
                                                  F.collect_list(F.struct(place, "near")).alias("cells")).alias("grid"))


class _Side:
    """The columns of a block. A null number is NaN, and its row is named in `nulls`; the vectors are rows of matrices by length."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.arrow = dict(zip([field.name for field in rows.type], rows.flatten(), strict=True))
        self.count = len(rows)
        self.values, self.nulls = {}, {}
        for name, column in self.arrow.items():
            if name in ("vector", "moving"):
                continue
            self.values[name] = column.to_numpy(zero_copy_only=False)
            if column.null_count:
                self.nulls[name] = column.is_null().to_numpy(zero_copy_only=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]

    def lacks(self, *names: str) -> np.ndarray | None:
        found = [self.nulls[name] for name in names if name in self.nulls]
        return np.logical_or.reduce(found) if found else None

    def looks(self) -> bool:
        """Whether any row has a vector."""
        return "norm" not in self.nulls or not self.nulls["norm"].all()

    def vectors(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length the rows that have a vector with a norm, and these vectors."""
        column = self.arrow["vector"]
        if not self.looks():
            return {}
        fine = ~self.lacks("norm") if "norm" in self.nulls else np.ones(self.count, bool)
        fine &= ~(np.nan_to_num(self["norm"], nan=1.0) <= EPS)
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
        out = {}
        for length in np.unique(lengths[fine]):
            held = np.flatnonzero(fine & (lengths == length))
            out[int(length)] = held, column.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
        return out


def _either(a: np.ndarray | None, b: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
    """Which pairs lack what one of their ends lacks; None if no pair does."""
    if a is None:
        return None if b is None else b[j]
    return a[i] if b is None else a[i] | b[j]


def _cosines(a: _Side, b: _Side) -> np.ndarray | None:
    """Cosines of all pairs of a block, NaN where there are none, and where they are; None if there are none at all."""
    mine, theirs = a.vectors(), b.vectors()
    out = None
    for length in mine.keys() & theirs.keys():
        (i, v), (j, w) = mine[length], theirs[length]
        if out is None:
            out = np.zeros((a.count, b.count)), np.zeros((a.count, b.count), bool)
        out[0][np.ix_(i, j)] = v @ w.T / (a["norm"][i][:, None] * b["norm"][j])
        out[1][np.ix_(i, j)] = True
    return out


class _Balls:
    """Distances to a video's nearest ball by its cells (see `spatial.distance_by_cells`)."""

    def __init__(self, grid: pa.StructScalar) -> None:
        self.x0, self.y0, self.reach = (grid[name].as_py() for name in ("x0", "y0", "reach"))
        cells = grid["cells"].values
        place, near = cells.flatten()
        lengths, points = pc.list_value_length(near).to_numpy(), near.flatten()
        self.x, self.y = (c.to_numpy() for c in points.flatten())
        self.start, self.count = (np.zeros((LEVELS + 1) * SIDE * SIDE, np.int64) for _ in range(2))
        at = place.to_numpy()
        self.start[at], self.count[at] = np.cumsum(lengths) - lengths, lengths

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """NaN for what is no finite place."""
        dx, dy = x - self.x0, y - self.y0
        away = np.maximum(np.abs(dx), np.abs(dy)) / self.reach
        known = np.abs(x) + np.abs(y) < 1e300
        if not known.all():
            out = np.full(len(x), np.nan)
            out[known] = self.distance(x[known], y[known]) if known.any() else 0
            return out
        level, half = np.zeros(len(x), np.int64), np.full(len(x), self.reach)
        for k in range(LEVELS):
            beyond = away > GROWTH**k
            if not beyond.any():
                break
            level += beyond
            half[beyond] *= GROWTH
        scale = SIDE / (2 * half)
        i, j = (np.clip(((d + half) * scale).astype(np.int64), 0, SIDE - 1) for d in (dx, dy))
        place = (level * SIDE + i) * SIDE + j
        place[level == LEVELS] = LEVELS * SIDE * SIDE
        start, count = self.start[place], self.count[place]
        best = np.full(len(x), np.inf)
        left = np.flatnonzero(count > 0)
        for k in range(int(count.max(initial=0))):
            if k:
                left = left[count[left] > k]
            ball = start[left] + k
            best[left] = np.minimum(best[left], (x[left] - self.x[ball]) ** 2 + (y[left] - self.y[ball]) ** 2)
        return np.sqrt(best)


def score_blocks(pairs: DataFrame, columns: list[str], more: dict[str, str], model: dict, least: float | None) -> DataFrame:
    """The pairs of blocks (video_id, a, b, grid), told apart, with `columns` of COUNTS, FLAGS, MEASURES and `more` (name and type,
    of the sources). With `least`, pairs that cannot be accepted with such a score are left out, most of them before they are scored.

    model: the constants of the links, and the weights and scales of their terms.
    """
    kinds = dict.fromkeys(COUNTS, "bigint") | dict.fromkeys(FLAGS, "boolean") | dict.fromkeys(MEASURES, "double") | more
    wanted = [c for c in columns if c != "video_id"]
    run = _runner(wanted, tuple(more), model, least)
    return pairs.mapInArrow(run, ", ".join(["video_id bigint", *(f"{c} {kinds[c]}" for c in wanted)])).select(*columns)


def _runner(wanted: list[str], more: tuple[str, ...], m: dict, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    weight, scale = m["weights"], m["scales"]
    scored = "score" in wanted or least is not None

    def pairs_of(video: int, a: _Side, b: _Side, balls: _Balls | None, cosines: list) -> Iterator[pa.RecordBatch]:
        last, first = a["src_last"], b["tgt_first"]
        most_early = weight["temporal"] * np.exp(-np.arange(m["most"] + 1) / scale["temporal"]) + weight["persistence"]
        steady = weight["spatial"] + weight["velocity"] + weight["geometry"]

        def need(free: float) -> float:
            return (least - 1e-5) * (1 + free) - free

        free = weight["event"] + weight["appearance"] * (a.looks() and b.looks())
        order = np.argsort(last, kind="stable")
        for low in range(0, a.count, STEP):
            rows = order[low:low + STEP]
            if first.max() - last[rows].min() < m["least_gap"] or first.min() - last[rows].max() > m["most"]:
                continue
            nearest = max(m["least_gap"], int(first.min() - last[rows].max()))
            if least is not None and most_early[nearest] + steady < need(free):
                continue
            gaps = first - last[rows][:, None]
            near = (gaps >= m["least_gap"]) & (gaps <= m["most"]) & (b["tgt"] != a["src"][rows][:, None])
            if least is not None:
                ahead = np.minimum(m["horizon"], gaps)
                x = a["end_x"][rows][:, None] + a["vx"][rows][:, None] * ahead - b["start_x"]
                y = a["end_y"][rows][:, None] + a["vy"][rows][:, None] * ahead - b["start_y"]
                square = x * x + y * y
                n = np.fmin(a["n"][rows][:, None], b["n"])
                early = most_early[np.clip(gaps, 0, m["most"])] - weight["persistence"] * (1 - n / (n + scale["persistence"]))
                spatial = weight["spatial"] * np.exp(np.sqrt(square) / -scale["spatial"])
                near &= ~(square > m["far"] ** 2 * (1 + 1e-9)) & ~(early + spatial + (steady - weight["spatial"]) < need(free))
            i, j = np.nonzero(near)
            if not len(i):
                continue
            found = measured(a, b, rows[i], j, balls, cosines)
            if found is not None:
                yield batch(video, *found)

    def batch(video: int, a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, out: dict, lost: dict) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(i), video, np.int64))]
        for name in wanted:
            if name in more or name == "a_moving":
                columns.append(a.arrow["moving" if name == "a_moving" else name].take(pa.array(i)))
            elif name in ("a_n", "b_n"):
                columns.append((a.arrow if name == "a_n" else b.arrow)["n"].take(pa.array(i if name == "a_n" else j)))
            elif name in ("src", "tgt"):
                columns.append(pa.array(a["src"][i] if name == "src" else b["tgt"][j]))
            else:
                columns.append(pa.array(out[name], mask=lost.get(name)))
        return pa.record_batch(columns, names=["video_id", *wanted])

    def measured(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, balls: _Balls | None, cosines: list):
        def velocity(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            u, v = a["vx"][i] - b["vx"][j], a["vy"][i] - b["vy"][j]
            return np.sqrt(u * u + v * v)

        def shape(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w, h, p, q = a["mean_w"][i], a["mean_h"][i], b["mean_w"][j], b["mean_h"][j]
            return np.abs(w - p) + np.abs(h - q), np.abs(w / (h + EPS) - p / (q + EPS))

        gap = b["tgt_first"][j] - a["src_last"][i]
        ahead = np.minimum(m["horizon"], gap)
        reach_x, reach_y = a["end_x"][i] + a["vx"][i] * ahead, a["end_y"][i] + a["vy"][i] * ahead
        error = np.sqrt((reach_x - b["start_x"][j]) ** 2 + (reach_y - b["start_y"][j]) ** 2)
        lost = {}
        terms = {}
        if scored:
            no_place = _either(a.lacks("end_x", "end_y", "vx", "vy"), b.lacks("start_x", "start_y"), i, j)
            no_speed = _either(a.lacks("vx", "vy"), b.lacks("vx", "vy"), i, j)
            no_size = _either(a.lacks("mean_w", "mean_h"), b.lacks("mean_w", "mean_h"), i, j)
            off, (size, aspect) = velocity(i, j), shape(i, j)
            n = np.fmin(a["n"][i], b["n"][j]).astype(np.float64)
            terms = {"temporal": (np.exp(-gap / scale["temporal"]), None), "spatial": (np.exp(-error / scale["spatial"]), no_place),
                     "velocity": (np.exp(-off / scale["velocity"]), no_speed), "geometry": (np.exp(-(size / scale["geometry"] + aspect)), no_size),
                     "persistence": (np.where(n <= 0, 0.0, n / (n + scale["persistence"])), None)}
            if least is not None:
                top = np.zeros(len(i))
                for name, (value, none) in terms.items():
                    top += weight[name] * (value if none is None else np.where(none, 1.0, value))
                free = weight["event"] + weight["appearance"] * (a.looks() and b.looks())
                keep = np.flatnonzero(~(top < (least - 1e-5) * (1 + free) - free))
                if not len(keep):
                    return None
                if len(keep) < len(i):
                    i, j, gap, reach_x, reach_y, error, off, size, aspect = (v[keep] for v in (i, j, gap, reach_x, reach_y, error, off, size, aspect))
                    terms = {name: (value[keep], none if none is None else none[keep]) for name, (value, none) in terms.items()}
        no_place = _either(a.lacks("end_x", "end_y", "vx", "vy"), b.lacks("start_x", "start_y"), i, j)
        out = {"gap": gap, "error": error}
        if no_place is not None:
            lost |= dict.fromkeys(("error", "diagonals", "widths", "heights", "per_frame"), no_place)
            lost |= {f"mid_{c}": _either(a.lacks(f"end_{c}", f"v{c}"), b.lacks(f"start_{c}"), i, j) for c in "xy"}
        if "velocity_off" in wanted:
            out["velocity_off"] = off if scored else velocity(i, j)
            lost["velocity_off"] = _either(a.lacks("vx", "vy"), b.lacks("vx", "vy"), i, j)
        if "size_off" in wanted or "aspect_off" in wanted:
            out["size_off"], out["aspect_off"] = (size, aspect) if scored else shape(i, j)
            lost |= dict.fromkeys(("size_off", "aspect_off"), _either(a.lacks("mean_w", "mean_h"), b.lacks("mean_w", "mean_h"), i, j))
        if "tolerance" in wanted:
            spread = [np.where(side.nulls["dispersion"], -np.inf, side["dispersion"]) if "dispersion" in side.nulls else side["dispersion"] for side in (a, b)]
            value = m["tolerance"]["base"] + m["tolerance"]["spread"] * np.maximum(spread[0][i], spread[1][j]) + m["tolerance"]["gap"] * gap
            out["tolerance"] = np.fmin(m["tolerance"]["most"], np.where(value == -np.inf, np.inf, value))
        if {"diagonals", "widths", "heights"} & set(wanted):
            def least_of(value: np.ndarray, *names: str) -> np.ndarray:
                none = b.lacks(*names)
                return np.maximum(EPS, value if none is None else np.where(none, EPS, value))

            for name, value in (("diagonals", least_of(np.hypot(b["mean_w"], b["mean_h"]), "mean_w", "mean_h")), ("widths", least_of(b["mean_w"], "mean_w")),
                                ("heights", least_of(b["mean_h"], "mean_h"))):
                if name in wanted:
                    out[name] = error / value[j]
        if "per_frame" in wanted:
            out["per_frame"] = error / np.maximum(m["least_gap"], gap)
        mid_x, mid_y = (reach_x + b["start_x"][j]) / 2, (reach_y + b["start_y"][j]) / 2
        out |= {"mid_x": mid_x, "mid_y": mid_y}
        if scored or "cosine" in wanted:
            if not cosines:
                cosines.append(_cosines(a, b))
            alike, there = (None, None) if cosines[0] is None else (cosines[0][0][i, j], cosines[0][1][i, j])
            out["cosine"] = np.zeros(len(i)) if alike is None else alike
            lost["cosine"] = np.ones(len(i), bool) if there is None else ~there
        if scored or "ball_distance" in wanted:
            away = np.full(len(i), np.nan) if balls is None else balls.distance(mid_x, mid_y)
            out["ball_distance"], lost["ball_distance"] = away, np.isnan(away)
        if scored:
            if alike is not None:
                terms["appearance"] = np.fmax(0.0, np.fmin(1.0, (alike + 1.0) / 2.0)), lost["cosine"]
            if balls is not None:
                terms["event"] = np.exp(-away / scale["event"]), lost["ball_distance"]
            top, bottom = np.zeros(len(i)), np.zeros(len(i))
            for name, (value, none) in terms.items():
                top += value * weight[name] if none is None else np.where(none, 0.0, value * weight[name])
                bottom += weight[name] if none is None else np.where(none, 0.0, weight[name])
            # as `fixed`: what is no number is 0 there
            score = np.nan_to_num(np.floor(top / bottom * 1e6 + 0.5001)) / 1e6
            out["score"] = score
            if least is not None:
                keep = np.flatnonzero((score >= least) & ~(error > m["far"]))
                if not len(keep):
                    return None
                if len(keep) < len(i):
                    i, j = i[keep], j[keep]
                    out, lost = {k: v[keep] for k, v in out.items()}, {k: None if v is None else v[keep] for k, v in lost.items()}
        return a, b, i, j, out, lost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for got in batches:
                videos, sources, targets = (got.column(c) for c in ("video_id", "a", "b"))
                grids = got.column("grid") if "grid" in got.schema.names else None
                known = {}
                for row in range(got.num_rows):
                    video = videos[row].as_py()
                    if video not in known:
                        known[video] = _Balls(grids[row]) if grids is not None and grids[row].is_valid else None
                    yield from pairs_of(video, _Side(sources[row].values), _Side(targets[row].values), known[video], [])

    return run
