"""Multi-object tracking by overlap, and exponential smoothing: both sequential within a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HIGH, LOW, MATCH, LOW_MATCH, MAX_LOST = 0.5, 0.1, 0.3, 0.24, 30


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b."""
    def side(first: int, last: int) -> np.ndarray:
        low = np.maximum(a[:, None, first], b[None, :, first])
        return np.clip(np.subtract(np.minimum(a[:, None, last], b[None, :, last]), low, out=low), 0, None, out=low)

    inter = side(0, 2)
    inter *= side(1, 3)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :]
    union -= inter
    return np.divide(inter, np.maximum(union, 1e-9, out=union), out=inter)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns by shortest augmenting paths with potentials.

    Rows whose cheapest column no row before them wants get it at once; only the others look for a path. On a path potentials
    stay as they are, and are set once at its end.
    """
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(np.ascontiguousarray(cost.T)))
    n, m = cost.shape
    if not n:
        return []
    first = cost.argmin(axis=1)
    u, v = cost[np.arange(n), first], np.zeros(m)
    columns, rows = np.full(n, -1), np.full(m, -1)
    taken, owner = np.unique(first, return_index=True)
    columns[owner], rows[taken] = taken, owner
    reach, better, way = np.empty(m), np.empty(m, bool), np.empty(m, int)
    for start in np.flatnonzero(columns < 0):
        front, open_, i, far = np.full(m, np.inf), v.copy(), int(start), 0.0
        passed, closed, dist = [], [], []
        while True:
            np.subtract(cost[i], open_, out=reach)
            reach += far - u[i]
            np.less(reach, front, out=better)
            np.copyto(front, reach, where=better)
            np.copyto(way, i, where=better)
            j = int(front.argmin())
            far = float(front[j])
            if rows[j] < 0:
                break
            i = int(rows[j])
            passed.append(i)
            closed.append(j)
            dist.append(far)
            front[j], open_[j] = np.inf, -np.inf  # a closed column is never better again
        u[start] += far
        u[passed] += far - np.array(dist)
        v[closed] -= far - np.array(dist)
        while True:
            i = int(way[j])
            rows[j], columns[i], j = i, j, int(columns[i])
            if i == start:
                break
    return [(i, int(j)) for i, j in enumerate(columns)]


def pairs_above(similar: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The assignment of greatest total overlap, without pairs below the threshold.

    Boxes that overlap nothing bring nothing, so each connected group of overlapping boxes is assigned by itself.
    """
    out, met = [], similar > 0
    left = met.any(axis=1)
    while left.any():
        group, seen = np.zeros(len(met), bool), np.zeros(met.shape[1], bool)
        new = np.zeros(len(met), bool)
        new[left.argmax()] = True
        while new.any():
            group |= new
            columns = met[new].any(axis=0) & ~seen
            seen |= columns
            new = met[:, columns].any(axis=1) & ~group
        left &= ~group
        r, c = np.flatnonzero(group), np.flatnonzero(seen)
        out += [(int(r[i]), int(c[j])) for i, j in assign(1 - similar[np.ix_(r, c)]) if similar[r[i], c[j]] >= least]
    return sorted(out)


class Tracker:
    """State of one video: boxes and misses of its tracks. Ids begin at 1."""

    def __init__(self, next_id: int = 1, ids=(), boxes=(), lost=(), hits=()):
        self.next_id, self.ids, self.lost, self.hits = next_id, list(ids), list(lost), list(hits)
        self.boxes = [tuple(b) for b in boxes]

    def update(self, boxes: np.ndarray, confidence: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Takes a frame's detections; returns (track, detection or -1, hits, lost) of every track that lives on."""
        before = len(self.ids)
        from_ = [-1] * before
        free = set(range(before))
        high, low = np.flatnonzero(confidence >= HIGH), np.flatnonzero((confidence >= LOW) & (confidence < HIGH))
        used: set[int] = set()
        for chosen, least in ((high, MATCH), (low, LOW_MATCH)):
            left = sorted(free)
            if left and len(chosen):
                for i, j in pairs_above(overlap(np.array([self.boxes[k] for k in left]), boxes[chosen]), least):
                    from_[left[i]] = int(chosen[j])
                    free.discard(left[i])
                    used.add(int(chosen[j]))
        for k in range(before):
            if from_[k] >= 0:
                self.boxes[k], self.lost[k], self.hits[k] = tuple(boxes[from_[k]]), 0, self.hits[k] + 1
            else:
                self.lost[k] += 1
        for j in high:
            if int(j) not in used:
                self.ids.append(self.next_id)
                self.boxes.append(tuple(boxes[j]))
                self.lost.append(0)
                self.hits.append(1)
                from_.append(int(j))
                self.next_id += 1
        keep = [k for k in range(len(self.ids)) if self.lost[k] <= MAX_LOST]
        self.ids, self.boxes, self.lost, self.hits = ([x[k] for k in keep] for x in (self.ids, self.boxes, self.lost, self.hits))
        return [(self.ids[n], from_[k], self.hits[n], self.lost[n]) for n, k in enumerate(keep)]


TRACKED = "video_id long, frame long, track long, det_id long, hits int, lost int"


def track_boxes(detections: DataFrame, with_lost: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """Tracks over (video_id, frame, det_id, x1, y1, x2, y2, confidence); lost tracks are emitted while they live, if wanted.

    frames: (video_id, frame) that were sampled; in one without detections every track misses. A row without det_id says the same.
    """
    if frames is not None:
        detections = frames.select("video_id", "frame").distinct().join(detections, ["video_id", "frame"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(), []
        for frame, rows in pdf.sort_values(["frame", "det_id"]).groupby("frame"):
            out += [(pdf.video_id.iloc[0], frame, *row) for row in step(tracker, rows) if with_lost or not row[-1]]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")]).astype({"det_id": "Int64"})

    return detections.groupBy("video_id").applyInPandas(one, TRACKED)


def step(tracker: Tracker, rows: pd.DataFrame) -> list[tuple]:
    """Moves a tracker on by a frame's rows: (track, det_id, hits, lost) of the tracks that live on."""
    rows = rows[rows.det_id.notna()]
    ids = rows.det_id.to_numpy()
    found = tracker.update(rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows.confidence.to_numpy(float))
    return [(track, int(ids[det]) if det >= 0 else None, hits, lost) for track, det, hits, lost in found]


def smooth(obs: DataFrame, alpha: float, keys: tuple[str, ...] = ("video_id", "track_id")) -> DataFrame:
    """Exponential moving average of a series' centre. It starts anew with every value of the keys: add a shot's number to
    reset it where a shot begins with a hard cut."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pdf[[*keys, "frame"]].assign(smooth_x=pdf.cx.ewm(alpha=alpha, adjust=False).mean())

    chosen = obs.select(*keys, "frame", "cx")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name in keys)
    return chosen.groupBy(*keys).applyInPandas(one, f"{schema}, frame long, smooth_x double")
