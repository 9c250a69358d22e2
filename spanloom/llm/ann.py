"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with a scale of their own, and the norm of what is
lost is kept. Queries are cut into blocks and candidates into tiles; every tile
meets every query block once (a stated query set against all rows, in blocks).
The product of an int8 block and an int8 tile gives approximate distances, which
the two lost norms bound on either side. Of a tile, only pairs whose lower bound
is not beyond the k-th smallest upper bound seen so far survive. Survivors of all
tiles are bounded once more together, then their original vectors are fetched by
id, distances computed in double precision, and a heap keeps each query's k best.

Tiles are gathered in groups of up to ``GROUP_BYTES``, and every group gets a copy
of the query blocks; both travel as int8. A query set beyond ``QUERY_BYTES`` is cut
too, and only then tiles are copied, once for each part. Besides, the survivors
(a few times k for a query and group) and the vectors (once, for the survivors) are
shuffled.

The result is exact: a pair is dropped only if k others are certainly nearer.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids; rows that repeat an id are candidates
each, but never of a query of that id, and a query id that occurs more than once
asks with its least vector; vectors meet only those of their own dimension; a
query without candidates has no rows; ties go to the smaller id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package

QUERY_BLOCK = 512
TILE = 4096
GROUP_BYTES = QUERY_BYTES = 256 << 20  # of tiles and of query blocks that meet in one task
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dim): doubles, only vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = (F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(fine).withColumn("dim", F.size("vector"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, and the norms of what rounding loses."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny * 256) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def bounds(q: np.ndarray, q_scale: np.ndarray, q_lost: np.ndarray, t: np.ndarray, t_scale: np.ndarray, t_lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the vectors behind int8 rows."""
    product = np.zeros((len(q), len(t)))
    for start in range(0, q.shape[1], 1024):  # sums of 1024 int8 products are exact in float32
        product += q[:, start : start + 1024].astype(np.float32) @ t[:, start : start + 1024].astype(np.float32).T
    q_square = (q.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    t_square = (t.astype(np.float64) ** 2).sum(axis=1) * t_scale**2
    total = q_square[:, None] + t_square[None, :]
    near = np.sqrt(np.maximum(total - 2 * product * q_scale[:, None] * t_scale[None, :], 0))
    slack = q_lost[:, None] + t_lost[None, :] + 1e-7 * np.sqrt(total)  # and for rounding in the lines above
    return near - slack, near + slack


@dataclass(frozen=True)
class Packed:
    """Rows of one dimension as int8, with their ids, scales and lost norms."""

    ids: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    lost: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Packed:
        return cls(ids, *quantise(vectors))

    def cells(self) -> bytes:
        return b"".join(np.ascontiguousarray(part.astype(kind)).tobytes() for part, kind in zip(
            (self.ids, self.scale, self.lost, self.q), ("<i8", "<f8", "<f8", "i1"), strict=True))

    @classmethod
    def from_cells(cls, dim: int, cells: bytes) -> Packed:
        n = len(cells) // (24 + dim)
        ids, scale, lost = (np.frombuffer(cells, kind, n, at * 8 * n) for at, kind in enumerate(("<i8", "<f8", "<f8")))
        return cls(ids, np.frombuffer(cells, "i1", n * dim, 24 * n).reshape(n, dim), scale, lost)


def survivors(queries: Packed, tile: Packed, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, lower, upper bound) of a tile's pairs within the limits; the limits are drawn in to the tile's k-th upper bounds."""
    low, high = bounds(queries.q, queries.scale, queries.lost, tile.q, tile.scale, tile.lost)
    own = queries.ids[:, None] == tile.ids[None, :]
    low[own] = high[own] = np.inf
    if high.shape[1] >= k:
        np.minimum(limits, np.partition(high, k - 1, axis=1)[:, k - 1], out=limits)
    i, j = np.nonzero((low <= limits[:, None]) & ~own)
    return i, tile.ids[j], low[i, j], high[i, j]


def pair_distances(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Distances of vectors that stand beside each other, of as many dimensions in a row; rows of one dimension at once."""
    sizes = np.diff(left.offsets.to_numpy())
    a, b = (column.flatten().to_numpy().astype(np.float64) for column in (left, right))
    first = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes))
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        at, total = first[rows], np.zeros(len(rows))
        for i in range(dim):  # in the order of the components, as any engine sums them
            total += (a[at + i] - b[at + i]) ** 2
        out[rows] = np.sqrt(total)
    return out


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of one dimension within a task: (dim, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim):
            ids, vectors = held.pop(dim)
            cells = Packed.of(np.array(ids, np.int64), np.stack(vectors)).cells()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([cells], pa.binary())], ["dim", "cells"])

        for batch in batches:
            values, offsets = batch.column(1).flatten().to_numpy(), np.cumsum([0, *batch.column(2).to_pylist()])
            for i, (key, dim) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids, vectors = held.setdefault(dim, ([], []))
                ids.append(key)
                vectors.append(values[offsets[i] : offsets[i + 1]])
                if len(ids) == size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.select("id", "vector", "dim").mapInArrow(run, "dim int, cells binary")


_SURVIVED = "query_id long, vec_id long, low double, high double"


def _scan(k: int):
    """For cogrouped applyInArrow: the survivors of a group's tiles for each query block of their dimension."""

    def run(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        dim = tiles.column("dim")[0].as_py() if len(tiles) else 0
        packed = [Packed.from_cells(dim, cells.as_py()) for cells in tiles.column("cells")]
        out = []
        for cells in blocks.column("cells") if packed else ():
            queries = Packed.from_cells(dim, cells.as_py())
            limits = np.full(len(queries.ids), np.inf)
            found = [survivors(queries, tile, limits, k) for tile in packed]
            place, ids, low, high = (np.concatenate(part) for part in zip(*found, strict=True))
            keep = low <= limits[place]
            out.append((queries.ids[place[keep]], ids[keep], low[keep], high[keep]))
        columns = [np.concatenate(part) for part in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query_id", "vec_id", "low", "high"), columns, kinds, strict=True)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of vectors for each row of queries: query_id, rank, vec_id, score."""
    ship_package(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    asked = materialise(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    blocks = materialise(_pack(asked.repartition(max(1, math.ceil(asked.count() / QUERY_BLOCK)), "id"), QUERY_BLOCK), "query-blocks")
    tiles = materialise(_pack(rows, TILE), "tiles")

    def number(cells: DataFrame, limit: int, least: int, name: str) -> DataFrame:
        return cells.groupBy("dim").agg(F.greatest(F.ceil(F.sum(F.length("cells")) / limit), F.lit(least)).cast("int").alias(name))

    sizes = number(tiles, GROUP_BYTES, vectors.sparkSession.sparkContext.defaultParallelism, "groups").join(
        number(blocks, QUERY_BYTES, 1, "parts"), "dim")

    def own(name: str, total: str) -> Column:
        return F.pmod(F.xxhash64("cells"), F.col(total)).cast("int").alias(name)

    def each(name: str, total: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(total) - 1)).alias(name)

    key = ["dim", "group", "part"]
    grouped = tiles.join(sizes, "dim").select("dim", own("group", "groups"), each("part", "parts"), "cells")
    copies = blocks.join(sizes, "dim").select("dim", each("group", "groups"), own("part", "parts"), "cells")
    found = grouped.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_scan(k), _SURVIVED)
    # the k-th smallest upper bound over all groups lets fewer through; then distances from the original vectors
    survived = materialise(found, "survived")
    # Spark keeps k rows of a query in each task before it shuffles them
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("high"))
    limits = survived.select("query_id", F.col("high").alias("limit"), place.alias("place")).where(F.col("place") == k).drop("place")
    alive = survived.join(limits, "query_id", "left").where(F.col("limit").isNull() | (F.col("low") <= F.col("limit"))).select("query_id", "vec_id").distinct()
    pairs = alive.join(rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("other"), "dim"), "vec_id").join(
        asked.select(F.col("id").alias("query_id"), "vector", F.col("dim").alias("query_dim")), "query_id").where("dim = query_dim")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of each query among the pairs of a task, in a heap a query: so copies of a vector, however many, don't
        meet in the task that merges their query."""
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            scores = pair_distances(*(batch.column(c) for c in (2, 3)))
            for query, other, score in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scores.tolist(), strict=True):
                heap, item = heaps.setdefault(query, []), (-score, -other)  # the farthest on top
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(query, -other, -score) for query, heap in heaps.items() for score, other in heap]
        for at in range(0, len(rows), 1 << 16):
            columns = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    exact = pairs.select("query_id", "vec_id", "vector", "other").mapInArrow(measure, "query_id long, vec_id long, score double")

    def merge(table: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip(table.column("score").to_pylist(), table.column("vec_id").to_pylist(), strict=True))
        query = table.column("query_id")[0].as_py()
        return pa.table({
            "query_id": pa.array([query] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([d for d, _ in best], pa.float64())})

    return exact.groupBy("query_id").applyInArrow(merge, RESULT)
