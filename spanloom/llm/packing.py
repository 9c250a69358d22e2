"""Best-fit packing by large-item matching.

Documents become pieces of at most ``capacity`` tokens. Piece lengths are whole
numbers from 1 to the capacity, so the packing depends only on how many pieces
there are of each length: a histogram of at most ``capacity`` rows, whatever the
corpus. The plan is made from it on the driver, for groups of equal bins at a
time:

1. lengths above a third of the capacity, longest first, are matched with the
   longest other such length that still fits, so that a bin holds at most two;
2. the smaller lengths, longest first, go where the gap left is smallest
   (best fit), and into new bins where none is large enough.

The plan is a table of segments: "the pieces of this length with ranks from r on
fill n bins from sequence s on, k to a bin, from offset o". Its number of rows
depends on the capacity, not on the corpus. A piece's rank within its length is
its rank within its task plus the counts of the tasks before, so no task ever
holds a whole length class, even if a third of the corpus has one length.

Edge cases: a null or empty text is one piece with the end token; a text with
more than ``capacity`` ids is cut into full pieces, a shorter one first;
repeated rows are packed one by one; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_bounded, materialise, release, ship_package
from .tokens import default_paths, encode_texts

CAPACITY = 2048
END_ID = 0
_SEGMENTS_LIMIT = 512 << 20
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"
_RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Bins:
    """Groups of equal bins by gap: what is filled, and which sequences they are."""

    def __init__(self, capacity: int):
        self.capacity, self.next_id = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.by_gap: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number of bins)
        self.gaps: list[int] = []
        self.rank: dict[int, int] = {}

    def put(self, length: int, first: int, bins: int, each: int, gap: int) -> None:
        """Fills `bins` bins, which have this gap, with `each` pieces of the length each."""
        rank = self.rank.get(length, 0)
        self.segments.append((length, rank, first, each, self.capacity - gap, bins))
        self.rank[length] = rank + bins * each

    def keep(self, first: int, bins: int, gap: int) -> None:
        if bins and gap:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((first, bins))

    def new(self, bins: int) -> int:
        self.next_id += bins
        return self.next_id - bins

    def fill(self, length: int, count: int, first: int, bins: int, gap: int) -> int:
        """Best fit of equal pieces into equal bins: one bin after the other. Returns how many pieces are left."""
        each = gap // length
        full = min(bins, count // each)
        if full:
            self.put(length, first, full, each, gap)
            self.keep(first, full, gap - each * length)
        count -= full * each
        if full < bins and count:
            self.put(length, first + full, 1, count, gap)
            self.keep(first + full, 1, gap - count * length)
            full, count = full + 1, 0
        if full < bins:
            self.keep(first + full, bins - full, gap)
        return count


def plan_packing(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Segments (length, first rank, first sequence, pieces to a bin, offset, bins), sorted, for the histogram of lengths."""
    bins = _Bins(capacity)
    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        room = capacity - length
        k = bisect_left(large, room + 1) - 1
        if k >= 0 and large[k] == length and left[length] < 2:
            k -= 1
        if k < 0:
            n = left.pop(length)
            large.pop()
            first = bins.new(n)
            bins.put(length, first, n, 1, capacity)
            bins.keep(first, n, room)
            continue
        mate = large[k]
        n = left[length] // 2 if mate == length else min(left[length], left[mate])
        first = bins.new(n)
        if mate == length:
            bins.put(length, first, n, 2, capacity)
            left[length] -= 2 * n
        else:
            bins.put(length, first, n, 1, capacity)
            bins.put(mate, first, n, 1, room)
            left[length] -= n
            left[mate] -= n
        bins.keep(first, n, room - mate)
        for used in {length, mate}:
            if not left[used]:
                del left[used]
                large.remove(used)
    for length in sorted(left, reverse=True):
        count = left[length]
        for gap in bins.gaps[bisect_left(bins.gaps, length) :]:
            groups = bins.by_gap.pop(gap)
            bins.gaps.remove(gap)
            while groups and count:
                count = bins.fill(length, count, *groups.pop(), gap)
            for first, n in groups:
                bins.keep(first, n, gap)
            if not count:
                break
        if count:
            n = -(-count // (capacity // length))
            bins.fill(length, count, bins.new(n), n, capacity)
    return np.array(sorted(bins.segments), np.int64).reshape(-1, 6)


def place_ranks(segments: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    at = np.searchsorted((segments[:, 0] << 44) + segments[:, 1], (length << 44) + rank, "right") - 1
    seg = segments[at]
    nth = rank - seg[:, 1]
    return seg[:, 2] + nth // seg[:, 3], seg[:, 4] + nth % seg[:, 3] * length


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
               paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""
    ship_package(docs.sparkSession)
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), paths), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                start, length, piece = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, _TYPES, strict=True)], _NAMES)
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, _PIECES)


_NAMES = [field.split()[0] for field in _PIECES.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32()}[field.split()[1]] for field in _PIECES.split(", ")]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, capacity, id_col, text_col, paths), "pieces")
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments = plan_packing(histogram, capacity)
    plan = broadcast_bounded(spark, segments, segments.nbytes, _SEGMENTS_LIMIT, "the packing plan")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(held, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("before") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = place_ranks(plan.value, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, _RESULT)
