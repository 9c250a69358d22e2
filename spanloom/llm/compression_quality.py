"""Quality classification by compression.

Two zstandard dictionaries are built, one from windows of good and one from
windows of bad labelled text. A text is cut into windows of about 512 bytes, all
of which are compressed with either dictionary; the difference of the compressed
sizes (bad less good) a byte, over the whole text and in its worst window, is
turned into a score by a logistic calibration. Short texts say little, so either
difference is first drawn towards that of a typical good text, as if ``PRIOR``
more bytes of such text had been seen; the rarer class weighs more in the
calibration (by the root of how much rarer it is).

What is learned is bounded by parameters: at most ``SAMPLE`` labelled documents
of each class and fold (those of least hash), ``WINDOWS`` windows for a
dictionary, ``DICTIONARY`` bytes of dictionary. Dictionaries and calibration use
different documents, and neither uses the held-out fifth (crc32 of the id as
text, modulo 5, equal 0). Labels, language, source and id are no inputs of a
score.

Edge cases: null and empty texts have no windows and get the score of a typical
good text, as nothing speaks against them; labels that are null, are neither
0 nor 1, or contradict each other for an id are not learned from; if either
class has no labelled text every score is 0.5; a null id counts as the empty
string for the fold; repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, materialise, release, ship_package

WINDOW = 512
SAMPLE = 3000
WINDOWS = 6000
DICTIONARY = 64 << 10
LEVEL = 3
PRIOR = 64
THRESHOLD = 0.3
FOLDS = 5
_MODEL_LIMIT = 4 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def windows(text: str | None) -> list[bytes]:
    """The text's bytes in windows of equal size, about WINDOW each."""
    data = (text or "").encode()
    if not data:
        return []
    step = -(-len(data) // max(1, round(len(data) / WINDOW)))
    return [data[i : i + step] for i in range(0, len(data), step)]


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; no dictionaries: nothing could be learned."""

    bad: bytes = b""
    good: bytes = b""
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    typical: tuple[float, float] = (0.0, 0.0)


@functools.lru_cache(maxsize=4)
def _compressors(bad: bytes, good: bytes):
    out = []
    for data in (bad, good):
        held = zstandard.ZstdCompressionDict(data)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(
            dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def features(text: str | None, bad: bytes, good: bytes) -> tuple[float, float, int]:
    """Compressed-size difference a byte, over the text and in its worst window; the text's bytes."""
    pieces = windows(text)
    if not pieces:
        return 0.0, 0.0, 0
    with_bad, with_good = _compressors(bad, good)
    each = [(len(with_bad(piece)) - len(with_good(piece)), len(piece)) for piece in pieces]
    size = sum(n for _, n in each)
    return sum(d for d, _ in each) / size, min(d / n for d, n in each), size


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train from."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def shrink(found: np.ndarray, typical: tuple[float, float]) -> np.ndarray:
    """Rows of features() as inputs of the calibration."""
    size = found[:, 2:]
    return (found[:, :2] * size + np.array(typical) * PRIOR) / (size + PRIOR)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-4) -> tuple[float, ...]:
    """Weights (constant first) of a lightly regularised logistic regression, by Newton's method on scaled inputs."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    share = max(1, (y == 1).sum()) / len(y), max(1, (y == 0).sum()) / len(y)
    weight = np.where(y == 1, (2 * share[0]) ** -0.5, (2 * share[1]) ** -0.5)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / scale))


def score(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -30, 30)))


def _labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Texts of a bounded sample of labelled documents: (label, calibrate, text)."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
             .groupBy(F.col(id_col).cast("long").alias("id"))
             .agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
             .where("label = most").select("id", "label", (fold(F.col("id")) > 2).alias("calibrate")))
    parts = [known.where((F.col("label") == label) & (F.col("calibrate") == part))
             .orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for label in (0, 1) for part in (False, True)]
    chosen = functools.reduce(DataFrame.unionByName, parts)  # at most 4 x SAMPLE rows of 13 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(texts.join(F.broadcast(chosen), "id").select("label", "calibrate", "text"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns the dictionaries and the calibration."""
    ship_package(docs.sparkSession)
    sample = _labelled_sample(docs, labels, id_col, text_col, label_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                if pieces := windows(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["piece"])

    dictionaries = []
    for label in (0, 1):
        pieces = sample.where(f"NOT calibrate AND label = {label}").select("text").mapInArrow(cut, "piece binary")
        held = [bytes(r.piece) for r in pieces.distinct().orderBy(F.xxhash64("piece"), "piece").limit(WINDOWS).collect()]
        if not held:
            return Model()
        dictionaries.append(build_dictionary(held))
    bad, good = dictionaries

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py(), bad, good) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], ["label", "mean", "worst", "size"])

    rows = sample.where("calibrate").select(F.col("label").cast("int"), "text").mapInArrow(
        measure, "label int, mean double, worst double, size double").collect()  # at most 2 x SAMPLE documents
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        return Model()
    found = np.array([(r["mean"], r["worst"], r["size"]) for r in rows])
    order = np.lexsort((*found.T, y))  # the sums below don't depend on the order in which rows came
    found, y = found[order], y[order]
    typical = tuple(np.median(found[y == 1, :2], axis=0).tolist())
    return Model(bad, good, fit_logistic(shrink(found, typical), y), typical)


def scorer(model: Model):
    """A function from texts to scores, for executors."""

    def run(texts: list[str | None]) -> np.ndarray:
        if not model.good:
            return np.full(len(texts), 0.5)
        found = np.array([features(text, model.bad, model.good) for text in texts], float).reshape(-1, 3)
        return score(shrink(found, model.typical), model.weights)

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)
    held = broadcast_bounded(docs.sparkSession, model, len(model.bad) + len(model.good), _MODEL_LIMIT, "the dictionaries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(held.value)
        for batch in batches:
            found = scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"),
                         F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are classified as good."""
    ship_package(docs.sparkSession)
    held = broadcast_bounded(docs.sparkSession, model, len(model.bad) + len(model.good), _MODEL_LIMIT, "the dictionaries")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist()) >= THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)
