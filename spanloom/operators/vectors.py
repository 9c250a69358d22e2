"""Embeddings: sampling budgets, centroids, nearest identity, online clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS
from ..sources.durable import cut_lineage, cut_lineage_counted


def embedding_budget(obs: DataFrame, tracks: int = 80, total: int = 320) -> DataFrame:
    """The first, middle and last observation of a video's longest tracks, and no more than `total` a video."""
    sizes = obs.groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), "track_id"))).where(F.col("rank") <= tracks)
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    rows = obs.join(ranked, ["video_id", "track_id"]).withColumn("place", F.row_number().over(order) - 1)
    picked = rows.where(F.col("place").isin(0) | (F.col("place") == F.floor(F.col("n") / 2)) | (F.col("place") == F.col("n") - 1))
    cap = Window.partitionBy("video_id").orderBy("rank", "place")
    return picked.withColumn("taken", F.row_number().over(cap)).where(F.col("taken") <= total).select("video_id", "track_id", "frame", "place", "rank")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Each key's mean vector, scaled to norm 1 (null if its norm is next to 0). Means are aggregates by component."""
    parts = vectors.select(key, F.posexplode("vector").alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda t, x: t + x * x))
    return mean.withColumn("norm", norm).select(key, F.when(F.col("norm") > EPS, F.transform("mean", lambda x: x / F.col("norm"))).alias("centroid"))


BLOCK_BYTES = 32 << 20  # of a broadcast matrix


def nearest_identity(vectors: DataFrame, identities: DataFrame, key: str, least: float = 0.6, block: int = 4096) -> DataFrame:
    """Each vector's most similar identity (of equal ones the lowest key), or null below the threshold.

    Identities are written once, numbered in blocks of at most `block` unit vectors and BLOCK_BYTES, and each block is broadcast
    as a matrix. The vectors pass over a block as matrix products of whole batches, and a vector's best of all blocks is an
    aggregate. No pair is a row.
    """
    spark = vectors.sparkSession
    known = identities.where(F.col("centroid").isNotNull()).select(F.col(key).cast("long").alias("key"), "centroid")
    known, size = cut_lineage_counted(known, "centroids", n=F.count(F.lit(1)), dim=F.max(F.size("centroid")))
    blocks = max(1, -(-size["n"] // min(block, max(1, BLOCK_BYTES // (8 * max(1, size["dim"]))))))
    held = cut_lineage(known.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).repartition(blocks, "block"), "centroid-blocks")
    out = None
    for number in range(blocks if size["n"] else 0):
        rows = held.where(F.col("block") == number).select("key", "centroid").orderBy("key").collect()
        matrix = np.array([r["centroid"] for r in rows])
        if not len(rows):
            continue
        if matrix.nbytes > 2 * BLOCK_BYTES:
            raise ValueError(f"a block of identities has {matrix.nbytes} bytes")
        sent = spark.sparkContext.broadcast((np.array([r["key"] for r in rows], np.int64), matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, matrix = sent.value
            for batch in batches:
                rows = batch.column(1).to_pylist()
                fine = np.array([v is not None and len(v) == matrix.shape[1] and None not in v for v in rows], bool)
                x = np.array([v if good else np.zeros(matrix.shape[1]) for v, good in zip(rows, fine, strict=True)], float).reshape(len(rows), matrix.shape[1])
                norm = np.linalg.norm(x, axis=1)
                fine &= norm > EPS
                near = (x / np.where(fine, norm, 1.0)[:, None]) @ matrix.T
                best = near.argmax(axis=1)
                found, similar = pa.array(keys[best], pa.int64(), mask=~fine), pa.array(near.max(axis=1), pa.float64(), mask=~fine)
                yield pa.RecordBatch.from_arrays([batch.column(0), found, similar], ["vec_id", "found", "similarity"])

        part = vectors.select(F.col("vec_id").cast("long"), "vector").mapInArrow(run, "vec_id long, found long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.select(F.col("vec_id").cast("long"), F.lit(None).cast("long").alias("found"), F.lit(None).cast("double").alias("similarity"))
    best = out.groupBy("vec_id").agg(F.max_by(F.struct("found", "similarity"), F.struct("similarity", -F.col("found"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.similarity") >= least, F.col("b.found")).alias("identity"), F.col("b.similarity").alias("similarity"))


def cluster_in_order(vectors: np.ndarray, least: float = 0.6) -> list[int]:
    """Identity of each vector, in order: the most similar one so far takes it and becomes it, or it starts a new one."""
    known, many = np.empty((16, vectors.shape[1])), 0
    out = []
    for v in vectors:
        v = v / max(np.linalg.norm(v), EPS)
        near = known[:many] @ v
        if many and near.max() >= least:
            out.append(int(near.argmax()))
        else:
            if many == len(known):
                known = np.concatenate([known, np.empty_like(known)])
            out.append(many)
            many += 1
        known[out[-1]] = v
    return out


def online_clusters(vectors: DataFrame, group: str, least: float = 0.6) -> DataFrame:
    """Sequential by nature: each group (a video) is clustered in the order of its ids."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"vec_id": pdf.vec_id, "grp": pdf[group], "identity": cluster_in_order(np.stack(pdf.vector.to_list()).astype(float), least)})

    return vectors.select("vec_id", group, "vector").groupBy(group).applyInPandas(one, "vec_id long, grp long, identity int")
