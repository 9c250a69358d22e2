"""What the operators of this subpackage share: tables, durable intermediates, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources import shipping
from ..sources.durable import cut_lineage as materialise
from ..sources.durable import fresh_path

__all__ = ["broadcast_bounded", "fresh_path", "materialise", "release", "ship_package", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_bounded(spark: SparkSession, value, size: int, limit: int, what: str):
    """A broadcast whose size has been checked; beyond the limit it refuses instead of filling the executors."""
    if size > limit:
        raise ValueError(f"{what}: {size} bytes exceed the broadcast limit of {limit}")
    return spark.sparkContext.broadcast(value)


ARROW_ROWS = "1000"  # texts are long: Spark's default of 10000 rows would put hundreds of MB into one batch


def release() -> None:
    """Gives freed memory of a Python worker back to the machine, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver was started from, and keeps the
    batches that they get small unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    shipping.ship_package(spark)
