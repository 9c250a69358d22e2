"""Intermediate results that outlive a lost executor."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share: spark.checkpoint.dir, or the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanloom-steps"
    return f"{folder.rstrip('/')}/spanloom-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage_counted(df: DataFrame, name: str = "step", **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut_lineage, with counts over the rows that are made in the same job; of no rows they are 0."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, *(value.alias(key) for key, value in counts.items())), name)
    found = seen.get
    return written, {key: found.get(key) or 0 for key in counts}


def forget(df: DataFrame) -> None:
    """Deletes what cut_lineage wrote for df, which nothing reads again."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shared: dict[tuple, tuple[str, StructType]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the files of a table; of a folder those in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at))) if system.exists(at) else ()


def shared(spark: SparkSession, name: str, tables: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries derive alike from the files of `tables`: written once a session to the shared folder, and
    built again if any of these files changed or what was written is gone."""
    key = (spark.sparkContext.applicationId, name, tuple(_files(spark, path) for path in tables))
    if key not in _shared or not _files(spark, _shared[key][0]):
        df = build()
        path = fresh_path(spark, name)
        df.write.parquet(path)
        _shared[key] = path, df.schema
    path, schema = _shared[key]
    return spark.read.schema(schema).parquet(path)
