"""Pluggable models: functions over Arrow batches, found by name; a model that is not there gives rows that say so."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shipping import ship_package

MapFunction = Callable  # from an iterator of Arrow batches to one
_models: dict[str, tuple[MapFunction, str]] = {}


def register(name: str, function: MapFunction, schema: str) -> None:
    """A model: its function (called once a task, so that it loads once) and the columns that it returns."""
    _models[name] = function, schema


def unregister(name: str) -> None:
    _models.pop(name, None)


def apply_model(df: DataFrame, name: str, key: str) -> DataFrame:
    """The model's rows for df, or (key, status, value) with MODEL_UNAVAILABLE and null: never a made-up value."""
    if name in _models:
        function, schema = _models[name]
        return df.mapInArrow(function, schema)
    return df.select(key, F.lit("MODEL_UNAVAILABLE").alias("status"), F.lit(None).cast("double").alias("value"))


# ---- models that are loaded in the executors' processes, with states and classified failures

# States of a model.
OK, UNAVAILABLE_STATUS, ERROR = "OK", "MODEL_UNAVAILABLE", "ERROR"
READY, UNAVAILABLE, DISABLED, CHECKPOINT_MISSING, LOAD_ERROR = "READY", "MODEL_UNAVAILABLE", "DISABLED", "CHECKPOINT_MISSING", "LOAD_ERROR"
INFERENCE_ERROR = "INFERENCE_ERROR"
_SCORED = "model string, status string, truth string, message string, loads int, value double"


class ModelUnavailable(Exception):
    """What a loader raises where a runtime, a dependency or a setting is missing; `truth` classifies it."""

    def __init__(self, message: str, truth: str = UNAVAILABLE):
        super().__init__(message)
        self.truth = truth


@dataclass(frozen=True)
class Model:
    """A model: how it is loaded (a function that returns one from an Arrow batch to its values), whether it is enabled, and the
    files that it needs on the machine that runs it. Without a loader it is unknown."""

    name: str
    loader: Callable[[], Callable[[pa.RecordBatch], pa.Array]] | None = None
    enabled: bool = True
    requires: tuple[str, ...] = ()


@dataclass
class State:
    """A model in this process: its function, or why there is none, and how often it was loaded."""

    status: str
    truth: str
    message: str
    run: Callable[[pa.RecordBatch], pa.Array] | None = None
    loads: int = 0


_states: dict[str, State] = {}


def load(model: Model) -> State:
    """The model's state in this process; loads it when it is first asked for, and never again, failures included."""
    if model.name not in _states:
        _states[model.name] = _loaded(model)
    return _states[model.name]


def _loaded(model: Model) -> State:
    if model.loader is None:
        return State(UNAVAILABLE_STATUS, UNAVAILABLE, f"No adapter registered for '{model.name}'")
    if not model.enabled:
        return State(UNAVAILABLE_STATUS, DISABLED, "Disabled by configuration")
    if any(not os.path.isfile(path) for path in model.requires):
        return State(UNAVAILABLE_STATUS, CHECKPOINT_MISSING, "Checkpoint missing")
    try:
        run = model.loader()
    except ModelUnavailable as why:
        return State(UNAVAILABLE_STATUS, why.truth, str(why), loads=1)
    except Exception as why:
        return State(ERROR, LOAD_ERROR, f"{type(why).__name__}: {why}", loads=1)
    return State(OK, READY, "Loaded", run, 1) if run is not None else State(UNAVAILABLE_STATUS, UNAVAILABLE, "Loader gave nothing", loads=1)


def score_with(df: DataFrame, models: list[Model], key: str) -> DataFrame:
    """A row for each row of df and each model: key, model, status, truth, message, loads (in that process), value.

    Values come from the models' functions over whole batches of df. A model that is not there, or fails, gives rows that say
    why, with a null value: never a made-up one, and the other models go on.
    """
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model in models:
                state = load(model)
                status, truth, message, values = state.status, state.truth, state.message, pa.nulls(len(batch), pa.float64())
                if state.run is not None:
                    try:
                        values = state.run(batch).cast(pa.float64())
                    except Exception as why:
                        status, truth, message = ERROR, INFERENCE_ERROR, f"{type(why).__name__}: {why}"
                told = [pa.array([value] * len(batch), kind) for value, kind in ((model.name, pa.string()), (status, pa.string()), (truth, pa.string()),
                                                                                (message, pa.string()), (state.loads, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(at), *told, values], [key, *(c.split()[0] for c in _SCORED.split(", "))])

    return df.mapInArrow(run, f"{key} {kind}, {_SCORED}")


def model_states(scored: DataFrame) -> DataFrame:
    """Per model: its worst status with truth and message, how many rows it was asked for and answered, and the most loads of a process."""
    rank = F.when(F.col("status") == OK, 0).when(F.col("status") == UNAVAILABLE_STATUS, 1).otherwise(2)
    worst = F.max_by(F.struct("status", "truth", "message"), F.struct(rank, "truth", "message")).alias("s")
    return scored.groupBy("model").agg(worst, F.count(F.lit(1)).alias("rows"), F.count("value").alias("answered"), F.max("loads").alias("loads")).select(
        "model", "s.status", "s.truth", "s.message", "rows", "answered", "loads")


def observe_failures(scored: DataFrame, models: list[Model]) -> tuple[DataFrame, Observation]:
    """scored with a metric for each model, of how many rows it failed on, that is known when any action on it ends."""
    seen = Observation("models")
    return scored.observe(seen, *(F.count_if((F.col("model") == m.name) & (F.col("status") != OK)).alias(m.name) for m in models)), seen
