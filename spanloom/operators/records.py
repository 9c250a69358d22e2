"""Operational tables: model states, jobs, rules, graphs, prompts, outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a model's truth means for a stage's status.
TRUTH = (("view", "REAL"), ("click", "REAL"), ("purchase", "FALLBACK"), ("signup", "UNVERIFIED"))
STATUS = {"REAL": "PASS", "FALLBACK": "PARTIAL", "UNVERIFIED": "PARTIAL"}


def truth_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUTH), "model string, truth string")


def model_rollup(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Calls, mean latency in milliseconds (0 without calls) and status of each model; unknown truth means unavailable."""
    r = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("total"), F.max("seconds").alias("slowest"))
    r = r.join(F.broadcast(truth), "model", "left")  # a dimension of a few rows
    status = F.lit("MODEL_UNAVAILABLE")
    for name, value in STATUS.items():
        status = F.when(F.col("truth") == name, value).otherwise(status)
    labels = F.array_compact(F.array(F.lit("LOADED"), F.when(F.col("truth") == "REAL", "INFERENCE_REAL"), F.when(F.col("slowest") > 400, "SLOW"),
                                     F.when(F.col("truth").isNull(), "UNVERIFIED")))
    return r.select("model", "calls", F.when(F.col("calls") > 0, F.col("total") / F.col("calls") * 1000).otherwise(F.lit(0.0)).alias("mean_ms"),
                    status.alias("status"), F.array_join(labels, ",").alias("labels"))


def latest_states(log: DataFrame) -> DataFrame:
    """The last entry of each job, how many there are, and progress clamped to 0..100."""
    return log.groupBy("job_id").agg(F.max("step").alias("step"), F.max_by("state", "step").alias("state"), F.count(F.lit(1)).alias("entries")).withColumn(
        "progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("step") * 20)).cast("long"))


def recent_jobs(latest: DataFrame, limit: int) -> DataFrame:
    return latest.orderBy(F.desc("job_id")).limit(max(1, min(100, limit)))


def kept_jobs(latest: DataFrame, most: int) -> DataFrame:
    """The newest `most` jobs: first in, first out. A top-k, so that no task sees all jobs."""
    return latest.orderBy(F.desc("job_id")).limit(most)


def rule_errors(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """The names of the rules that a row breaks, in order, and whether it breaks none. A rule that is null is broken."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return df.select(*key, F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("passed"))


def delivery_rules(width: Column, height: Column, fps: Column, codec: Column, pixels: Column, seconds: Column, least: float = 0.1) -> dict[str, Column]:
    """What a finished video must be (fixed values), for rule_errors."""
    return {"resolution": (width == 1080) & (height == 1920), "fps": F.abs(fps - 30.0) <= 0.1, "codec": codec == "h264", "pix_fmt": pixels == "yuv420p",
            "duration": seconds >= least}


def event_verdict(kind: Column, event: Column, made_kind: Column, made_event: Column) -> Column:
    """Whether what was made shows the event that it should: the same kind and id. UNKNOWN where either side has neither."""
    missing = (kind.isNull() & event.isNull()) | (made_kind.isNull() & made_event.isNull())
    return F.when(missing, "UNKNOWN").when(kind.eqNullSafe(made_kind) & event.eqNullSafe(made_event), "OK").otherwise("QC_REJECTED")


def identity_verdict(similarity: Column, least: float = 0.55) -> Column:
    return F.when(similarity.isNull(), "UNKNOWN").when(similarity >= least, "OK").otherwise("QC_REJECTED")


def dangling_edges(edges: DataFrame, nodes: DataFrame, end: str, node: str) -> DataFrame:
    return edges.join(nodes.select(F.col(node).alias(end)), end, "left_anti")


def node_faults(required: DataFrame, nodes: DataFrame) -> DataFrame:
    """Required nodes (node, kind) that are missing or of another kind."""
    met = required.join(nodes.select("node", F.col("kind").alias("found")), "node", "left")
    return met.where(F.col("found").isNull() | (F.col("found") != F.col("kind"))).select(
        "node", "kind", F.when(F.col("found").isNull(), "MISSING").otherwise("WRONG_KIND").alias("fault"))


def build_prompt(action: Column, base: Column) -> Column:
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    return F.concat_ws(", ", blank(action), blank(base))


def prompts(requests: DataFrame, presets: DataFrame, default: str, base: tuple[str, str]) -> DataFrame:
    """Requests (preset, own_positive, own_negative and any keys) with their positive and negative prompt: the own text if it is
    not blank, else the preset's (the default's, if there is none of that name), before what all prompts share.

    presets: (preset, positive, negative), a catalogue of dozens of rows.
    """
    named = requests.join(F.broadcast(presets.select("preset", F.lit(True).alias("known"))), "preset", "left")
    used = named.withColumn("used", F.when(F.col("known"), F.col("preset")).otherwise(F.lit(default))).drop("known")
    met = used.join(F.broadcast(presets.select(F.col("preset").alias("used"), F.col("positive").alias("p"), F.col("negative").alias("n"))), "used", "left")
    own = lambda c: F.when(F.length(F.trim(c)) > 0, F.col(c))
    return met.select(*requests.columns, "used", build_prompt(F.coalesce(own("own_positive"), F.col("p")), F.lit(base[0])).alias("positive_prompt"),
                      build_prompt(F.coalesce(own("own_negative"), F.col("n")), F.lit(base[1])).alias("negative_prompt"))


def pick_output(outputs: DataFrame) -> DataFrame:
    """Each job's first video, else its first image: (job, output, place, is_video)."""
    return outputs.groupBy("job").agg(F.min_by(F.struct("output", "is_video"), F.struct(~F.col("is_video"), "place")).alias("o")).select("job", "o.*")


def stretched(n: Column, factor: int) -> Column:
    """Frames after factor - 1 are put between each pair."""
    return (n - 1) * factor + 1


def top_n(df: DataFrame, by: list[Column], n: int, partition: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col("place") <= n)


def named_values(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(*keys, values): a map from each name to its value, in order of the names; of several values of one name the greatest."""
    once = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.max(value).alias(value))
    return once.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("values"))


def merged_maps(first: Column, second: Column) -> Column:
    """The entries of both maps; where both have a name, the second's."""
    kept = F.map_filter(first, lambda name, _: ~F.map_contains_key(second, name))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, second))))


def expected_models(expected: DataFrame, available: DataFrame) -> DataFrame:
    """(model, stage, version, state): AVAILABLE, MISSING (expected, not there) or UNEXPECTED (there, not expected)."""
    met = expected.withColumn("wanted", F.lit(True)).join(available.withColumn("there", F.lit(True)), "model", "full")
    state = F.when(F.col("wanted").isNull(), "UNEXPECTED").when(F.col("there").isNull(), "MISSING").otherwise("AVAILABLE")
    return met.select("model", "stage", "version", state.alias("state"))
