"""Queries on assignments, whole plans, models and maps of named values."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import matching, validation
from ..operators import records as rec
from ..operators import tracks as tr
from ..sources import tables as src
from ..sources.tables import OBS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return add


@query("q81_box_assignment", f"""WITH RECURSIVE {OBS},
boxes AS (SELECT video_id, frame, det_id AS id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM det),
met AS (SELECT a.video_id, a.frame, a.id AS a, b.id AS b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS bb
  FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND b.frame = a.frame + 1),
pairs AS (SELECT video_id, frame, a, b, inter / (aa + bb - inter + 1e-9::DOUBLE) AS iou FROM met WHERE inter > 0),
lefts AS (SELECT video_id, frame, a, row_number() OVER (PARTITION BY video_id, frame ORDER BY a) AS i FROM (SELECT DISTINCT video_id, frame, a FROM pairs)),
tries AS (
  SELECT DISTINCT video_id, frame, 0::BIGINT AS i, []::BIGINT[] AS xs, []::BIGINT[] AS ys, 0.0::DOUBLE AS total FROM pairs
  UNION ALL
  SELECT t.video_id, t.frame, l.i, CASE WHEN o.b IS NULL THEN xs ELSE list_append(xs, l.a) END, CASE WHEN o.b IS NULL THEN ys ELSE list_append(ys, o.b) END, total + coalesce(o.iou, 0.0)
  FROM tries t JOIN lefts l ON l.video_id = t.video_id AND l.frame = t.frame AND l.i = t.i + 1
  JOIN (SELECT video_id, frame, a, b, iou FROM pairs UNION ALL SELECT video_id, frame, a, NULL, NULL FROM lefts) o ON o.video_id = l.video_id AND o.frame = l.frame AND o.a = l.a
  WHERE o.b IS NULL OR NOT list_contains(ys, o.b)),
best AS (SELECT video_id, frame, arg_max(xs, total) AS xs, arg_max(ys, total) AS ys FROM tries t
  WHERE i = (SELECT max(i) FROM lefts l WHERE l.video_id = t.video_id AND l.frame = t.frame) GROUP BY video_id, frame),
won AS (SELECT video_id, frame, unnest(xs) AS a, unnest(ys) AS b FROM best),
kept AS (SELECT w.video_id, w.frame, w.a, w.b, p.iou FROM won w JOIN pairs p USING (video_id, frame, a, b) WHERE p.iou >= 0.3),
told AS (SELECT video_id, frame, a AS left_id, b AS right_id, iou, 'MATCHED' AS status FROM kept
  UNION ALL SELECT video_id, frame, id, NULL, NULL, 'UNMATCHED_LEFT' FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.video_id = x.video_id AND k.frame = x.frame AND k.a = x.id)
  UNION ALL SELECT video_id, frame - 1, NULL, id, NULL, 'UNMATCHED_RIGHT' FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.video_id = x.video_id AND k.frame = x.frame - 1 AND k.b = x.id))
SELECT video_id, frame, left_id, right_id, floor(iou * 1e6 + 0.5001)::DOUBLE / 1e6 AS overlap, status FROM told""")
def q81(spark, d):
    """The boxes of each frame assigned to those of the next."""
    boxes = tr.with_box(src.detections(spark, d)).select("video_id", "frame", F.col("det_id").alias("id"), "x1", "y1", "x2", "y2")
    found = matching.assign_boxes(boxes, boxes.withColumn("frame", F.col("frame") - 1), 0.3)
    return tr.rounded(found, "overlap").select("video_id", "frame", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "overlap", "status")


@query("q82_plan_validation", """
WITH shots AS (
  SELECT o_custkey AS plan_id, o_orderkey AS shot_id, 30 * (row_number() OVER w - 1) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS a, 30 * row_number() OVER w - 1 AS z,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 / 40.0::DOUBLE END AS factor,
    ['VISIBLE_FROM_SOURCE', 'TEMPORALLY_INFERRED', 'DEPTH_INFERRED', 'UNKNOWN', 'INVENTED', NULL, 'UNKNOWN', 'UNKNOWN'][(o_orderkey % 8 + 1)::INTEGER] AS state
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
checked AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY plan_id ORDER BY a, shot_id) + 1, 0) AS expected FROM shots),
parts AS (
  SELECT plan_id, count(*) AS shots, max(z) + 1 AS ends,
    coalesce(list('timeline_gap:' || shot_id || ':' || a || '!=' || expected ORDER BY a) FILTER (a <> expected), []) AS gaps,
    coalesce(list('speed_out_of_bounds:' || shot_id || ':' || factor ORDER BY a) FILTER (factor < 0.55::DOUBLE - 1e-6::DOUBLE OR factor > 1.15::DOUBLE + 1e-6::DOUBLE), []) AS speeds,
    coalesce(list('evidence_state:' || shot_id || ':' || coalesce(state, 'null') ORDER BY a) FILTER (state IS NULL OR state = 'INVENTED'), []) AS states
  FROM checked GROUP BY plan_id),
plans AS (
  SELECT c_custkey AS plan_id, coalesce(p.shots, 0) AS shots, coalesce(ends, 0) AS ends, 30 * coalesce(p.shots, 0) + CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE 0 END AS total,
    c_custkey % 7 <> 0 AS preserved, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS hero, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS followed,
    coalesce(gaps, []) AS gaps, coalesce(speeds, []) AS speeds, coalesce(states, []) AS states FROM customer LEFT JOIN parts p ON c_custkey = p.plan_id),
told AS (
  SELECT plan_id, shots, ends, gaps || CASE WHEN ends <> total THEN ['timeline_end:' || ends || '!=' || total] ELSE [] END || CASE WHEN preserved THEN [] ELSE ['duration_not_preserved'] END
    || speeds || CASE WHEN hero IS NOT NULL AND (followed IS NULL OR followed <> hero) THEN ['hero_camera_contract'] ELSE [] END || states AS errors FROM plans)
SELECT plan_id, CASE WHEN len(errors) = 0 THEN 'OK' ELSE 'QC_REJECTED' END AS status, array_to_string(errors, ';') AS errors, shots, ends AS expected_frames FROM told""")
def q82(spark, d):
    """Customers as plans whose shots are their orders, with gaps, wrong ends, speeds, contracts and states among them."""
    orders, customer = src.table(spark, d, "orders"), src.table(spark, d, "customer")
    key, place = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    states = F.array(*map(F.lit, ("VISIBLE_FROM_SOURCE", "TEMPORALLY_INFERRED", "DEPTH_INFERRED", "UNKNOWN", "INVENTED", None, "UNKNOWN", "UNKNOWN")))
    shots = orders.select(F.col("o_custkey").alias("plan_id"), key.alias("shot_id"), (30 * (place - 1) + F.when(key % 13 == 0, 1).otherwise(0)).alias("start_frame"),
                          (30 * place - 1).alias("end_frame"), F.when(key % 3 == 0, key % 60 / 40.0).alias("effective_factor"), F.get(states, (key % 8).cast("int")).alias("state"))
    own = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c, nation = F.col("c_custkey"), F.col("c_nationkey")
    plans = customer.join(own, "c_custkey", "left").select(
        c.alias("plan_id"), (30 * F.coalesce("n", F.lit(0)) + F.when(c % 11 == 0, 5).otherwise(0)).alias("total_frames"), (c % 7 != 0).alias("duration_preserved"),
        F.when(c % 5 != 0, nation).alias("hero_track"), F.when(c % 19 == 0, None).when(c % 17 == 0, nation + 1).otherwise(nation).alias("followed_track"))
    found = validation.validate_plans(shots, plans, extra=(validation.member_rule(5, "state", validation.EVIDENCE_STATES, "shot_id", "evidence_state"),))
    return found.withColumn("errors", F.array_join("errors", ";"))


def _peak():
    """The largest component of a vector, by its amount."""
    def run(batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(1)
        held = pc.list_parent_indices(column)
        found = pa.table({"row": held, "v": pc.abs(pc.list_flatten(column))}).group_by("row").aggregate([("v", "max")])
        out = [None] * len(column)
        for row, value in zip(found.column("row").to_pylist(), found.column("v_max").to_pylist(), strict=True):
            out[row] = value
        return pa.array(out, pa.float64())

    return run


def _broken():
    raise ValueError("weights do not fit")


def _without_runtime():
    raise registry.ModelUnavailable("no runtime", "DEPENDENCY_MISSING")


MODELS = [registry.Model("depth", _peak, requires=("/nonexistent/depth.pt",)), registry.Model("flow", _broken), registry.Model("peak", _peak),
          registry.Model("pose", _without_runtime), registry.Model("reid", _peak, enabled=False), registry.Model("segment")]


@query("q83_model_states", """
WITH counted AS (SELECT count(*) AS rows_, count(*) FILTER (len(embedding) > 0) AS answered, max(list_max(list_transform(embedding, lambda x: abs(x)))) AS top FROM embeddings),
states(model, status, truth, message, loads) AS (VALUES ('depth', 'MODEL_UNAVAILABLE', 'CHECKPOINT_MISSING', 'Checkpoint missing', 0), ('flow', 'ERROR', 'LOAD_ERROR', 'ValueError: weights do not fit', 1),
  ('peak', 'OK', 'READY', 'Loaded', 1), ('pose', 'MODEL_UNAVAILABLE', 'DEPENDENCY_MISSING', 'no runtime', 1), ('reid', 'MODEL_UNAVAILABLE', 'DISABLED', 'Disabled by configuration', 0),
  ('segment', 'MODEL_UNAVAILABLE', 'MODEL_UNAVAILABLE', 'No adapter registered for ''segment''', 0))
SELECT model, status, truth, message, rows_ AS rows, CASE WHEN model = 'peak' THEN answered ELSE 0 END AS answered, loads, CASE WHEN model = 'peak' THEN top END::DOUBLE AS top FROM states, counted""")
def q83(spark, d):
    vectors = src.table(spark, d, "embeddings").select("vec_id", "embedding")
    scored = registry.score_with(vectors, MODELS, "vec_id")
    top = scored.groupBy("model").agg(F.max("value").alias("top"))
    return registry.model_states(scored).join(top, "model")


@query("q84_named_values", f"""WITH {OBS},
own AS (SELECT video_id, class_name, count(*) AS n FROM det GROUP BY video_id, class_name),
everywhere AS (SELECT class_name FROM own GROUP BY class_name),
whole AS (SELECT v.video_id, e.class_name, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT video_id FROM own) v CROSS JOIN everywhere e LEFT JOIN own o USING (video_id, class_name))
SELECT video_id, string_agg(class_name || '=' || n, ',' ORDER BY class_name) AS summary, max(n) FILTER (class_name = '{src.BALL}') AS balls FROM whole GROUP BY video_id""")
def q84(spark, d):
    """How many detections of each class a video has, 0 for the classes that only others have."""
    counts = src.detections(spark, d).groupBy("video_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    own = rec.named_values(counts, ["video_id"], "class_name", "n")
    zeros = rec.named_values(counts.select("class_name", F.lit(0).cast("long").alias("n")), [], "class_name", "n").withColumnRenamed("values", "zeros")
    whole = own.crossJoin(F.broadcast(zeros)).select("video_id", rec.merged_maps(F.col("zeros"), F.col("values")).alias("values"))  # one row of classes
    told = F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return whole.select("video_id", told.alias("summary"), F.try_element_at("values", F.lit(src.BALL)).alias("balls"))


@query("q86_confidence_bands", f"""WITH {OBS}
SELECT video_id, CASE WHEN confidence >= 0.5 THEN 'HIGH' WHEN confidence >= 0.1 THEN 'LOW' ELSE 'BELOW' END AS band, count(*) AS n, count(DISTINCT track_id) AS tracks FROM det GROUP BY ALL""")
def q86(spark, d):
    banded = src.detections(spark, d).withColumn("band", tr.confidence_band(F.col("confidence")))
    return banded.groupBy("video_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("tracks"))


@query("q87_expected_models", """
WITH expected AS (SELECT DISTINCT p_brand AS model, p_type AS stage FROM part WHERE p_partkey % 3 <> 0), available AS (SELECT p_brand AS model, max(p_retailprice) AS version FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand)
SELECT coalesce(e.model, a.model) AS model, e.stage, a.version, CASE WHEN e.model IS NULL THEN 'UNEXPECTED' WHEN a.model IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS state
FROM expected e FULL JOIN available a ON e.model = a.model""")
def q87(spark, d):
    part = src.table(spark, d, "part")
    expected = part.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("model"), F.col("p_type").alias("stage")).distinct()
    available = part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("model")).agg(F.max("p_retailprice").alias("version"))
    return rec.expected_models(expected, available)
