"""Queries on embeddings, operational tables, tracking and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import file_name, fixed
from ..operators import records as rec
from ..operators import tracking
from ..operators import tracks as tr
from ..operators import vectors as vec
from ..sources import tables as src
from ..sources.tables import FRAG_ROWS, OBS, r6
from ..streaming import replay

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


@query("q41_embedding_budget", f"""WITH {OBS},
sizes AS (SELECT video_id, track_id, count(*) AS n FROM obs GROUP BY video_id, track_id),
ranked AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY n DESC, track_id))::INTEGER AS rank FROM sizes) WHERE rank <= 80),
placed AS (SELECT o.video_id, o.track_id, o.frame, r.n, r.rank, (row_number() OVER (PARTITION BY o.video_id, o.track_id ORDER BY o.frame))::INTEGER - 1 AS place
  FROM obs o JOIN ranked r USING (video_id, track_id))
SELECT video_id, track_id, frame, place, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank, place) AS taken FROM placed WHERE place IN (0, n // 2, n - 1)) WHERE taken <= 320""")
def q41(spark, d):
    return vec.embedding_budget(src.observations(spark, d))


def embeddings_of(spark, d):
    return src.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))


CENTROIDS = """
parts AS (SELECT label::BIGINT AS label, unnest(range(1, len(embedding) + 1)) AS at_, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, at_, avg(x) AS x FROM parts GROUP BY label, at_),
cents AS (SELECT label, list(x ORDER BY at_) AS c, sqrt(sum(x * x)) AS norm FROM means GROUP BY label),
sims AS (SELECT e.vec_id, e.label::BIGINT AS own, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS similarity FROM embeddings e CROSS JOIN cents c)"""


@query("q42_cosine_to_centroid", f"WITH {CENTROIDS} SELECT vec_id, label, {r6('similarity')} AS similarity FROM sims WHERE own = label")
def q42(spark, d):
    from ..functions.expr import cosine

    vectors = embeddings_of(spark, d)
    return vectors.join(vec.centroids(vectors, "label"), "label").select("vec_id", "label", fixed(cosine(F.col("vector"), F.col("centroid"))).alias("similarity"))


@query("q43_nearest_identity", f"""WITH {CENTROIDS}
SELECT vec_id, CASE WHEN similarity >= 0.6 THEN label END AS identity, {r6('similarity')} AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS rn FROM sims) WHERE rn = 1""")
def q43(spark, d):
    vectors = embeddings_of(spark, d)
    found = vec.nearest_identity(vectors.select("vec_id", "vector"), vec.centroids(vectors, "label"), "label")
    return found.select("vec_id", "identity", fixed(F.col("similarity")).alias("similarity"))


@query("q43b_online_clustering", None)
def q43b(spark, d):
    return vec.online_clusters(embeddings_of(spark, d).withColumn("video", F.pmod("vec_id", F.lit(10))), "video")


@query("q44_model_status_rollup", f"""
WITH truth(model, truth) AS (VALUES ('view', 'REAL'), ('click', 'REAL'), ('purchase', 'FALLBACK'), ('signup', 'UNVERIFIED')),
r AS (SELECT event_type AS model, count(*) AS calls, sum(value) AS total, max(value) AS slowest FROM events GROUP BY event_type)
SELECT r.model, calls, {r6('total / calls * 1000', 2)} AS mean_ms,
  CASE truth WHEN 'REAL' THEN 'PASS' WHEN 'FALLBACK' THEN 'PARTIAL' WHEN 'UNVERIFIED' THEN 'PARTIAL' ELSE 'MODEL_UNAVAILABLE' END AS status,
  concat_ws(',', 'LOADED', CASE WHEN truth = 'REAL' THEN 'INFERENCE_REAL' END, CASE WHEN slowest > 400 THEN 'SLOW' END, CASE WHEN truth IS NULL THEN 'UNVERIFIED' END) AS labels
FROM r LEFT JOIN truth USING (model)""")
def q44(spark, d):
    calls = src.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"))
    return tr.rounded(rec.model_rollup(calls, rec.truth_table(spark)), "mean_ms", places=2)


@query("q45_ema_smooth", f"""WITH RECURSIVE {OBS},
n AS (SELECT video_id, track_id, frame, cx, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS i FROM obs),
ema AS (SELECT video_id, track_id, frame, i, cx AS y FROM n WHERE i = 1
  UNION ALL SELECT n.video_id, n.track_id, n.frame, n.i, 0.25::DOUBLE * n.cx + 0.75::DOUBLE * e.y FROM ema e JOIN n ON n.video_id = e.video_id AND n.track_id = e.track_id AND n.i = e.i + 1)
SELECT video_id, track_id, frame, {r6('y')} AS smooth_x FROM ema""")
def q45(spark, d):
    return tr.rounded(tracking.smooth(src.observations(spark, d), 0.25), "smooth_x")


def job_log(spark, d):
    return src.table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("step"), F.col("role").alias("state"))


JOBS = """jobs AS (SELECT conv_id AS job_id, max(turn) AS step, arg_max(role, turn) AS state, count(*) AS entries,
  greatest(0, least(100, max(turn) * 20))::BIGINT AS progress FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id)"""


@query("q47_job_latest", f"WITH {JOBS} SELECT * FROM jobs")
def q47(spark, d):
    return rec.latest_states(job_log(spark, d).distinct())


@query("q47b_recent_jobs", f"WITH {JOBS} SELECT * FROM jobs ORDER BY job_id DESC LIMIT 20")
def q47b(spark, d):
    return rec.recent_jobs(rec.latest_states(job_log(spark, d).distinct()), 20)


@query("q47c_fifo_eviction", f"WITH {JOBS} SELECT job_id FROM jobs ORDER BY job_id DESC LIMIT 500")
def q47c(spark, d):
    return rec.kept_jobs(rec.latest_states(job_log(spark, d).distinct()), 500).select("job_id")


@query("q48_filename_sanitise", r"""
WITH cleaned AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM pages)
SELECT page_id, CASE WHEN length(n) > 0 THEN n ELSE 'upload' END AS file_name FROM cleaned""")
def q48(spark, d):
    return src.table(spark, d, "pages").select("page_id", file_name(F.col("url")).alias("file_name"))


@query("q49_qc_rules", """
SELECT o_orderkey, errors, errors = '' AS passed FROM (
  SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_totalprice >= 1000, false) THEN 'LOW_PRICE' END,
    CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'BAD_STATUS' END,
    CASE WHEN NOT coalesce(o_orderdate < TIMESTAMP '1998-01-01', false) THEN 'LATE' END) AS errors FROM orders)""")
def q49(spark, d):
    rules = {"LOW_PRICE": F.col("o_totalprice") >= 1000, "BAD_STATUS": F.col("o_orderstatus").isin("O", "F"),
             "LATE": F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")}
    return rec.rule_errors(src.table(spark, d, "orders"), rules, ["o_orderkey"])


@query("q49b_delivery_rules", """
SELECT p_partkey, errors, errors = '' AS passed FROM (SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'resolution' END, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'fps' END,
  CASE WHEN NOT coalesce(starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2'), false) THEN 'codec' END, CASE WHEN NOT coalesce(starts_with(p_type, 'ECONOMY'), false) THEN 'pix_fmt' END,
  CASE WHEN NOT coalesce(p_retailprice / 10000.0::DOUBLE >= 0.1::DOUBLE, false) THEN 'duration' END) AS errors FROM part)""")
def q49b(spark, d):
    codec = F.when(F.col("p_brand").startswith("Brand#1") | F.col("p_brand").startswith("Brand#2"), "h264").otherwise("hevc")
    rules = rec.delivery_rules(F.when(F.col("p_size") > 40, 720).otherwise(1080), F.lit(1920), 29.85 + F.pmod("p_partkey", F.lit(4)) * 0.1, codec,
                               F.when(F.col("p_type").startswith("ECONOMY"), "yuv420p").otherwise("rgb24"), F.col("p_retailprice") / 10000.0)
    return rec.rule_errors(src.table(spark, d, "part"), rules, ["p_partkey"])


@query("q49c_event_lock", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'UNKNOWN' WHEN event_id % 3 = 0 OR event_type = 'view' THEN 'OK' ELSE 'QC_REJECTED' END AS verdict FROM events""")
def q49c(spark, d):
    made = F.pmod("event_id", F.lit(3))
    kind = F.when(made == 0, F.col("event_type")).when(made == 1, "view")
    return src.table(spark, d, "events").select("event_id", rec.event_verdict(
        F.col("event_type"), F.col("event_id"), kind, F.when(made < 2, F.col("event_id"))).alias("verdict"))


@query("q49d_identity_lock", f"""WITH {CENTROIDS}
SELECT vec_id, CASE WHEN similarity IS NULL THEN 'UNKNOWN' WHEN similarity >= 0.55 THEN 'OK' ELSE 'QC_REJECTED' END AS verdict FROM sims WHERE own = label""")
def q49d(spark, d):
    from ..functions.expr import cosine

    vectors = embeddings_of(spark, d)
    met = vectors.join(vec.centroids(vectors, "label"), "label")
    return met.select("vec_id", rec.identity_verdict(cosine(F.col("vector"), F.col("centroid"))).alias("verdict"))


@query("q50_dangling_edges", """
SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')""")
def q50(spark, d):
    nodes = src.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return rec.dangling_edges(src.table(spark, d, "orders").select("o_custkey", "o_orderkey"), nodes, "o_custkey", "c_custkey")


@query("q50b_required_nodes", """
WITH need AS (SELECT n_name AS node, n_regionkey AS kind FROM nation WHERE n_regionkey < 3), have AS (SELECT n_name AS node, (n_nationkey % 5)::INTEGER AS found FROM nation WHERE n_nationkey > 4)
SELECT node, kind, CASE WHEN found IS NULL THEN 'MISSING' ELSE 'WRONG_KIND' END AS fault FROM need LEFT JOIN have USING (node) WHERE found IS NULL OR found <> kind""")
def q50b(spark, d):
    nation = src.table(spark, d, "nation")
    need = nation.where("n_regionkey < 3").select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("kind"))
    have = nation.where("n_nationkey > 4").select(F.col("n_name").alias("node"), F.pmod("n_nationkey", F.lit(5)).alias("kind"))
    return rec.node_faults(need, have)


@query("q51_prompt_build", """
SELECT p_partkey, concat_ws(', ', CASE WHEN length(trim(p_name)) > 0 THEN trim(p_name) END, CASE WHEN length(trim(p_type)) > 0 THEN trim(p_type) END) AS prompt FROM part""")
def q51(spark, d):
    return src.table(spark, d, "part").select("p_partkey", rec.build_prompt(F.col("p_name"), F.col("p_type")).alias("prompt"))


PRESETS = (("zoom", "slow zoom on the player", ""), ("pan", "pan along the line", "crowd"))


@query("q51b_preset_prompts", """
WITH presets(preset, p, n) AS (VALUES ('zoom', 'slow zoom on the player', ''), ('pan', 'pan along the line', 'crowd')),
asked AS (SELECT p_partkey, ['zoom', 'pan', NULL, 'other'][(p_partkey % 4 + 1)::INTEGER] AS preset, CASE WHEN p_size > 40 THEN p_name WHEN p_size < 5 THEN ' ' END AS own_positive,
  CASE WHEN p_size % 2 = 1 THEN p_type END AS own_negative FROM part),
named AS (SELECT *, CASE WHEN preset IN ('zoom', 'pan') THEN preset ELSE 'zoom' END AS used FROM asked)
SELECT p_partkey, used, concat_ws(', ', CASE WHEN trim(own_positive) <> '' THEN trim(own_positive) ELSE p END, 'natural light') AS positive_prompt,
  CASE WHEN trim(own_negative) <> '' THEN trim(own_negative) || ', text, watermark' WHEN n <> '' THEN n || ', text, watermark' ELSE 'text, watermark' END AS negative_prompt
FROM named JOIN presets ON presets.preset = named.used""")
def q51b(spark, d):
    preset = F.get(F.array(F.lit("zoom"), F.lit("pan"), F.lit(None), F.lit("other")), F.pmod("p_partkey", F.lit(4)).cast("int"))
    asked = src.table(spark, d, "part").select("p_partkey", preset.alias("preset"), F.when(F.col("p_size") > 40, F.col("p_name")).when(F.col("p_size") < 5, " ").alias("own_positive"),
                                               F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("own_negative"))
    presets = spark.createDataFrame(list(PRESETS), "preset string, positive string, negative string")
    return rec.prompts(asked, presets, "zoom", ("natural light", "text, watermark")).select("p_partkey", "used", "positive_prompt", "negative_prompt")


@query("q53_output_pick", """
WITH outs AS (SELECT page_id % 25 AS job, page_id AS place, url AS output, ends_with(url, '.html') AS is_video FROM pages)
SELECT job, output, is_video FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY is_video DESC, place) AS rn FROM outs) WHERE rn = 1""")
def q53(spark, d):
    outs = src.table(spark, d, "pages").select(F.pmod("page_id", F.lit(25)).alias("job"), F.col("page_id").alias("place"), F.col("url").alias("output"),
                                               F.col("url").endswith(".html").alias("is_video"))
    return rec.pick_output(outs)


@query("q54_interpolation_schedule", f"WITH {FRAG_ROWS} SELECT video_id, fragment_id, count(*) AS frames, (count(*) - 1) * 3 + 1 AS stretched FROM frows GROUP BY video_id, fragment_id")
def q54(spark, d):
    rows = src.fragment_rows(src.observations(spark, d)).groupBy("video_id", "fragment_id").agg(F.count(F.lit(1)).alias("frames"))
    return rows.withColumn("stretched", rec.stretched(F.col("frames"), 3))


def boxes_of(spark, d):
    """All detections of a frame as boxes, hour by hour."""
    return tr.with_box(src.detections(spark, d)).select("video_id", "frame", "det_id", "x1", "y1", "x2", "y2", "confidence")


@query("q52_iou_tracker", None)
def q52(spark, d):
    return tracking.track_boxes(boxes_of(spark, d), with_lost=False, frames=src.frame_spine(spark, d))


@query("q55_stream_tumbling", f"""
SELECT (date_trunc('day', ts) - TIMESTAMP '2024-01-01')::VARCHAR IS NOT NULL AS ok, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, event_type, count(*) AS n, {r6('sum(value)', 2)} AS total
FROM events GROUP BY ALL""".replace("(date_trunc('day', ts) - TIMESTAMP '2024-01-01')::VARCHAR IS NOT NULL AS ok, ", ""))
def q55(spark, d):
    out = replay.drain(replay.tumbling(replay.event_stream(spark, d), "1 day"), "tumbling")
    return out.select((F.unix_micros("window.start") / 86400000000).cast("long").alias("day"), "event_type", "n", fixed(F.col("total"), 2).alias("total"))


@query("q56_stream_sessions", """
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS starts FROM events),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM numbered GROUP BY user_id, s""")
def q56(spark, d):
    out = replay.drain(replay.sessions(replay.event_stream(spark, d), "24 hours"), "sessions")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("q57_stream_tracker", None)
def q57(spark, d):
    events = replay.event_stream(spark, d)
    frame = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{src.EPOCH}', ts)").cast("long")
    dets = events.select(F.pmod("user_id", F.lit(10)).alias("video_id"), frame.alias("frame"), F.col("event_id").alias("det_id"), F.col("value").alias("cx"),
                         F.get_json_object("props", "$.k").cast("double").alias("cy"), *src.box_sizes(F.col("user_id")), (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"), "at")
    boxes = tr.with_box(dets).select("video_id", "frame", "det_id", "x1", "y1", "x2", "y2", "confidence", "at")
    return replay.drain(replay.track_stream(boxes).where("lost = 0"), "tracked", "append")
