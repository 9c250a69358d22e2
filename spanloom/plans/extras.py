"""Queries on guards, lookups, validation, timeouts and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import fixed
from ..operators import checks
from ..operators import continuity as co
from ..operators import events as ev
from ..operators import tracks as tr
from ..sources import tables as src
from ..sources.tables import FRAG_ROWS, OBS, r6
from .core import BALLS
from .linking import LINKS, links_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return add


@query("q58_nearest_available_frame", f"""WITH {OBS},
there AS (SELECT DISTINCT video_id, frame FROM obs),
wanted AS (SELECT v.video_id, unnest(range(0, 720))::BIGINT AS frame FROM (SELECT DISTINCT video_id FROM obs) v)
SELECT video_id, frame, nearest FROM (
  SELECT w.video_id, w.frame, t.frame AS nearest, row_number() OVER (PARTITION BY w.video_id, w.frame ORDER BY abs(t.frame - w.frame), t.frame) AS rn
  FROM wanted w JOIN there t USING (video_id)) WHERE rn = 1""")
def q58(spark, d):
    return checks.nearest_frames(src.frame_spine(spark, d), src.observations(spark, d))


@query("q59_guarded_boxes", """
WITH raw AS (SELECT user_id, event_id AS place, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE (event_id % 97)::VARCHAR END AS frame,
    CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE regexp_extract(props, '"k": *(-?[0-9.]+)', 1) END AS a FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS nth FROM raw)
SELECT user_id, place, coalesce(TRY_CAST(frame AS BIGINT), nth)::BIGINT AS frame, TRY_CAST(a AS DOUBLE) AS x1, 0.0::DOUBLE AS y1, 10.0::DOUBLE AS x2, 20.0::DOUBLE AS y2
FROM placed WHERE TRY_CAST(a AS DOUBLE) IS NOT NULL""")
def q59(spark, d):
    e = src.table(spark, d, "events")
    box = F.array(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.get_json_object("props", "$.k")), F.lit("0"), F.lit("10"), F.lit("20"))
    raw = e.select("user_id", F.col("event_id").alias("place"), F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 97).cast("string")).alias("frame"), box.alias("box"))
    return checks.guarded_boxes(raw, ["user_id"])


@query("q77_video_probe", """
WITH raw AS (SELECT p_partkey, p_retailprice AS seconds, CASE WHEN p_partkey % 7 = 0 THEN p_size * 2 END AS nb,
  CASE p_partkey % 5 WHEN 0 THEN (p_size * 1000)::VARCHAR || '/1001' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size::VARCHAR || '/' WHEN 3 THEN '25/0' END AS rate FROM part),
rated AS (SELECT *, CASE WHEN rate IS NULL OR rate = '25/0' THEN NULL WHEN ends_with(rate, '/1001') THEN split_part(rate, '/', 1)::DOUBLE / 1001.0::DOUBLE ELSE split_part(rate, '/', 1)::DOUBLE END AS fps FROM raw)
SELECT p_partkey, fps, coalesce(nb::BIGINT, round_even(seconds * fps, 0)::BIGINT) AS frames FROM rated""")
def q77(spark, d):
    kind, size = F.pmod("p_partkey", F.lit(5)), F.col("p_size")
    rate = F.when(kind == 0, F.concat((size * 1000).cast("string"), F.lit("/1001"))).when(kind == 1, size.cast("string")).when(
        kind == 2, F.concat(size.cast("string"), F.lit("/"))).when(kind == 3, "25/0")
    found = checks.probed(rate, F.when(F.pmod("p_partkey", F.lit(7)) == 0, size * 2), F.col("p_retailprice"))
    return src.table(spark, d, "part").select("p_partkey", found["fps"].alias("fps"), found["frames"].alias("frames"))


@query("q60_event_window", f"""WITH {OBS}, peaks AS (SELECT video_id, track_id, arg_max(frame, {{'c': cx, 'f': -frame}}) AS peak FROM obs GROUP BY video_id, track_id)
SELECT video_id, track_id, peak, greatest(0, least(719, peak - 60))::BIGINT AS first_frame, greatest(0, least(719, peak + 60))::BIGINT AS last_frame FROM peaks""")
def q60(spark, d):
    peaks = src.observations(spark, d).groupBy("video_id", "track_id").agg(F.max_by("frame", F.struct("cx", -F.col("frame"))).alias("peak"))
    first, last = checks.event_window(F.col("peak"), 30.0, 2.0, src.FRAMES)
    return peaks.select("video_id", "track_id", "peak", first.alias("first_frame"), last.alias("last_frame"))


@query("q61_job_timeouts", """
WITH waits AS (SELECT user_id AS job_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000 AS wait FROM events),
late AS (SELECT job_id, count(*) FILTER (wait > 86400) AS late FROM waits GROUP BY job_id)
SELECT job_id, late, (least(late, 5) * (least(late, 5) + 1) // 2 * 2)::BIGINT AS backoff, CASE WHEN late > 5 THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM late""")
def q61(spark, d):
    log = src.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("step"),
                                              F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{src.EPOCH}', ts)").alias("at_us"))
    return checks.timeouts(log, 86_400, 5, 2)


@query("q61b_progress_ticks", "SELECT conv_id AS job_id, least(85, count(*) * 3)::BIGINT AS progress FROM conversations GROUP BY conv_id")
def q61b(spark, d):
    return src.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(F.count(F.lit(1)).alias("polls")).select("job_id", checks.progress(F.col("polls")).alias("progress"))


@query("q62_above_percentile", """
WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), limits AS (SELECT vec_id, quantile_cont(x, 0.4) AS lim FROM parts GROUP BY vec_id)
SELECT vec_id, count(*) FILTER (x > lim)::INTEGER AS above FROM parts JOIN limits USING (vec_id) GROUP BY vec_id""")
def q62(spark, d):
    return src.table(spark, d, "embeddings").select("vec_id", checks.above_percentile(F.col("embedding"), 0.4).alias("above"))


@query("q63_term_scan", """
SELECT doc_id, terms FROM (SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'license') THEN 'License' END, CASE WHEN contains(lower(text), 'token =') THEN 'token =' END,
  CASE WHEN contains(lower(text), 'password') THEN 'password' END) AS terms FROM documents) WHERE terms <> ''""")
def q63(spark, d):
    return checks.term_scan(src.table(spark, d, "documents"), "doc_id", "text", ("License", "token =", "password"))


@query("q64_upload_validation", """
SELECT page_id, CASE WHEN html IS NULL OR length(html) <= 0 THEN 'EMPTY' WHEN length(html) > 2000 THEN 'TOO_LARGE'
  WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ('html', 'htm') THEN 'BAD_TYPE' ELSE 'OK' END AS verdict FROM pages""")
def q64(spark, d):
    return src.table(spark, d, "pages").select("page_id", checks.upload_verdict(F.col("url"), F.length("html"), 2000, ("html", "htm")).alias("verdict"))


@query("q65_missing_classes", """
WITH targets(target) AS (VALUES ('view'), ('click'), ('pitch'), ('sign'))
SELECT target FROM targets WHERE NOT EXISTS (SELECT 1 FROM events WHERE contains(lower(event_type), target))""")
def q65(spark, d):
    targets = spark.createDataFrame([("view",), ("click",), ("pitch",), ("sign",)], "target string")
    return checks.missing_classes(targets, src.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct())


@query("q66_nearest_rejected_link", f"""WITH {LINKS}
SELECT video_id, src, tgt, gap, rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY video_id, src ORDER BY gap, tgt) AS rn FROM links WHERE rejection_reason IS NOT NULL) WHERE rn = 1""")
def q66(spark, d):
    return co.nearest_refusals(links_of(spark, d)[0])


@query("q67_midpoint_ball_proximity", f"""WITH {FRAG_ROWS}, {BALLS},
ends AS (SELECT video_id, fragment_id, (arg_min(cx, frame) + arg_max(cx, frame)) / 2 AS x, (arg_min(cy, frame) + arg_max(cy, frame)) / 2 AS y FROM frows GROUP BY video_id, fragment_id),
near AS (SELECT e.video_id, e.fragment_id, min(sqrt((e.x - b.bx) ** 2 + (e.y - b.by_) ** 2)) AS distance FROM ends e JOIN balls b USING (video_id) GROUP BY e.video_id, e.fragment_id)
SELECT video_id, fragment_id, {r6('distance', 4)} AS distance, {r6('exp(-distance / 140.0::DOUBLE)')} AS proximity FROM near""")
def q67(spark, d):
    obs = src.observations(spark, d)
    stats = tr.track_stats(src.fragment_rows(obs), ["video_id", "fragment_id"])
    points = stats.select("video_id", F.col("fragment_id").alias("id"), ((F.col("start_x") + F.col("end_x")) / 2).alias("x"), ((F.col("start_y") + F.col("end_y")) / 2).alias("y"))
    found = checks.ball_proximity(points, ev.ball_centres(obs, src.BALL), ev.BALL_SCALE)
    return found.select("video_id", F.col("id").alias("fragment_id"), fixed(F.col("distance"), 4).alias("distance"), fixed(F.col("proximity")).alias("proximity"))


@query("q68_crop_windows", f"""WITH {OBS}
SELECT video_id, track_id, frame, {r6('greatest(0.0, least(480.0::DOUBLE - 0.84::DOUBLE * 480, cx - 0.84::DOUBLE * 480 / 2))', 4)} AS left_,
  {r6('greatest(0.0, least(270.0::DOUBLE - 0.84::DOUBLE * 270, cy - 0.84::DOUBLE * 270 * 0.52::DOUBLE))', 4)} AS top_ FROM obs""")
def q68(spark, d):
    window = checks.crop_window(F.col("cx"), F.col("cy"), F.lit(0.84), F.lit(0.52), 480.0, 270.0)
    return src.observations(spark, d).select("video_id", "track_id", "frame", fixed(window["left"], 4).alias("left_"), fixed(window["top"], 4).alias("top_"))


@query("q69_stream_sliding", """
SELECT (epoch_us(ts) // 43200000000) * 12 - 12 * k AS start_hour, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) z GROUP BY ALL""")
def q69(spark, d):
    from ..streaming import replay

    out = replay.drain(replay.sliding(replay.event_stream(spark, d), "1 day", "12 hours"), "sliding")
    return out.select((F.unix_micros("window.start") / 3_600_000_000).cast("long").alias("start_hour"), "n")

