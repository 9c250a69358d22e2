"""Queries on observations, tracks, motion events and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import fixed
from ..operators import events as ev
from ..operators import tracks as tr
from ..sources import tables as src
from ..sources.durable import shared
from ..sources.tables import FRAG_ROWS, OBS, r6

HEIGHT = 1000.0
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return add


@query("q01_obs_clean_dedupe", f"WITH {OBS} SELECT * FROM obs")
def q01(spark, d):
    return src.observations(spark, d)


@query("q02_frame_stride_sample", f"""WITH {OBS}
SELECT video_id, frame FROM (
  SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS rn
  FROM (SELECT DISTINCT video_id, frame FROM obs WHERE frame % 6 = 0)) WHERE rn <= 20""")
def q02(spark, d):
    return tr.stride_sample(src.observations(spark, d), 6, 20)


@query("q03_class_rollup", f"""WITH {OBS}
SELECT video_id, count(DISTINCT frame) AS frames, count(*) AS objects, count(*) FILTER (class_name = 'view') AS persons,
  count(*) FILTER (class_name = 'purchase') AS balls, count(*) FILTER (confidence >= 0.25) AS confident,
  count(DISTINCT track_id) AS tracks FROM det GROUP BY video_id""")
def q03(spark, d):
    return tr.class_rollup(src.detections(spark, d), "view", src.BALL)


@query("q04_bbox_geometry", f"""WITH {OBS}
SELECT video_id, track_id, frame, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area,
  (x2 - x1) / ((y2 - y1) + 1e-9::DOUBLE) AS aspect, greatest(0, floor(x1)::BIGINT) AS crop_left,
  greatest(greatest(0, floor(x1)::BIGINT) + 1, floor(x2)::BIGINT) AS crop_right
FROM (SELECT video_id, track_id, frame, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM obs)""")
def q04(spark, d):
    return tr.with_box(src.observations(spark, d)).select(
        "video_id", "track_id", "frame", "x1", "y1", "x2", "y2", "w", "h", "area", "aspect", "crop_left", "crop_right")


STATS = OBS + """,
stats AS (
  SELECT video_id, track_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame,
    avg(w) AS mean_w, avg(h) AS mean_h, max(frame) - min(frame) + 1 AS span, least(1.0::DOUBLE, count(*)::DOUBLE / (max(frame) - min(frame) + 1)) AS continuity,
    sqrt((arg_max(cx, frame) - arg_min(cx, frame)) ** 2 + (arg_max(cy, frame) - arg_min(cy, frame)) ** 2) AS displacement,
    avg(cx) AS mean_x, avg(cy) AS mean_y, min(cx) AS min_x, max(cx) AS max_x
  FROM obs GROUP BY video_id, track_id)"""


@query("q05_track_stats", f"""WITH {STATS}
SELECT video_id, track_id, n, first_frame, last_frame, span, {r6('continuity')} AS continuity, {r6('displacement')} AS displacement,
  {r6('mean_x')} AS mean_x, {r6('mean_y')} AS mean_y, min_x, max_x FROM stats""")
def q05(spark, d):
    return tr.rounded(tr.track_stats(src.observations(spark, d)), "continuity", "displacement", "mean_x", "mean_y").select(
        "video_id", "track_id", "n", "first_frame", "last_frame", "span", "continuity", "displacement", "mean_x", "mean_y", "min_x", "max_x")


@query("q06_track_ranges", f"WITH {OBS} SELECT video_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame FROM obs GROUP BY ALL")
def q06(spark, d):
    return tr.track_ranges(src.observations(spark, d))


@query("q07_fragments", f"""WITH {FRAG_ROWS}
SELECT video_id, track_id, fragment_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame,
  {r6('avg(confidence)')} AS mean_confidence, {r6('avg(cx)')} AS mean_x FROM frows GROUP BY video_id, track_id, fragment_id""")
def q07(spark, d):
    rows = src.fragment_rows(src.observations(spark, d))
    stats = tr.track_stats(rows, ["video_id", "track_id", "fragment_id"])
    return tr.rounded(stats, "mean_confidence", "mean_x").select(
        "video_id", "track_id", "fragment_id", "n", "first_frame", "last_frame", "mean_confidence", "mean_x")


@query("q08_moving_range", f"""WITH {OBS},
steps AS (SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) > 1e-3 AS moved
  FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
SELECT video_id, track_id, min(frame) AS first_frame, coalesce(max(frame) FILTER (moved), min(frame)) AS last_moving,
  max(frame) AS last_frame, count(*) FILTER (moved) AS moving_frames, max(frame) > coalesce(max(frame) FILTER (moved), min(frame)) AS frozen_tail
FROM steps GROUP BY video_id, track_id""")
def q08(spark, d):
    return tr.moving_ranges(src.observations(spark, d)).withColumn("frozen_tail", F.col("last_frame") > F.col("last_moving"))


VELOCITY = """
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, fragment_id ORDER BY frame DESC) AS place FROM frows) WHERE place <= 7),
vsteps AS (
  SELECT video_id, fragment_id, frame, cx, CASE WHEN place <= 6 THEN frame END AS edge, frame - lag(frame) OVER w AS dt, (cx - lag(cx) OVER w) / (frame - lag(frame) OVER w) AS vx,
    (cy - lag(cy) OVER w) / (frame - lag(frame) OVER w) AS vy
  FROM near WINDOW w AS (PARTITION BY video_id, fragment_id ORDER BY frame)),
mids AS (
  SELECT video_id, fragment_id, median(vx) AS vx, median(vy) AS vy, median(sqrt(vx * vx + vy * vy)) AS mid, count(dt) AS samples,
    max(frame) - min(frame) AS support, (arg_max(cx, edge) - arg_min(cx, edge)) / nullif(max(edge) - min(edge), 0) AS edge_vx,
    coalesce(max(sqrt(vx * vx + vy * vy)) > 1e-9, false) AS moving
  FROM vsteps GROUP BY video_id, fragment_id),
mads AS (
  SELECT s.video_id, s.fragment_id, median(abs(sqrt(s.vx * s.vx + s.vy * s.vy) - m.mid)) AS mad
  FROM vsteps s JOIN mids m USING (video_id, fragment_id) GROUP BY s.video_id, s.fragment_id)"""


@query("q09_robust_velocity", f"""WITH {FRAG_ROWS}, {VELOCITY}
SELECT video_id, fragment_id, {r6('coalesce(vx, 0.0)')} AS vx, {r6('coalesce(vy, 0.0)')} AS vy,
  {r6('coalesce(sqrt(vx * vx + vy * vy), 0.0)')} AS speed, {r6('greatest(coalesce(mad, 0.75), 0.75)')} AS dispersion,
  samples, CASE WHEN samples > 0 THEN support ELSE 0 END AS support, moving, {r6('coalesce(edge_vx, 0.0)')} AS edge_vx
FROM mids JOIN mads USING (video_id, fragment_id)""")
def q09(spark, d):
    rows = src.fragment_rows(src.observations(spark, d))
    return tr.rounded(tr.edge_velocity(rows, ["video_id", "track_id", "fragment_id"]), "vx", "vy", "speed", "dispersion", "edge_vx").drop("track_id")


EVENTS = STATS + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) - 1 AS place,
  count(*) OVER (PARTITION BY video_id, track_id) AS total FROM obs),
moments AS (
  SELECT s.video_id, s.track_id, 'MOTION_' || s.track_id AS event_id, s.first_frame AS start_frame, p.frame AS peak_frame,
    s.last_frame AS end_frame, least(0.99::DOUBLE, s.displacement / 300.0::DOUBLE) AS confidence,
    floor(s.displacement * 100 + 0.5001)::DOUBLE / 100.0::DOUBLE AS tag_displacement, s.displacement
  FROM stats s JOIN placed p ON s.video_id = p.video_id AND s.track_id = p.track_id AND p.place = p.total // 2
  WHERE s.n >= 3 AND s.displacement > 40)"""


@query("q10_motion_events", f"""WITH {EVENTS}
SELECT video_id, track_id, event_id, start_frame, peak_frame, end_frame, {r6('confidence')} AS confidence FROM moments""")
def q10(spark, d):
    return tr.rounded(ev.motion_events(src.observations(spark, d)).drop("evidence"), "confidence")


FOCUS = """
focus AS (
  SELECT video_id, count(*) AS balls, min(frame) AS first_frame, max(frame) AS last_frame,
    floor(quantile_cont(frame, 0.5))::BIGINT AS focus_frame FROM obs WHERE class_name = 'purchase' GROUP BY video_id)"""


@query("q11_ball_evidence", f"WITH {OBS}, {FOCUS} SELECT * FROM focus")
def q11(spark, d):
    return ev.ball_evidence(src.observations(spark, d), src.BALL)


@query("q12_evidence_tag_parse", f"WITH {EVENTS} SELECT video_id, event_id, track_id AS tag_track, tag_displacement FROM moments")
def q12(spark, d):
    return ev.with_evidence(ev.motion_events(src.observations(spark, d))).select("video_id", "event_id", "tag_track", "tag_displacement")


BALLS = """
balls AS (SELECT video_id, frame, arg_max(cx, track_id) AS bx, arg_max(cy, track_id) AS by_ FROM obs WHERE class_name = 'purchase' GROUP BY video_id, frame)"""
NEAREST = BALLS + """,
probes AS (
  SELECT o.video_id, o.track_id, sqrt((o.cx - b.bx) ** 2 + (o.cy - b.by_) ** 2) AS away,
    row_number() OVER (PARTITION BY o.video_id, o.track_id, b.frame ORDER BY abs(o.frame - b.frame), o.frame) AS rn
  FROM obs o JOIN balls b ON o.video_id = b.video_id),
distances AS (SELECT video_id, track_id, min(away) AS ball_distance FROM probes WHERE rn = 1 GROUP BY video_id, track_id)"""


@query("q13_ball_nearest_asof", f"WITH {OBS}, {NEAREST} SELECT video_id, track_id, {r6('ball_distance')} AS ball_distance FROM distances")
def q13(spark, d):
    obs = src.observations(spark, d)
    return tr.rounded(ev.nearest_distance(obs, ev.ball_centres(obs, src.BALL)), "ball_distance")


SIGNALS = EVENTS + f""", {FOCUS}, {NEAREST},
event_focus AS (SELECT video_id, floor(quantile_cont(peak_frame, 0.5))::BIGINT AS event_focus FROM moments GROUP BY video_id),
raw AS (
  SELECT e.video_id, e.track_id, e.event_id, CASE WHEN e.tag_displacement > 0 THEN e.tag_displacement ELSE s.displacement END AS amplitude_px,
    s.n AS persistence_frames, s.continuity, exp(-abs(e.peak_frame - coalesce(f.focus_frame, ef.event_focus)) / 250.0::DOUBLE) AS event_proximity,
    greatest(0.0, least(1.0, s.mean_y / {HEIGHT})) AS spatial_relevance, greatest(0.0, least(1.0, e.confidence)) AS event_confidence,
    CASE WHEN f.balls > 0 THEN coalesce(exp(-d.ball_distance / 140.0::DOUBLE), 0.0) END AS ball_proximity
  FROM moments e LEFT JOIN stats s USING (video_id, track_id) LEFT JOIN focus f USING (video_id)
  LEFT JOIN event_focus ef USING (video_id) LEFT JOIN distances d USING (video_id, track_id)),
sat AS (
  SELECT *, amplitude_px / (amplitude_px + 300.0::DOUBLE) AS amplitude, persistence_frames / (persistence_frames + 120.0::DOUBLE) AS persistence FROM raw),
base AS (
  SELECT *, 0.30::DOUBLE * amplitude + 0.26::DOUBLE * persistence + 0.08::DOUBLE * continuity + 0.12::DOUBLE * event_proximity
    + 0.12::DOUBLE * spatial_relevance + 0.12::DOUBLE * event_confidence AS base FROM sat),
signals AS (
  SELECT *, CASE WHEN ball_proximity IS NULL THEN base ELSE (base + 0.15::DOUBLE * ball_proximity) / 1.15::DOUBLE END AS score FROM base)"""
SIGNAL_NAMES = ("amplitude", "persistence", "continuity", "event_proximity", "spatial_relevance", "event_confidence", "ball_proximity", "score")


def signals_of(spark, d):
    def build():
        obs = src.observations(spark, d)
        return ev.hero_signals(ev.motion_events(obs), tr.track_stats(obs), ev.ball_evidence(obs, src.BALL),
                               ev.nearest_distance(obs, ev.ball_centres(obs, src.BALL)), HEIGHT)

    return shared(spark, "signals", [f"{d}/events.parquet"], build)


@query("q14_hero_signals", f"WITH {SIGNALS} SELECT video_id, track_id, event_id, {', '.join(f'{r6(n)} AS {n}' for n in SIGNAL_NAMES)} FROM signals")
def q14(spark, d):
    return tr.rounded(signals_of(spark, d), *SIGNAL_NAMES).select("video_id", "track_id", "event_id", *SIGNAL_NAMES)


@query("q15_hero_topk", f"""WITH {SIGNALS}
SELECT video_id, rank, track_id, event_id, {r6('score')} AS score, persistence_frames FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {r6('score', 12)} DESC, persistence_frames DESC, {r6('amplitude_px')} DESC, event_id DESC)::INTEGER AS rank
  FROM signals) WHERE rank <= 10""")
def q15(spark, d):
    return ev.rank_heroes(signals_of(spark, d)).select("video_id", "rank", "track_id", "event_id", fixed(F.col("score")).alias("score"), "persistence_frames")


@query("q70_person_sized", f"""WITH {STATS} SELECT video_id, track_id, mean_w <= 90 AND mean_h <= 140 AS person_sized FROM stats""")
def q70(spark, d):
    return tr.person_sized(src.observations(spark, d))


@query("q70b_person_rows", f"""WITH {STATS} SELECT o.video_id, o.track_id, o.frame FROM obs o JOIN stats s USING (video_id, track_id) WHERE mean_w <= 90 AND mean_h <= 140""")
def q70b(spark, d):
    return tr.of_persons(src.observations(spark, d)).select("video_id", "track_id", "frame")


@query("q71_keyframes", f"""WITH {OBS},
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM obs)
SELECT video_id, track_id, frame, cx FROM placed WHERE place % greatest(1, n // 8) = 0""")
def q71(spark, d):
    return tr.keyframes(src.observations(spark, d)).select("video_id", "track_id", "frame", "cx")
