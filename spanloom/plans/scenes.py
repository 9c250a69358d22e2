"""Queries on series, cuts and shot contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import scene as sc
from ..operators import tracks as tr
from ..operators.asof import as_of
from ..sources import tables as src
from ..sources.durable import shared
from ..sources.tables import FRAMES, MOTION, OBS, r6
from .core import SIGNALS, signals_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return add


def boxes_of(spark, d):
    return tr.with_box(src.observations(spark, d))


@query("q21_hold_last", f"""WITH {OBS},
ends AS (SELECT video_id, track_id, min(frame) AS a, max(frame) AS z FROM obs GROUP BY video_id, track_id),
every AS (SELECT video_id, track_id, unnest(range(a, z + 1))::BIGINT AS frame FROM ends),
joined AS (SELECT e.video_id, e.track_id, e.frame, o.cx, o.cy FROM every e LEFT JOIN obs o USING (video_id, track_id, frame))
SELECT video_id, track_id, frame, last_value(cx IGNORE NULLS) OVER w AS cx, last_value(cy IGNORE NULLS) OVER w AS cy, cx IS NULL AS held
FROM joined WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q21(spark, d):
    return sc.hold_last(src.observations(spark, d))


@query("q22_group_geometry", f"""WITH {OBS}
SELECT video_id, frame, {r6('avg(cx)', 3)} AS mean_x, min(cx - w / 2) AS left, max(cx + w / 2) AS right, count(*) AS n FROM obs GROUP BY video_id, frame""")
def q22(spark, d):
    return tr.rounded(sc.group_geometry(boxes_of(spark, d)), "mean_x", places=3)


PERSONS = """
persons AS (SELECT video_id, track_id, avg(w) <= 90 AND avg(h) <= 140 AS person_sized FROM obs GROUP BY video_id, track_id)"""


@query("q22b_dominant_track", f"""WITH {OBS}, {PERSONS},
anyone AS (SELECT video_id, bool_or(person_sized) AS seen FROM persons GROUP BY video_id)
SELECT video_id, frame, track_id FROM (
  SELECT o.video_id, o.frame, o.track_id, row_number() OVER (PARTITION BY o.video_id, o.frame ORDER BY ((cx + w / 2) - (cx - w / 2)) * ((cy + h / 2) - (cy - h / 2)) DESC, o.track_id) AS rn
  FROM obs o JOIN persons p USING (video_id, track_id) JOIN anyone a ON o.video_id = a.video_id WHERE p.person_sized OR NOT a.seen) WHERE rn = 1""")
def q22b(spark, d):
    return sc.dominant_track(boxes_of(spark, d), tr.person_sized(src.observations(spark, d)))


@query("q23_motion_profile", f"""WITH {OBS}, {MOTION}
SELECT video_id, frame, {r6('mean', 4)} AS mean, {r6('peak', 4)} AS peak, peak_frame FROM (
  SELECT m.video_id, m.frame, avg(n.value) AS mean, max(n.value) AS peak, arg_max(n.frame, {{'v': n.value, 'f': -n.frame}}) AS peak_frame
  FROM motion m JOIN motion n ON m.video_id = n.video_id AND n.frame BETWEEN m.frame - 48 AND m.frame + 48
  WHERE m.frame % 24 = 0 GROUP BY m.video_id, m.frame)""")
def q23(spark, d):
    return tr.rounded(sc.motion_profile(src.motion_series(spark, d), 48, 24), "mean", "peak", places=4)


@query("q23b_change_percentiles", f"""WITH {OBS}, {MOTION},
steps AS (SELECT video_id, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame)) AS change FROM motion)
SELECT video_id, {r6('avg(change)', 4)} AS mean_change, {r6('quantile_cont(change, 0.95)', 4)} AS p95, {r6('quantile_cont(change, 0.99)', 4)} AS p99
FROM steps GROUP BY video_id""")
def q23b(spark, d):
    return tr.rounded(sc.change_percentiles(src.motion_series(spark, d)), "mean_change", "p95", "p99", places=4)


@query("q24_camera_motion_summary", f"""WITH {OBS},
geo AS (SELECT video_id, frame, avg(cx) AS mean_x FROM obs GROUP BY video_id, frame),
steps AS (SELECT video_id, mean_x - lag(mean_x) OVER (PARTITION BY video_id ORDER BY frame) AS dx FROM geo)
SELECT video_id, count(dx) AS samples, {r6('avg(dx)', 4)} AS mean_dx, {r6('min(dx)', 4)} AS min_dx, {r6('max(dx)', 4)} AS max_dx, count(dx) > 0 AS available
FROM steps GROUP BY video_id""")
def q24(spark, d):
    return tr.rounded(sc.shift_summary(sc.group_geometry(boxes_of(spark, d))), "mean_dx", "min_dx", "max_dx", places=4)


SPEED = OBS + f""",
rawspeed AS (SELECT video_id, track_id, frame, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS raw
  FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
profile AS (SELECT video_id, track_id, frame, {r6('avg(raw) OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 4)} AS speed
  FROM rawspeed WHERE raw IS NOT NULL)"""


@query("q25_speed_profile", f"WITH {SPEED} SELECT * FROM profile")
def q25(spark, d):
    return sc.speed_profile(src.observations(spark, d))


BEATS = SPEED + """,
peaks AS (SELECT *, max(speed) OVER (PARTITION BY video_id, track_id) AS most, coalesce(lag(speed) OVER w, 0.0) AS before, coalesce(lead(speed) OVER w, 0.0) AS after
  FROM profile WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
prim AS (SELECT video_id, track_id, min(frame) FILTER (speed = most) AS primary_beat, max(most) AS peak_speed FROM peaks WHERE most > 1e-6 GROUP BY video_id, track_id),
sec AS (SELECT video_id, track_id, frame, row_number() OVER (PARTITION BY video_id, track_id ORDER BY speed DESC, frame) AS rn
  FROM peaks JOIN prim USING (video_id, track_id) WHERE frame >= primary_beat + 24 AND speed >= 0.30::DOUBLE * most AND speed >= before AND speed >= after),
onset AS (SELECT video_id, track_id, max(frame) AS onset FROM peaks JOIN prim USING (video_id, track_id) WHERE frame < primary_beat AND speed < 0.35::DOUBLE * most GROUP BY video_id, track_id),
beats AS (SELECT p.video_id, p.track_id, p.primary_beat, s.frame AS secondary_beat, p.peak_speed, o.onset
  FROM prim p LEFT JOIN (SELECT * FROM sec WHERE rn = 1) s USING (video_id, track_id) LEFT JOIN onset o USING (video_id, track_id))"""


@query("q26_beats_and_onset", f"WITH {BEATS} SELECT * FROM beats")
def q26(spark, d):
    return sc.beats(sc.speed_profile(src.observations(spark, d)))


@query("q76_frame_transforms", f"""WITH {OBS},
days AS (SELECT video_id, track_id, frame // 24 AS frame, avg(cx) AS cx, avg(cy) AS cy FROM obs GROUP BY ALL),
moved AS (SELECT video_id, frame, lag(cx) OVER w AS px, lag(cy) OVER w AS py, cx AS qx, cy AS qy FROM days WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
mean AS (SELECT video_id, frame, count(*) AS tracks, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy FROM moved
  WHERE px IS NOT NULL AND py IS NOT NULL AND qx IS NOT NULL AND qy IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
fit AS (SELECT video_id, frame, any_value(tracks) AS tracks, any_value(mpx) AS mpx, any_value(mpy) AS mpy, any_value(mqx) AS mqx, any_value(mqy) AS mqy,
  sum((px - mpx) * (qx - mqx) + (py - mpy) * (qy - mqy)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS a,
  sum((px - mpx) * (qy - mqy) - (py - mpy) * (qx - mqx)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS b
  FROM moved JOIN mean USING (video_id, frame) WHERE px IS NOT NULL AND py IS NOT NULL AND qx IS NOT NULL AND qy IS NOT NULL GROUP BY video_id, frame)
SELECT video_id, frame, tracks, {r6('mqx - (a * mpx - b * mpy)', 4)} AS dx, {r6('mqy - (b * mpx + a * mpy)', 4)} AS dy, {r6('sqrt(a * a + b * b)', 4)} AS scale,
  {r6('degrees(atan2(b, a))', 4)} AS rotation_deg FROM fit""")
def q76(spark, d):
    """By days, as few tracks are seen in neighbouring frames."""
    days = src.observations(spark, d).groupBy("video_id", "track_id", F.floor(F.col("frame") / 24).alias("frame")).agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
    return tr.rounded(sc.frame_transforms(days, 3), "dx", "dy", "scale", "rotation_deg", places=4)


CUTS = MOTION + """,
based AS (SELECT *, avg(value) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS baseline FROM motion),
cuts AS (SELECT * FROM based WHERE frame >= 1 AND value > 18 AND value > 3 * greatest(baseline, 1e-6))"""


@query("q27_cut_detection", f"WITH {OBS}, {CUTS} SELECT video_id, frame, {r6('value', 4)} AS value, {r6('baseline', 4)} AS baseline FROM cuts")
def q27(spark, d):
    return tr.rounded(sc.cuts(src.motion_series(spark, d)), "value", "baseline", places=4)


@query("q78_evidence", f"""WITH {OBS}, {CUTS}, {PERSONS},
geo AS (SELECT video_id, frame, avg(cx) AS mean_x FROM obs GROUP BY video_id, frame),
steps AS (SELECT video_id, mean_x - lag(mean_x) OVER (PARTITION BY video_id ORDER BY frame) AS dx FROM geo)
SELECT v.video_id, (SELECT count(*) FROM persons p WHERE p.video_id = v.video_id) AS tracks, (SELECT count(*) FROM persons p WHERE p.video_id = v.video_id AND person_sized) AS person_sized_tracks,
  b.balls, b.first_ball, b.last_ball, (SELECT count(*) FROM cuts c WHERE c.video_id = v.video_id) AS cuts, m.motion_frames, m.motion_mean, m.motion_peak_frame, m.motion_peak, s.shifts, s.mean_dx
FROM (SELECT DISTINCT video_id FROM det) v
JOIN (SELECT video_id, count(*) FILTER (class_name = '{src.BALL}') AS balls, min(frame) FILTER (class_name = '{src.BALL}') AS first_ball, max(frame) FILTER (class_name = '{src.BALL}') AS last_ball
  FROM obs GROUP BY video_id) b USING (video_id)
JOIN (SELECT video_id, count(*) AS motion_frames, {r6('avg(value)', 4)} AS motion_mean, arg_max(frame, {{'v': value, 'f': -frame}}) AS motion_peak_frame, {r6('max(value)', 4)} AS motion_peak
  FROM motion GROUP BY video_id) m USING (video_id)
JOIN (SELECT video_id, count(dx) AS shifts, {r6('avg(dx)', 4)} AS mean_dx FROM steps GROUP BY video_id) s USING (video_id)""")
def q78(spark, d):
    obs, motion = src.observations(spark, d), src.motion_series(spark, d)
    found = sc.evidence(src.detections(spark, d).select("video_id").distinct(), tr.person_sized(obs), obs.where(F.col("class_name") == src.BALL).select("video_id", "frame"),
                        sc.cuts(motion), motion, sc.shift_summary(sc.group_geometry(boxes_of(spark, d))))
    return tr.rounded(found, "motion_mean", "motion_peak", "mean_dx", places=4)


TERMS = CUTS + f""",
ranges AS (SELECT video_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame FROM obs GROUP BY video_id, track_id),
met AS (SELECT c.video_id, c.frame, r.track_id, r.first_frame, r.last_frame FROM cuts c JOIN ranges r USING (video_id)),
disc AS (SELECT video_id, frame, CASE WHEN count(*) FILTER (last_frame >= frame) > 0
    THEN count(*) FILTER (first_frame >= frame) / (count(*) FILTER (last_frame >= frame))::DOUBLE ELSE 0.0 END AS disc FROM met GROUP BY video_id, frame),
parts AS (SELECT m.video_id, m.frame, m.last_frame < m.frame AS pre, unnest(range(1, len(e.embedding) + 1)) AS at_, unnest(e.embedding)::DOUBLE AS x
  FROM met m JOIN embeddings e ON m.track_id = e.vec_id WHERE m.last_frame < m.frame OR m.first_frame >= m.frame),
means AS (SELECT video_id, frame, pre, at_, avg(x) AS x FROM parts GROUP BY video_id, frame, pre, at_),
cosines AS (SELECT a.video_id, a.frame, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine
  FROM means a JOIN means b ON a.video_id = b.video_id AND a.frame = b.frame AND a.at_ = b.at_ AND a.pre AND NOT b.pre GROUP BY a.video_id, a.frame),
terms AS (
  SELECT c.video_id, c.frame, {r6('greatest(0.0, least(1.0, c.value / greatest(c.baseline, 1e-9::DOUBLE) / 4.0::DOUBLE))', 4)} AS motion_change,
    {r6('greatest(0.0, least(1.0, (c.value - c.baseline) / greatest(1e-9::DOUBLE, c.value + c.baseline)))', 4)} AS scene_change,
    {r6('d.disc', 4)} AS tracking_discontinuity, CASE WHEN s.cosine IS NOT NULL THEN {r6('greatest(0.0, least(1.0, (1.0::DOUBLE - s.cosine) / 2.0::DOUBLE))', 4)} END AS appearance_change
  FROM cuts c LEFT JOIN disc d USING (video_id, frame) LEFT JOIN cosines s USING (video_id, frame))"""


def terms_of(spark, d):
    vectors = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))
    return sc.cut_terms(sc.cuts(src.motion_series(spark, d)), tr.track_ranges(src.observations(spark, d)), vectors)


@query("q28_cut_terms", f"WITH {OBS}, {TERMS} SELECT * FROM terms")
def q28(spark, d):
    return terms_of(spark, d)


SURE = TERMS + f""",
sure AS (SELECT video_id, frame,
  (0.45::DOUBLE * motion_change + 0.25::DOUBLE * scene_change + coalesce(0.15::DOUBLE * appearance_change, 0.0) + coalesce(0.15::DOUBLE * tracking_discontinuity, 0.0))
  / (0.70::DOUBLE + CASE WHEN appearance_change IS NULL THEN 0.0 ELSE 0.15::DOUBLE END + CASE WHEN tracking_discontinuity IS NULL THEN 0.0 ELSE 0.15::DOUBLE END) AS raw
  FROM terms),
boundaries AS (SELECT video_id, frame, {r6('raw', 4)} AS confidence, CASE WHEN {r6('raw', 9)} >= 0.60 THEN 'REAL_CUT' ELSE 'SOFT_TRANSITION' END AS kind FROM sure)"""


@query("q29_cut_confidence", f"WITH {OBS}, {SURE} SELECT * FROM boundaries")
def q29(spark, d):
    return sc.cut_confidence(terms_of(spark, d))


CONTEXTS = SURE + f""",
starts AS (SELECT DISTINCT video_id, 0::BIGINT AS start_frame FROM det UNION SELECT video_id, frame FROM boundaries WHERE kind = 'REAL_CUT'),
contexts AS (SELECT video_id, row_number() OVER w::INTEGER AS context, start_frame, coalesce(lead(start_frame) OVER w, {FRAMES}) - 1 AS end_frame
  FROM starts WINDOW w AS (PARTITION BY video_id ORDER BY start_frame))""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


def contexts_of(spark, d):
    def build():
        videos = src.detections(spark, d).select("video_id").distinct()
        return sc.context_bounds(videos, sc.cut_confidence(terms_of(spark, d)).where("kind = 'REAL_CUT'"), FRAMES)

    return shared(spark, "contexts", [f"{d}/events.parquet", f"{d}/embeddings.parquet"], build)


@query("q33_context_bounds", f"WITH {OBS}, {CONTEXTS} SELECT * FROM contexts")
def q33(spark, d):
    return contexts_of(spark, d)


@query("q33b_context_of_frame", f"""WITH {OBS}, {CONTEXTS}
SELECT s.video_id, s.frame, c.context FROM spine s JOIN contexts c ON s.video_id = c.video_id AND s.frame BETWEEN c.start_frame AND c.end_frame""")
def q33b(spark, d):
    """Contexts partition the frames, so a frame's context is the last one that began: no join of ranges."""
    starts = contexts_of(spark, d).select("video_id", F.col("start_frame").alias("frame"), "context")
    return as_of(src.frame_spine(spark, d), starts, ["video_id"], "frame", ["context"]).select("video_id", "frame", F.col("match.context").alias("context"))


SUBJECTS = CONTEXTS + ", " + SIGNALS[SIGNALS.index("stats AS ("):] + f""",
best AS (SELECT video_id, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id
  ORDER BY {r6('score', 12)} DESC, persistence_frames DESC, {r6('amplitude_px')} DESC, event_id DESC) AS rank FROM signals) WHERE rank = 1),
mv AS (SELECT video_id, track_id, min(frame) AS first_frame, coalesce(max(frame) FILTER (moved), min(frame)) AS last_moving, max(frame) AS last_frame FROM (
  SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) > 1e-3 AS moved FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
  GROUP BY video_id, track_id),
chosen AS (
  SELECT c.video_id, c.context, m.track_id, least(m.last_moving, c.end_frame) - greatest(m.first_frame, c.start_frame) + 1 AS overlap,
    row_number() OVER (PARTITION BY c.video_id, c.context ORDER BY coalesce(m.track_id = b.track_id, false) DESC,
      least(m.last_moving, c.end_frame) - greatest(m.first_frame, c.start_frame) DESC, m.track_id) AS rn
  FROM contexts c JOIN mv m ON c.video_id = m.video_id AND m.first_frame <= c.end_frame AND m.last_moving >= c.start_frame
  JOIN stats p ON m.video_id = p.video_id AND m.track_id = p.track_id
  LEFT JOIN best b ON c.video_id = b.video_id WHERE coalesce(m.track_id = b.track_id, false) OR (p.mean_w <= 90 AND p.mean_h <= 140)),
subjects AS (SELECT c.*, s.track_id AS subject, s.overlap FROM contexts c LEFT JOIN (SELECT * FROM chosen WHERE rn = 1) s USING (video_id, context))"""


def subjects_of(spark, d):
    obs = src.observations(spark, d)
    moving = tr.moving_ranges(obs).join(tr.person_sized(obs), ["video_id", "track_id"])
    return sc.primary_subjects(contexts_of(spark, d), moving, ev.rank_heroes(signals_of(spark, d), 1))


@query("q35_primary_subject", f"WITH {OBS}, {SUBJECTS} SELECT video_id, context, start_frame, end_frame, subject, overlap FROM subjects")
def q35(spark, d):
    return subjects_of(spark, d)


