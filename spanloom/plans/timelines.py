"""Queries that plan a timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import fixed
from ..operators import continuity as co
from ..operators import events as ev
from ..operators import scene as sc
from ..operators import timeline as tl
from ..operators import tracks as tr
from ..sources import tables as src
from ..sources.durable import cut_lineage, shared
from ..sources.tables import FRAMES, OBS, r6
from .core import signals_of
from .linking import HERO_SQL, fragments_of, hero_lineage
from .scenes import BEATS, CONTEXTS, SUBJECTS, contexts_of

QUERIES: dict = {}
ORACLES: dict = {}
TOTAL = 860
CROP, WIDTH = 120.0, 480.0


def query(name: str, sql: str | None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


# The oracle's own table, so that it does not repeat a fault of the operators' one.
DIM = """dim AS (SELECT * FROM (VALUES
  ('HOOK', 20, 'HOOK', 'PULL_BACK', 'NORMAL', 0.98::DOUBLE, 0, 1.0::DOUBLE, 1.0::DOUBLE, 'linear', -0.08::DOUBLE, false),
  ('BUILD_UP', 30, 'WIDE', 'STABLE_FOLLOW', 'SLIGHT_FAST', 1.0::DOUBLE, 1, 1.04::DOUBLE, 1.12::DOUBLE, 'in_out', 0.0::DOUBLE, true),
  ('ANTICIPATION', 55, 'MEDIUM', 'ANTICIPATION_FOLLOW', 'ANTICIPATION_SLOW', 0.9::DOUBLE, 2, 0.76::DOUBLE, 0.9::DOUBLE, 'in', 0.02::DOUBLE, true),
  ('ACTION', 60, 'MEDIUM', 'STABLE_FOLLOW', 'ANTICIPATION_SLOW', 0.9::DOUBLE, 3, 0.76::DOUBLE, 0.9::DOUBLE, 'in', 0.0::DOUBLE, true),
  ('HERO', 100, 'HERO_MEDIUM', 'PUSH_IN', 'HERO_SLOW', 0.84::DOUBLE, 4, 0.58::DOUBLE, 0.76::DOUBLE, 'in_out', 0.08::DOUBLE, true),
  ('REACTION', 70, 'REACTION', 'REACTION_FRAMING', 'RECOVERY', 0.88::DOUBLE, 5, 0.88::DOUBLE, 1.0::DOUBLE, 'out', -0.04::DOUBLE, true),
  ('CELEBRATION', 50, 'CELEBRATION', 'CELEBRATION_FRAMING', 'RECOVERY', 0.8::DOUBLE, 6, 0.88::DOUBLE, 1.0::DOUBLE, 'out', 0.02::DOUBLE, true),
  ('SECONDARY', 40, 'WIDE', 'STABLE_FOLLOW', 'NORMAL', 1.0::DOUBLE, 7, 1.0::DOUBLE, 1.0::DOUBLE, 'linear', 0.0::DOUBLE, false),
  ('CUTAWAY', 35, 'CUTAWAY', 'STABLE_FOLLOW', 'NORMAL', 1.0::DOUBLE, 8, 1.0::DOUBLE, 1.0::DOUBLE, 'linear', 0.0::DOUBLE, false),
  ('CLIMAX', 90, 'LOW_FEELING', 'CELEBRATION_FRAMING', 'HERO_SLOW', 0.86::DOUBLE, 9, 0.58::DOUBLE, 0.76::DOUBLE, 'in_out', 0.02::DOUBLE, true),
  ('FINAL_HERO', 85, 'FINAL_HERO', 'FINAL_HERO_FRAMING', 'RECOVERY', 0.86::DOUBLE, 10, 0.88::DOUBLE, 1.0::DOUBLE, 'out', 0.02::DOUBLE, true),
  ('OUTRO', 95, 'OUTRO', 'PULL_BACK', 'NORMAL', 0.95::DOUBLE, 11, 1.0::DOUBLE, 1.0::DOUBLE, 'linear', -0.08::DOUBLE, false))
  t(phase, priority, shot, camera, behaviour, crop, place, lo, hi, easing, delta, needs_event))"""


def _after(text: str, first: str) -> str:
    """The views of `text` from `first` on."""
    return text[text.index(f"{first} AS ("):]


BASE = SUBJECTS + ", " + _after(BEATS, "rawspeed") + ", " + DIM + f""",
hh AS (SELECT b.video_id, b.track_id, m.first_frame, m.last_moving, m.last_frame, t.primary_beat AS peak, t.onset, t.secondary_beat AS second_
  FROM best b JOIN mv m USING (video_id, track_id) JOIN beats t USING (video_id, track_id)),
h1 AS (SELECT *, greatest(first_frame, peak - 29) AS naive, greatest(first_frame, coalesce(onset, greatest(first_frame, peak - 29))) AS wanted FROM hh),
h2 AS (SELECT *, CASE WHEN wanted >= peak THEN naive ELSE wanted END AS on_ FROM h1),
h3 AS (SELECT *, least(last_frame, greatest(peak + 67, on_ + 11)) AS hero_end, CASE WHEN on_ - 1 >= first_frame THEN greatest(first_frame, on_ - 30) END AS ant FROM h2),
h4 AS (SELECT *, CASE WHEN ant - 1 >= first_frame THEN greatest(first_frame, ant - 36) END AS act_lo, least(last_frame, hero_end + 30) AS rea_end FROM h3),
h5 AS (SELECT *, CASE WHEN ant - act_lo >= 12 THEN act_lo END AS act, greatest(hero_end, rea_end) + 1 AS tail, least(30, first_frame) AS hook,
  CASE WHEN second_ IS NOT NULL THEN greatest(rea_end + 1, second_ - 6) END AS final_, CASE WHEN second_ IS NOT NULL THEN least(last_frame, second_ + 17) END AS final_end FROM h4),
tops AS (SELECT video_id, arg_max(frame, {{'v': value, 'f': -frame}}) AS top FROM motion GROUP BY video_id),
h6 AS (SELECT h.*, t.top, CASE WHEN {FRAMES} - tail >= 12 THEN greatest(tail, {FRAMES - 18}) END AS out_ FROM h5 h LEFT JOIN tops t USING (video_id)),
h6b AS (SELECT *, coalesce(top BETWEEN tail AND out_ - 1 AND least(out_ - 1, top + 18) - greatest(tail, top - 18) + 1 >= 12, false) AS alone FROM h6),
h7 AS (SELECT *, alone AND greatest(tail, top - 18) - tail >= 12 AS cel, CASE WHEN alone AND greatest(tail, top - 18) - tail >= 12 THEN top - 18 ELSE tail END AS c_lo,
  CASE WHEN alone THEN least(out_ - 1, top + 18) ELSE out_ - 1 END AS c_hi FROM h6b),
cand AS (
  SELECT video_id, 0 AS idx, 'HERO' AS phase, on_ AS start_frame, hero_end AS end_frame FROM h7
  UNION ALL SELECT video_id, 1, 'ANTICIPATION', ant, on_ - 1 FROM h7 WHERE ant IS NOT NULL
  UNION ALL SELECT video_id, 2, 'ACTION', act, ant - 1 FROM h7 WHERE act IS NOT NULL
  UNION ALL SELECT video_id, 3, 'BUILD_UP', hook, act_lo - 1 FROM h7 WHERE act_lo - hook >= 12
  UNION ALL SELECT video_id, 4, 'HOOK', 0, hook - 1 FROM h7 WHERE first_frame >= 12
  UNION ALL SELECT video_id, 5, 'REACTION', hero_end + 1, rea_end FROM h7
  UNION ALL SELECT video_id, 6, 'FINAL_HERO', final_, final_end FROM h7 WHERE final_end - final_ + 1 >= 12
  UNION ALL SELECT video_id, 7, 'CELEBRATION', tail, c_lo - 1 FROM h7 WHERE cel
  UNION ALL SELECT video_id, 8, 'CLIMAX', c_lo, c_hi FROM h7 WHERE alone
  UNION ALL SELECT video_id, 9, 'SECONDARY', c_hi + 1, out_ - 1 FROM h7 WHERE alone AND out_ - 1 - c_hi >= 12
  UNION ALL SELECT video_id, 10, 'CELEBRATION', c_lo, c_hi FROM h7 WHERE out_ IS NOT NULL
  UNION ALL SELECT video_id, 11, 'OUTRO', coalesce(out_, tail), {FRAMES - 1} FROM h7),
cands AS (SELECT video_id, idx::INTEGER AS idx, phase, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM cand WHERE start_frame <= end_frame)"""


def heroes_of(spark, d):
    """One row a video: plans start from it several times."""
    def build():
        obs = src.observations(spark, d)
        best = ev.rank_heroes(signals_of(spark, d), 1).select("video_id", "track_id")
        mine = obs.join(best, ["video_id", "track_id"], "left_semi")
        return tr.moving_ranges(mine).join(sc.beats(sc.speed_profile(mine)), ["video_id", "track_id"]).select(
            "video_id", "track_id", "first_frame", "last_moving", "last_frame", F.col("primary_beat").alias("peak"), "onset", F.col("secondary_beat").alias("second"))

    return shared(spark, "heroes", [f"{d}/events.parquet"], build)


def candidates_of(spark, d, heroes=None):
    return tl.phase_candidates(heroes or heroes_of(spark, d), src.motion_series(spark, d), FRAMES)


@query("q31_phase_candidates", f"WITH {OBS}, {BASE} SELECT * FROM cands")
def q31(spark, d):
    return candidates_of(spark, d)


OWNED = BASE + """,
covered AS (SELECT c.video_id, s.frame, c.idx, c.phase, row_number() OVER (PARTITION BY c.video_id, s.frame ORDER BY m.priority DESC, c.idx) AS rn
  FROM cands c JOIN dim m USING (phase) JOIN spine s ON c.video_id = s.video_id AND s.frame BETWEEN c.start_frame AND c.end_frame),
own1 AS (SELECT s.video_id, s.frame, c.idx, c.phase FROM spine s JOIN (SELECT DISTINCT video_id FROM cands) v USING (video_id)
  LEFT JOIN (SELECT * FROM covered WHERE rn = 1) c ON s.video_id = c.video_id AND s.frame = c.frame),
owner AS (SELECT video_id, frame,
  coalesce(last_value(idx IGNORE NULLS) OVER b, first_value(idx IGNORE NULLS) OVER a) AS idx,
  coalesce(last_value(phase IGNORE NULLS) OVER b, first_value(phase IGNORE NULLS) OVER a) AS phase
  FROM own1 WINDOW b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
steps2 AS (SELECT *, CASE WHEN phase <> lag(phase) OVER (PARTITION BY video_id ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM owner),
islands AS (SELECT *, (sum(turn) OVER (PARTITION BY video_id ORDER BY frame))::BIGINT AS run FROM steps2),
segs AS (SELECT video_id, run, phase, min(frame) AS start_frame, max(frame) AS end_frame FROM islands GROUP BY video_id, run, phase)"""


def owners_of(spark, d, heroes=None):
    return tl.frame_owners(candidates_of(spark, d, heroes), tl.phase_table(spark), FRAMES)


def segments_of(spark, d, heroes=None):
    """Stretches of one phase, before short ones are merged: what SQL can follow."""
    return tl.runs(owners_of(spark, d, heroes), ["phase"])


@query("q32_frame_owners", f"WITH {OBS}, {OWNED} SELECT video_id, run, phase, start_frame, end_frame FROM segs")
def q32(spark, d):
    return segments_of(spark, d)


@query("q32b_timeline_resolution", None)
def q32b(spark, d):
    """With short stretches merged, which is sequential; tested against brute force."""
    return tl.resolve(tl.runs(owners_of(spark, d), ["idx", "phase"]), tl.phase_table(spark))


def boundaries_of(spark, d):
    """Every measured cut: segments are split, and blends stopped, at all of them."""
    return sc.cuts(src.motion_series(spark, d)).select("video_id", "frame")


MARKS = "marks AS (SELECT video_id, frame FROM cuts)"


@query("q36_split_at_cuts", f"""WITH {OBS}, {OWNED}, {MARKS},
edges AS (SELECT video_id, phase, start_frame AS seg, start_frame, end_frame FROM segs
  UNION SELECT s.video_id, s.phase, s.start_frame, m.frame, s.end_frame FROM segs s JOIN marks m ON s.video_id = m.video_id AND m.frame > s.start_frame AND m.frame <= s.end_frame),
parts2 AS (SELECT video_id, phase, seg, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY video_id, seg ORDER BY start_frame) - 1, end_frame) AS end_frame, end_frame AS whole_end FROM edges),
fine AS (SELECT *, min(end_frame - start_frame + 1) OVER (PARTITION BY video_id, seg) >= 12 AS fine FROM parts2)
SELECT video_id, phase, CASE WHEN fine THEN start_frame ELSE seg END AS start_frame, CASE WHEN fine THEN end_frame ELSE whole_end END AS end_frame, NOT fine AS kept_whole
FROM fine WHERE fine OR start_frame = seg""")
def q36(spark, d):
    return tl.split_at_cuts(segments_of(spark, d), boundaries_of(spark, d))


@query("q36b_plan_validation", f"""WITH {OBS}, {OWNED},
joined2 AS (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame) + 1 = start_frame, true) AS joined FROM segs)
SELECT video_id, count(*) AS segments, count(*) FILTER (NOT joined) AS broken, min(start_frame) <> 0 AS bad_start, max(end_frame) <> {FRAMES - 1} AS bad_end,
  count(*) FILTER (end_frame - start_frame + 1 < 12) AS short FROM joined2 GROUP BY video_id""")
def q36b(spark, d):
    return tl.validate(segments_of(spark, d), FRAMES)


@query("q36c_phases_absent", f"""WITH {OBS}, {OWNED},
why AS (SELECT video_id, 'ACTION' AS phase, 'ACTION_WINDOW_TOO_SHORT' AS reason FROM h7 WHERE act_lo IS NOT NULL AND ant - act_lo < 12
  UNION ALL SELECT video_id, 'ANTICIPATION', 'SHORT_PRE_HERO_WINDOW' FROM h7 WHERE on_ - 1 >= first_frame AND ant - 1 < first_frame AND on_ - first_frame < 30
  UNION ALL SELECT video_id, 'HOOK', 'NO_PRE_HERO_FRAMES' FROM h7 WHERE first_frame < 12
  UNION ALL SELECT video_id, 'REACTION', 'NO_POST_HERO_FRAMES' FROM h7 WHERE rea_end < hero_end + 1
  UNION ALL SELECT video_id, 'FINAL_HERO', unnest(['HERO_NOT_TRACKED_IN_FINAL_WINDOW', 'NO_SECOND_HERO_BEAT']) FROM h7 WHERE second_ IS NULL
  UNION ALL SELECT video_id, 'FINAL_HERO', 'SECOND_BEAT_TOO_SHORT' FROM h7 WHERE final_end - final_ + 1 < 12
  UNION ALL SELECT video_id, 'SECONDARY', 'SECONDARY_WINDOW_TOO_SHORT' FROM h7 WHERE alone AND out_ - 1 - c_hi < 12
  UNION ALL SELECT video_id, 'CLIMAX', 'NO_ISOLATED_MOTION_PEAK' FROM h7 WHERE out_ IS NOT NULL AND NOT alone
  UNION ALL SELECT video_id, 'CELEBRATION', 'TAIL_TOO_SHORT_FOR_CELEBRATION' FROM h7 WHERE out_ IS NULL)
SELECT v.video_id, m.phase, coalesce(w.reason, 'INSUFFICIENT_EVIDENCE') AS reason FROM (SELECT DISTINCT video_id FROM segs) v CROSS JOIN dim m
LEFT JOIN why w ON w.video_id = v.video_id AND w.phase = m.phase WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.video_id = v.video_id AND s.phase = m.phase)""")
def q36c(spark, d):
    heroes = heroes_of(spark, d)
    return tl.phases_absent(segments_of(spark, d, heroes), tl.phase_windows(heroes, src.motion_series(spark, d), FRAMES))


@query("q36d_shots", f"""WITH {OBS}, {OWNED}
SELECT s.video_id, s.start_frame, s.end_frame, s.phase, m.shot, m.camera,
  greatest(0.72::DOUBLE, least(1.0, CASE WHEN m.camera = 'PULL_BACK' THEN m.crop - m.delta ELSE m.crop END)) AS crop_start,
  greatest(0.72::DOUBLE, least(1.0, CASE WHEN m.camera = 'PULL_BACK' THEN m.crop ELSE m.crop - m.delta END)) AS crop_end,
  (s.start_frame / 30.0::DOUBLE) AS start_seconds, ((s.end_frame + 1) / 30.0::DOUBLE) AS end_seconds,
  CASE WHEN s.phase IN ('ANTICIPATION', 'ACTION', 'HERO', 'REACTION', 'FINAL_HERO') AND h.first_frame <= s.end_frame AND h.last_moving >= s.start_frame THEN h.track_id END AS subject
FROM segs s JOIN dim m USING (phase) JOIN h7 h USING (video_id)""")
def q36d(spark, d):
    """Segments with framing: the camera's delta widens the start of a pull-back, and tightens the end of any other move."""
    heroes = heroes_of(spark, d)
    s = segments_of(spark, d, heroes).join(F.broadcast(tl.phase_table(spark)), "phase").join(heroes.select("video_id", "track_id", "first_frame", "last_moving"), "video_id")
    delta = F.lit(0.0)
    for camera, value in tl.CROP_DELTA.items():
        delta = F.when(F.col("camera") == camera, F.lit(value)).otherwise(delta)
    back = F.col("camera") == "PULL_BACK"
    bound = lambda x: F.greatest(F.lit(0.72), F.least(F.lit(1.0), x))
    there = F.col("phase").isin("ANTICIPATION", "ACTION", "HERO", "REACTION", "FINAL_HERO") & (F.col("first_frame") <= F.col("end_frame")) & (F.col("last_moving") >= F.col("start_frame"))
    return s.select("video_id", "start_frame", "end_frame", "phase", "shot", "camera",
                    bound(F.when(back, F.col("crop") - delta).otherwise(F.col("crop"))).alias("crop_start"),
                    bound(F.when(back, F.col("crop")).otherwise(F.col("crop") - delta)).alias("crop_end"),
                    (F.col("start_frame") / 30.0).alias("start_seconds"), ((F.col("end_frame") + 1) / 30.0).alias("end_seconds"),
                    F.when(there, F.col("track_id")).alias("subject"))


SPEEDS = OWNED + f""",
backed AS (SELECT s.video_id, s.start_frame, s.end_frame, s.phase, b.confidence, m.lo, m.hi, m.easing AS easing0, m.behaviour AS behaviour0,
  m.needs_event AND b.video_id IS NOT NULL AS supported
  FROM segs s JOIN dim m USING (phase) LEFT JOIN (SELECT e.video_id, score AS confidence FROM moments e JOIN best USING (video_id, track_id)) b ON s.video_id = b.video_id),
chosen2 AS (SELECT * REPLACE (CASE WHEN supported THEN lo ELSE 1.0 END AS lo, CASE WHEN supported THEN hi ELSE 1.0 END AS hi),
  CASE WHEN supported THEN behaviour0 ELSE 'NORMAL' END AS behaviour, CASE WHEN supported THEN easing0 ELSE 'linear' END AS easing FROM backed),
speeds AS (SELECT video_id, start_frame, end_frame, phase, behaviour, easing,
  CASE behaviour WHEN 'NORMAL' THEN 'NO_SPEED_EVIDENCE' WHEN 'SLIGHT_FAST' THEN 'RHYTHM_BUILD_UP' WHEN 'ANTICIPATION_SLOW' THEN 'EVENT_ANTICIPATION_LINKED'
    WHEN 'HERO_SLOW' THEN 'HERO_EVENT_LINKED' ELSE 'EVENT_RECOVERY_LINKED' END AS reason,
  CASE WHEN behaviour <> 'NORMAL' THEN 'TEMPORAL_RESAMPLE_NO_RIFE' END AS fallback,
  CASE behaviour WHEN 'ANTICIPATION_SLOW' THEN hi WHEN 'HERO_SLOW' THEN hi ELSE lo END AS start_factor,
  CASE behaviour WHEN 'ANTICIPATION_SLOW' THEN lo WHEN 'HERO_SLOW' THEN hi + (lo - hi) * greatest(0.0, least(1.0, confidence)) ELSE hi END AS end_factor
  FROM chosen2)"""


def speeds_of(spark, d):
    """A motion event of the video's hero supports the phases about it, and its score says how slow the hero moment gets."""
    best = ev.rank_heroes(signals_of(spark, d), 1)  # of motion events
    events = best.select("video_id", F.col("score").alias("confidence"), F.lit(True).alias("event"))
    segments = segments_of(spark, d).join(events, "video_id", "left")
    return tl.with_speed(segments, tl.phase_table(spark), F.col("confidence"), F.col("event"))


@query("q46_speed_curve", f"""WITH {OBS}, {SPEEDS},
mid AS (SELECT *, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS t FROM speeds)
SELECT video_id, start_frame, phase, behaviour, easing, reason, fallback, t,
  {r6("start_factor + (end_factor - start_factor) * CASE easing WHEN 'in' THEN t * t WHEN 'out' THEN 1.0 - (1.0 - t) * (1.0 - t) WHEN 'in_out' THEN t * t * (3.0 - 2.0 * t) ELSE t END")} AS factor FROM mid""")
def q46(spark, d):
    s = speeds_of(spark, d).withColumn("t", F.explode(F.array(*(F.lit(t) for t in (0.0, 0.25, 0.5, 0.75, 1.0)))))
    factor = F.col("start_factor") + (F.col("end_factor") - F.col("start_factor")) * tl.eased(F.col("t"), F.col("easing"))
    return s.select("video_id", "start_frame", "phase", "behaviour", "easing", "reason", "fallback", "t", fixed(factor).alias("factor"))


TURNS = """
near2 AS (SELECT s.video_id, s.start_frame, min(abs(m.frame - s.start_frame)) AS off FROM segs s JOIN marks m USING (video_id) GROUP BY s.video_id, s.start_frame),
seq AS (SELECT s.video_id, s.start_frame, s.phase, n.off, lag(s.phase) OVER w AS prev, lead(s.phase) OVER w AS nxt
  FROM segs s LEFT JOIN near2 n ON s.video_id = n.video_id AND s.start_frame = n.start_frame WINDOW w AS (PARTITION BY s.video_id ORDER BY s.start_frame)),
turns AS (SELECT video_id, start_frame, phase, CASE WHEN prev IS NULL THEN 'FADE_IN' WHEN off <= 3 THEN 'HARD_CUT' WHEN prev = 'ANTICIPATION' AND phase = 'HERO' THEN 'DISSOLVE'
  ELSE 'HARD_CUT' END AS transition_in, CASE WHEN nxt IS NULL THEN 'FADE_OUT' END AS transition_out FROM seq)"""


@query("q46b_transitions", f"WITH {OBS}, {OWNED}, {MARKS}, {TURNS} SELECT * FROM turns")
def q46b(spark, d):
    return tl.transitions(segments_of(spark, d), boundaries_of(spark, d)).select("video_id", "start_frame", "phase", "transition_in", "transition_out")


def _budget(total):
    """Passes over the segments, one after the other."""
    return SPEEDS + f""",
shares AS (SELECT *, end_frame - start_frame + 1 AS n, (end_frame - start_frame + 1) / greatest(0.55::DOUBLE, least(1.15::DOUBLE, (start_factor + end_factor) / 2)) AS weight FROM speeds),
ideals AS (SELECT *, {total}.0::DOUBLE * weight / sum(weight) OVER (PARTITION BY video_id) AS ideal, ceil(n / 1.15::DOUBLE)::BIGINT AS lo, floor(n / 0.55::DOUBLE)::BIGINT AS hi FROM shares),
bases AS (SELECT video_id, phase, start_frame, end_frame, n, lo, hi, least(hi, greatest(lo, floor(ideal)::BIGINT)) AS got,
  row_number() OVER (PARTITION BY video_id ORDER BY {r6('ideal - floor(ideal)', 9)} DESC, start_frame) AS place, count(*) OVER (PARTITION BY video_id) AS of_ FROM ideals),
passes AS (
  SELECT *, {total} - (sum(got) OVER (PARTITION BY video_id))::BIGINT AS rest, 0 AS pass FROM bases
  UNION ALL
  SELECT video_id, phase, start_frame, end_frame, n, lo, hi, got + step, place, of_, rest - (sum(step) OVER (PARTITION BY video_id))::BIGINT, pass + 1 FROM (
    SELECT *, CASE WHEN able AND turn <= abs(rest) THEN sign(rest)::BIGINT ELSE 0 END AS step FROM (
      SELECT *, sum(CASE WHEN able THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY place) AS turn FROM (
        SELECT *, (rest > 0 AND got < hi) OR (rest < 0 AND got > lo) AS able FROM passes WHERE rest <> 0 AND pass < 20 * of_ + 20)))),
allotted AS (SELECT video_id, phase, start_frame, end_frame, n, got AS out_frames, rest = 0 AS preserved FROM passes
  QUALIFY pass = max(pass) OVER (PARTITION BY video_id))"""


BUDGET = _budget(TOTAL)


@query("q30_budget_allocation", f"WITH RECURSIVE {OBS}, {BUDGET} SELECT * FROM allotted")
def q30(spark, d):
    return tl.budget(speeds_of(spark, d), TOTAL)


@query("q30d_budget_at_bounds", f"""WITH RECURSIVE {OBS}, {_budget(650)} SELECT * FROM allotted""")
def q30d(spark, d):
    """Fewer frames than the source has, so that the bounds of speed bind."""
    return tl.budget(speeds_of(spark, d), 650)


@query("q30e_budget_beyond_bounds", f"""WITH RECURSIVE {OBS}, {_budget(1400)} SELECT * FROM allotted""")
def q30e(spark, d):
    """More frames than the bounds let be made."""
    return tl.budget(speeds_of(spark, d), 1400)


@query("q30b_frame_map", f"""WITH RECURSIVE {OBS}, {BUDGET}, {MARKS},
laid AS (SELECT *, coalesce(sum(out_frames) OVER (PARTITION BY video_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM allotted),
ks AS (SELECT *, unnest(range(0, out_frames)) AS k FROM laid),
pos AS (SELECT *, CASE WHEN out_frames <= 1 OR n <= 1 THEN 0.0 ELSE greatest(0.0, least(n - 1.0::DOUBLE, (k + 0.5::DOUBLE) * n / out_frames - 0.5::DOUBLE)) END AS pos FROM ks),
low1 AS (SELECT *, start_frame + floor(pos)::BIGINT AS src_frame, pos - floor(pos) AS share FROM pos),
low2 AS (SELECT *, CASE WHEN share < 1e-6 OR out_frames < n THEN src_frame ELSE least(src_frame + 1, end_frame) END AS src_next FROM low1)
SELECT video_id, (before_ + k)::BIGINT AS out_frame, src_frame, src_next,
  {r6('''CASE WHEN src_next = src_frame
    OR EXISTS (SELECT 1 FROM marks m WHERE m.video_id = low2.video_id AND m.frame > low2.src_frame AND m.frame <= low2.src_next) THEN 0.0 ELSE share END''')} AS blend, phase FROM low2""")
def q30b(spark, d):
    return tl.frame_map(tl.budget(speeds_of(spark, d), TOTAL), boundaries_of(spark, d))


@query("q75_frame_weights", f"""WITH RECURSIVE {OBS}, {BUDGET}, {MARKS}, {TURNS},
seen5 AS (SELECT *, greatest(1, out_frames) AS m FROM allotted),
laid AS (SELECT s.*, u.transition_in, u.transition_out, coalesce(sum(m) OVER (PARTITION BY s.video_id ORDER BY s.start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM seen5 s JOIN turns u ON s.video_id = u.video_id AND s.start_frame = u.start_frame),
each5 AS (SELECT *, unnest(range(0, m)) AS k FROM laid),
timed5 AS (SELECT *, CASE WHEN m > 1 THEN k / (m - 1)::DOUBLE ELSE 0.0 END AS t FROM each5)
SELECT video_id, before + k AS out_frame, phase,
  {r6("CASE WHEN transition_in = 'FADE_IN' THEN greatest(0.0, 1.0 - t * (12.0::DOUBLE / n)) ELSE 1.0 END * CASE WHEN transition_out = 'FADE_OUT' THEN greatest(0.0, 1.0 - (1.0 - t) * (12.0::DOUBLE / n)) ELSE 1.0 END")} AS light,
  CASE WHEN transition_in = 'DISSOLVE' AND k = 0 AND before > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS previous FROM timed5""")
def q75(spark, d):
    speeds = cut_lineage(tl.transitions(speeds_of(spark, d), boundaries_of(spark, d)), "turns")
    return tl.frame_weights(tl.budget(speeds, TOTAL), speeds)


@query("q30c_needed_frames", f"""WITH RECURSIVE {OBS}, {BUDGET},
laid AS (SELECT *, unnest(range(0, out_frames)) AS k FROM allotted),
low1 AS (SELECT *, CASE WHEN out_frames <= 1 OR n <= 1 THEN 0.0 ELSE greatest(0.0, least(n - 1.0::DOUBLE, (k + 0.5::DOUBLE) * n / out_frames - 0.5::DOUBLE)) END AS pos FROM laid)
SELECT video_id, start_frame + floor(pos)::BIGINT AS frame FROM low1
UNION SELECT video_id, least(start_frame + floor(pos)::BIGINT + 1, end_frame) FROM low1 WHERE pos - floor(pos) >= 1e-6 AND out_frames >= n""")
def q30c(spark, d):
    """The source frames that a frame map needs, each once: a row's frame and the next one, without a second run of the plan."""
    return q30b(spark, d).select("video_id", F.explode(F.array_distinct(F.array("src_frame", "src_next"))).alias("frame")).distinct()


@query("q37_reframe_selection", f"""WITH {OBS}, {SUBJECTS}
SELECT v.video_id, coalesce(b.track_id, l.track_id) AS track_id, CASE WHEN b.track_id IS NOT NULL THEN 'PREFERRED' ELSE 'LONGEST' END AS reason
FROM (SELECT DISTINCT video_id FROM obs) v LEFT JOIN best b USING (video_id)
LEFT JOIN (SELECT video_id, track_id FROM (SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, track_id DESC) AS rn
  FROM obs GROUP BY video_id, track_id) WHERE rn = 1) l USING (video_id)""")
def q37(spark, d):
    obs = src.observations(spark, d)
    longest = obs.groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.max_by("track_id", F.struct("n", "track_id")).alias("longest"))
    preferred = ev.rank_heroes(signals_of(spark, d), 1).select("video_id", "track_id")
    return longest.join(preferred, "video_id", "left").select(
        "video_id", F.coalesce("track_id", "longest").alias("track_id"), F.when(F.col("track_id").isNotNull(), "PREFERRED").otherwise("LONGEST").alias("reason"))


CAMERA = SUBJECTS + """,
ev AS (SELECT m.video_id, m.start_frame + 60 AS a0, m.end_frame - 60 AS z0 FROM moments m JOIN best b USING (video_id, track_id)),
mine AS (SELECT o.video_id, o.frame, o.cx FROM obs o JOIN best b USING (video_id, track_id)),
span1 AS (SELECT m.video_id, min(m.frame) AS first_frame, greatest(min(m.frame), max(e.a0)) AS a1, least(max(m.frame), max(e.z0)) AS z1 FROM mine m JOIN ev e USING (video_id) GROUP BY m.video_id),
span2 AS (SELECT video_id, first_frame, least(a1, z1) AS a, greatest(a1, z1) AS z FROM span1),
planned AS (SELECT *, unnest(range(least(a, greatest(first_frame, a - 30)), z + 55)) AS frame FROM span2),
joined3 AS (SELECT coalesce(p.video_id, m.video_id) AS video_id, coalesce(p.frame, m.frame) AS frame, m.cx,
    CASE WHEN p.frame IS NULL THEN 'track' WHEN p.frame > z + 24 THEN 'celebration' WHEN p.frame > z THEN 'reaction' WHEN p.frame >= a THEN 'hero_moment' ELSE 'anticipation' END AS phase
  FROM planned p FULL JOIN mine m ON p.video_id = m.video_id AND p.frame = m.frame),
cameras AS (SELECT video_id, frame, phase, coalesce(last_value(cx IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(cx IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS target_x FROM joined3)"""


def camera_of(spark, d):
    obs = src.observations(spark, d)
    best = ev.rank_heroes(signals_of(spark, d), 1).select("video_id", "track_id")
    event = ev.motion_events(obs).join(best, ["video_id", "track_id"]).select("video_id", (F.col("start_frame") + 60).alias("start_frame"), (F.col("end_frame") - 60).alias("end_frame"))
    return tl.camera_phases(obs.join(best, ["video_id", "track_id"], "left_semi"), event)


@query("q38_camera_phases", f"WITH {OBS}, {CAMERA} SELECT * FROM cameras")
def q38(spark, d):
    return camera_of(spark, d)


@query("q38b_phase_summary", f"""WITH {OBS}, {CAMERA},
moves AS (SELECT *, abs(target_x - lag(target_x) OVER (PARTITION BY video_id ORDER BY frame)) AS move FROM cameras)
SELECT m.video_id, m.phase, count(*) AS frames, max(t.most) AS max_step FROM moves m
JOIN (SELECT video_id, {r6('coalesce(max(move), 0.0)', 3)} AS most FROM moves GROUP BY video_id) t USING (video_id) GROUP BY m.video_id, m.phase""")
def q38b(spark, d):
    return tl.camera_summary(camera_of(spark, d))


@query("q38c_clamped_targets", f"""WITH {OBS} SELECT video_id, track_id, frame, least({WIDTH - CROP / 2}::DOUBLE, greatest({CROP / 2}::DOUBLE, cx)) AS target_x FROM obs""")
def q38c(spark, d):
    return tl.clamp_targets(src.observations(spark, d), CROP, WIDTH).select("video_id", "track_id", "frame", "target_x")


FRAG_VIEWS = src.FRAG_ROWS[src.FRAG_ROWS.index("marked AS ("):] + """,
frags AS (SELECT video_id, fragment_id AS track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, avg(w) <= 90 AND avg(h) <= 140 AS person_sized
  FROM frows GROUP BY video_id, fragment_id)"""
POST = CONTEXTS + """,
post AS (
  SELECT * FROM (SELECT c.video_id, c.context, c.start_frame, c.end_frame, r.track_id, least(r.last_frame, c.end_frame) - r.first_frame + 1 AS overlap,
    row_number() OVER (PARTITION BY c.video_id, c.context ORDER BY least(r.last_frame, c.end_frame) - r.first_frame DESC, r.last_frame - r.first_frame DESC, r.track_id) AS rn
  FROM contexts c JOIN frags r ON c.video_id = r.video_id AND r.first_frame BETWEEN c.start_frame AND c.end_frame WHERE c.context > 1 AND r.person_sized) WHERE rn = 1)"""


def fragments_as_tracks(spark, d):
    """About cuts, subjects are fragments: tracks here run through all of a video."""
    return fragments_of(spark, d)[1].drop("track_id").withColumnRenamed("fragment_id", "track_id")


@query("q39_post_cut_candidate", f"WITH {OBS}, {FRAG_VIEWS}, {POST} SELECT video_id, context, start_frame, end_frame, track_id, overlap FROM post")
def q39(spark, d):
    rows = fragments_as_tracks(spark, d)
    ranges = tr.track_ranges(rows).join(tr.person_sized(rows), ["video_id", "track_id"])
    return tl.post_cut_candidate(contexts_of(spark, d), ranges)


# ---- subjects and identities about cuts: fragments, and the lineages that they belong to

RELATED = HERO_SQL + ", " + CONTEXTS[CONTEXTS.index("spine AS ("):] + f""",
fmv AS (SELECT video_id, fragment_id AS track_id, min(frame) AS mf, coalesce(max(frame) FILTER (moved), min(frame)) AS last_moving, max(frame) AS last_frame, count(*) AS n, avg(w) <= 90 AND avg(h) <= 140 AS person_sized FROM (
  SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) > 1e-3 AS moved FROM frows WINDOW w AS (PARTITION BY video_id, fragment_id ORDER BY frame))
  GROUP BY video_id, fragment_id),
sizes AS (SELECT video_id, head, count(*) AS members FROM walk GROUP BY video_id, head),
keys AS (SELECT w.video_id, w.node AS track_id, coalesce(h.hero_fragment, w.head) AS key FROM walk w JOIN sizes s USING (video_id, head)
  LEFT JOIN hero h ON w.video_id = h.video_id AND w.node = h.node WHERE s.members > 1 OR h.node IS NOT NULL),
picked AS (SELECT c.video_id, c.context, m.track_id, row_number() OVER (PARTITION BY c.video_id, c.context ORDER BY coalesce(m.track_id = f.hero_fragment, false) DESC,
    least(m.last_moving, c.end_frame) - greatest(m.mf, c.start_frame) DESC, m.track_id) AS rn
  FROM contexts c JOIN fmv m ON c.video_id = m.video_id AND m.mf <= c.end_frame AND m.last_moving >= c.start_frame
  LEFT JOIN first f ON c.video_id = f.video_id WHERE coalesce(m.track_id = f.hero_fragment, false) OR m.person_sized),
named AS (SELECT c.*, p.track_id AS subject, k.key FROM contexts c LEFT JOIN (SELECT * FROM picked WHERE rn = 1) p USING (video_id, context)
  LEFT JOIN keys k ON p.video_id = k.video_id AND p.track_id = k.track_id),
before2 AS (SELECT *, lag(key) OVER (PARTITION BY video_id ORDER BY context) AS prev FROM named),
related AS (SELECT *, CASE WHEN prev IS NULL OR key IS NULL THEN 'UNKNOWN' WHEN prev = key THEN 'SAME_CANONICAL_IDENTITY' ELSE 'NEW_IDENTITY' END AS relation FROM before2)"""


def related_of(spark, d):
    """Contexts with their subject (a fragment) and how its identity relates to that before; and the fragments' rows."""
    rows = fragments_as_tracks(spark, d)

    def build():
        hero, members, _, _, _ = hero_lineage(spark, d)
        hero = hero.select("video_id", F.col("hero_fragment").alias("node")).distinct()
        moving = tr.moving_ranges(rows).join(tr.person_sized(rows), ["video_id", "track_id"])
        subjects = sc.primary_subjects(contexts_of(spark, d), moving, hero.select("video_id", F.col("node").alias("track_id")))
        keys = co.identity_keys(members, hero).select("video_id", F.col("node").alias("track_id"), "key")
        return sc.relations(subjects, keys)

    return shared(spark, "related", [f"{d}/events.parquet", f"{d}/embeddings.parquet"], build), rows


@query("q34_identity_relation", f"WITH RECURSIVE {RELATED} SELECT video_id, context, subject, key, relation FROM related")
def q34(spark, d):
    return related_of(spark, d)[0].select("video_id", "context", "subject", "key", "relation")


EVIDENCE = RELATED + f""",
known AS (SELECT c.video_id, c.context, c.start_frame, c.end_frame, c.subject AS track_id, c.relation, m.track_id IS NOT NULL AS there, m.mf, m.last_moving, m.last_frame, m.n, m.person_sized
  FROM related c LEFT JOIN fmv m ON c.video_id = m.video_id AND c.subject = m.track_id WHERE c.context > 1),
evidence AS (SELECT video_id, context, start_frame, end_frame, track_id, relation,
    CASE WHEN there THEN greatest(0, least(last_frame, end_frame) - greatest(mf, start_frame) + 1) ELSE 0 END AS overlap,
    there AND last_frame >= start_frame AND mf <= end_frame AS present, there AND person_sized AS person_sized,
    CASE WHEN there THEN greatest(0, least(last_moving, end_frame) - greatest(mf, start_frame) + 1) ELSE 0 END AS moving_frames,
    CASE WHEN there THEN last_frame - mf + 1 ELSE 0 END AS track_frames,
    CASE WHEN there THEN {r6('least(1.0::DOUBLE, n / (last_frame - mf + 1)::DOUBLE)', 4)} ELSE 0.0 END AS continuity
  FROM known),
near3 AS (SELECT e.video_id, e.context, min(sqrt((r.cx - b.bx) ** 2 + (r.cy - b.by_) ** 2)) AS ball_distance
  FROM evidence e JOIN frows r ON e.video_id = r.video_id AND e.track_id = r.fragment_id AND r.frame BETWEEN e.start_frame AND e.end_frame
  JOIN balls b ON b.video_id = e.video_id AND b.frame = r.frame GROUP BY e.video_id, e.context),
gates AS (SELECT e.*, n.ball_distance, EXISTS (SELECT 1 FROM balls b WHERE b.video_id = e.video_id) AS played FROM evidence e LEFT JOIN near3 n USING (video_id, context)),
gated AS (SELECT *, CASE WHEN end_frame - start_frame + 1 < 12 THEN 'CONTEXT_TOO_SHORT' WHEN NOT present THEN 'NO_PERSON_SIZED_SUBJECT'
    WHEN NOT person_sized THEN 'DOMINANT_BLOB_NOT_PERSON_SIZED'
    WHEN moving_frames >= 20 AND track_frames >= 30 AND (NOT played OR ball_distance IS NULL OR ball_distance <= 260) THEN 'STRONG_HERO_EVIDENCE'
    WHEN moving_frames >= 6 AND (NOT played OR (ball_distance IS NOT NULL AND ball_distance <= 260)) THEN 'REACTION_EVIDENCE'
    WHEN track_frames >= 18 AND moving_frames >= 6 THEN 'CELEBRATION_EVIDENCE' ELSE 'WEAK_SUBJECT_EVIDENCE' END AS reason FROM gates),
ruled AS (SELECT *, CASE reason WHEN 'CONTEXT_TOO_SHORT' THEN 'OMITTED' WHEN 'NO_PERSON_SIZED_SUBJECT' THEN 'CUTAWAY' WHEN 'DOMINANT_BLOB_NOT_PERSON_SIZED' THEN 'CUTAWAY'
    WHEN 'STRONG_HERO_EVIDENCE' THEN CASE WHEN relation = 'SAME_CANONICAL_IDENTITY' THEN 'FINAL_HERO' ELSE 'HERO' END WHEN 'REACTION_EVIDENCE' THEN 'REACTION'
    WHEN 'CELEBRATION_EVIDENCE' THEN 'CELEBRATION' ELSE 'SECONDARY' END AS phase FROM gated)"""


def gated_of(spark, d):
    related, rows = related_of(spark, d)
    chosen = related.where("context > 1").select("video_id", "context", "start_frame", "end_frame", F.col("subject").alias("track_id"))
    found = tl.subject_evidence(chosen, tr.moving_ranges(rows), tr.track_stats(rows), tr.person_sized(rows))
    balls = ev.ball_centres(src.observations(spark, d), src.BALL)
    return found, tl.post_cut_gate(found, tl.ball_distance_in(found, rows, balls), balls, related)


@query("q39b_subject_evidence", f"WITH RECURSIVE {EVIDENCE} SELECT * EXCLUDE (relation) FROM evidence")
def q39b(spark, d):
    return gated_of(spark, d)[0]


@query("q40_post_cut_gate", f"""WITH RECURSIVE {EVIDENCE}
SELECT video_id, context, track_id, {r6('ball_distance', 3)} AS ball_distance, phase, reason FROM ruled""")
def q40(spark, d):
    return gated_of(spark, d)[1].select("video_id", "context", "track_id", fixed(F.col("ball_distance"), 3).alias("ball_distance"), "phase", "reason")


@query("q72_post_cut_segments", f"""WITH RECURSIVE {EVIDENCE}
SELECT video_id, context, start_frame, end_frame, CASE WHEN phase = 'OMITTED' THEN 'CUTAWAY' ELSE phase END AS phase, phase = 'OMITTED' AS filled, reason FROM ruled""")
def q72(spark, d):
    return tl.post_cut_segments(gated_of(spark, d)[1])


@query("q73_plan_without_hero", f"""WITH {OBS}
SELECT video_id, unnest([0, 30])::BIGINT AS start_frame, unnest([29, {FRAMES - 1}])::BIGINT AS end_frame, unnest(['HOOK', 'OUTRO']) AS phase FROM (SELECT DISTINCT video_id FROM obs)""")
def q73(spark, d):
    return tl.without_hero(src.observations(spark, d).select("video_id").distinct(), FRAMES)


PLAN = EVIDENCE + ", " + _after(BEATS, "rawspeed") + ", " + DIM + """,
mv AS (SELECT video_id, track_id, min(frame) AS first_frame, coalesce(max(frame) FILTER (moved), min(frame)) AS last_moving, max(frame) AS last_frame FROM (
  SELECT *, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) > 1e-3 AS moved FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
  GROUP BY video_id, track_id), """ + _after(OWNED, "hh") + f""", {MARKS},
backed2 AS (SELECT video_id FROM h7 JOIN stats t USING (video_id, track_id) WHERE t.mean_w <= 90 AND t.mean_h <= 140),
directed AS (SELECT video_id, start_frame, end_frame, phase FROM segs WHERE video_id IN (SELECT video_id FROM backed2)
  UNION ALL SELECT video_id, unnest([0, 30])::BIGINT, unnest([29, {FRAMES - 1}])::BIGINT, unnest(['HOOK', 'OUTRO'])
  FROM (SELECT DISTINCT video_id FROM obs WHERE video_id NOT IN (SELECT video_id FROM backed2))),
edges3 AS (SELECT video_id, phase, start_frame AS seg, start_frame, end_frame FROM directed
  UNION SELECT s.video_id, s.phase, s.start_frame, m.frame, s.end_frame FROM directed s JOIN marks m ON s.video_id = m.video_id AND m.frame > s.start_frame AND m.frame <= s.end_frame),
parts3 AS (SELECT video_id, phase, seg, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY video_id, seg ORDER BY start_frame) - 1, end_frame) AS end_frame, end_frame AS whole_end FROM edges3),
fine3 AS (SELECT *, min(end_frame - start_frame + 1) OVER (PARTITION BY video_id, seg) >= 12 AS fine FROM parts3),
split3 AS (SELECT video_id, phase, CASE WHEN fine THEN start_frame ELSE seg END AS start_frame, CASE WHEN fine THEN end_frame ELSE whole_end END AS end_frame FROM fine3 WHERE fine OR start_frame = seg),
after3 AS (SELECT video_id, start_frame, end_frame, CASE WHEN phase = 'OMITTED' THEN 'CUTAWAY' ELSE phase END AS phase FROM ruled WHERE video_id IN (SELECT video_id FROM backed2)),
cut3 AS (SELECT video_id, max(start_frame) AS cut FROM after3 GROUP BY video_id),
tried AS (SELECT s.video_id, s.start_frame, least(s.end_frame, c.cut - 1) AS end_frame, s.phase FROM split3 s JOIN cut3 c USING (video_id) WHERE s.start_frame < c.cut UNION ALL SELECT * FROM after3),
good AS (SELECT video_id FROM (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame), -1) + 1 = start_frame AS joined FROM tried)
  GROUP BY video_id HAVING bool_and(joined) AND max(end_frame) = {FRAMES - 1})"""


@query("q74_plan_assembly", f"""WITH RECURSIVE {PLAN}
SELECT *, true AS replaced FROM tried WHERE video_id IN (SELECT video_id FROM good)
UNION ALL SELECT video_id, start_frame, end_frame, phase, false FROM split3 WHERE video_id NOT IN (SELECT video_id FROM good)""")
def q74(spark, d):
    """Whole plans: about a person-sized hero, with what the gate makes of the contexts after cuts; else without a hero."""
    obs = src.observations(spark, d)
    persons = tr.person_sized(obs).where("person_sized")
    heroes = heroes_of(spark, d)
    backed = cut_lineage(heroes.join(persons, ["video_id", "track_id"], "left_semi").select("video_id"), "backed")
    directed = segments_of(spark, d, heroes).join(backed, "video_id", "left_semi").select("video_id", "start_frame", "end_frame", "phase")
    bare = tl.without_hero(obs.select("video_id").distinct().join(backed, "video_id", "left_anti"), FRAMES)
    split = tl.split_at_cuts(directed.unionByName(bare), boundaries_of(spark, d)).drop("kept_whole")
    after = tl.post_cut_segments(gated_of(spark, d)[1]).join(backed, "video_id", "left_semi")
    return tl.plan_segments(cut_lineage(split, "split"), cut_lineage(after, "after"), FRAMES)
