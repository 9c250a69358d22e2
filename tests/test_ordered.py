"""As-of joins, sweeps over intervals, blocked scans and nearest points against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import asof, continuity, scans, scene, spatial, timeline

OBS = "video_id long, track_id long, frame long, cx double, cy double, confidence double, class_name string"


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 3])
def test_as_of_matches_brute_force(spark, direction, tolerance):
    rng = random.Random(1)
    left = [(k, rng.choice((None, *range(60))), i) for i, k in enumerate(rng.choice((1, 2, 3)) for _ in range(120))]
    right = [(rng.choice((1, 2)), rng.choice((None, *range(0, 60, 4))), rng.randrange(9)) for _ in range(40)]

    def brute(k, t):
        held = [(u, v) for key, u, v in right if key == k and u is not None and t is not None and (tolerance is None or abs(u - t) <= tolerance)]
        held = [(u, v) for u, v in held if direction == "nearest" or (u <= t if direction == "backward" else u >= t)]
        return min(held, key=lambda m: (abs(m[0] - t), m[0], -m[1]), default=None)

    got = asof.as_of(spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, t long, v long"), ["k"], "t", ["v"], direction, tolerance)
    assert got.columns == ["k", "t", "id", "match"]
    assert sorted((r.id, r.match and tuple(r.match)) for r in got.collect()) == sorted((i, brute(k, t)) for k, t, i in left)
    with pytest.raises(ValueError, match="sideways"):
        asof.as_of(got, got, ["k"], "t", [], "sideways")


def test_covering_takes_the_first_interval_that_holds_a_point(spark):
    rng = random.Random(2)
    spans = [(rng.choice((1, 2)), a, a + rng.randrange(-1, 25), i) for i, a in enumerate(rng.randrange(60) for _ in range(24))]
    points = [(k, f) for k in (1, 2, 3) for f in range(90)]
    got = asof.covering(spark.createDataFrame(points, "k long, f long"), spark.createDataFrame(spans, "k long, a long, z long, i long"), ["k"], "f", "a", "z", ["i"])
    want = {(k, f): min(((a, i) for key, a, z, i in spans if key == k and a <= f <= z), default=(None, None))[1] for k, f in points}
    assert {(r.k, r.f): r.match and r.match.i for r in got.collect()} == want
    frames = spark.createDataFrame(points, "video_id long, frame long")
    held = spark.createDataFrame(spans, "video_id long, first_frame long, last_frame long, member long")
    assert {(r.video_id, r.frame): r.member for r in continuity.active_at(frames, held).collect()} == want


@pytest.mark.parametrize("block", [2, 5, 64])
def test_affine_scan_spans_blocks(spark, block):
    """A series over many blocks, with gaps, a single row and one that begins late; every map has its own coefficients."""
    rng = random.Random(block)
    rows = [(k, t, round(rng.uniform(-5, 5), 3), rng.choice((0.0, 1.0, 0.65, -0.5))) for k, places in (("x", rng.sample(range(600), 200)), ("y", [7]), ("z", range(400, 420))) for t in places]
    got = scans.affine_scan(spark.createDataFrame(rows, "k string, t long, a double, b double"), ["k"], "t", F.col("a"), F.col("b"), block).collect()
    want, value = {}, {}
    for k, t, a, b in sorted(rows):
        before = value.get(k, 0.0)
        value[k] = a + b * before
        want[k, t] = before, value[k]
    assert len(got) == len(rows)
    for r in got:
        assert (r.before, r.after) == pytest.approx(want[r.k, r.t], abs=1e-9)
    empty = spark.createDataFrame([], "k string, t long, a double, b double")
    assert scans.affine_scan(empty, ["k"], "t", F.col("a"), F.col("b")).count() == 0


def test_shot_smoothing_over_three_blocks(spark):
    rng = random.Random(4)
    obs = [(0, t, f, rng.uniform(0, 100), 0.0, 0.9, "view") for t in (1, 2) for f in rng.sample(range(200), 150)]
    shots = [(0, 0, "FADE_IN"), (0, 40, "HARD_CUT"), (0, 90, "DISSOLVE"), (0, 150, "HARD_CUT"), (0, 199, "DISSOLVE")]
    got = scans.shot_smoothing(spark.createDataFrame(obs, OBS), spark.createDataFrame(shots, "video_id long, start_frame long, transition_in string")).collect()
    want = {}
    for t in (1, 2):
        y = shot = None
        for _, _, f, x, *_ in sorted(o for o in obs if o[1] == t):
            own = max(s for s in shots if s[1] <= f)
            if y is None or (own != shot and own[2] == "HARD_CUT"):
                y = x
            elif own == shot:
                y = 0.35 * x + 0.65 * y
            shot = own
            want[t, f] = y
    assert {(r.track_id, r.frame) for r in got} == set(want)
    for r in got:
        assert r.smooth_x == pytest.approx(want[r.track_id, r.frame], abs=1e-9)


def test_track_targets_hold_on_both_sides(spark):
    obs = spark.createDataFrame([(0, 7, f, float(f), 1.0, 0.9, "view") for f in (3, 5, 6)] + [(0, 8, 4, 9.0, 9.0, 0.9, "view")], OBS)
    spans = spark.createDataFrame([(0, 7, 1, 8), (0, 99, 1, 2)], "video_id long, track_id long, start_frame long, end_frame long")
    identity = spark.createDataFrame([(0, 7, 7, 3, 6), (0, 7, 8, 4, 7)], "video_id long, canonical long, fragment long, first_frame long, last_frame long")
    got = sorted(scene.track_targets(spans, obs, identity).collect(), key=lambda r: r.frame)
    assert [(r.frame, r.cx, r.held, r.fragment, r.identity) for r in got] == [
        (1, 3.0, True, 7, 7), (2, 3.0, True, 7, 7), (3, 3.0, False, 7, 7), (4, 3.0, True, 7, 7), (5, 5.0, False, 7, 7), (6, 6.0, False, 7, 7), (7, 6.0, True, 8, 7),
        (8, 6.0, True, 7, 7)]
    assert scene.track_targets(spans, obs).columns == ["video_id", "track_id", "frame", "cx", "cy", "held"]


def test_cameras_follow_identities(spark):
    rows = spark.createDataFrame([(v, t, f, float(10 * t + f), 0.0, 0.9, "view") for v, t, frames in (
        (1, 5, (1, 2)), (1, 6, (2, 4)), (1, 7, range(9)), (2, 5, (1, 2)), (2, 6, (1,)), (3, 5, (1, 2)), (3, 6, (3, 4)), (3, 1, (9,))) for f in frames], OBS)
    identity = spark.createDataFrame([(1, 5, 5), (1, 5, 6), (2, 5, 5)], "video_id long, canonical long, fragment long")
    told, seen = timeline.follow(rows, identity)
    assert sorted(map(tuple, told.collect())) == [
        (1, 5, "CANONICAL_HERO_IDENTITY", "HERO_IDENTITY_AVAILABLE", 2, 4), (2, 5, "HERO_TRACK", "HERO_TRACK_AVAILABLE", 0, 2), (3, 6, "LONGEST_TRACK", "NO_PREFERRED_TRACK", 0, 2)]
    assert sorted(map(tuple, seen.where("video_id = 1").collect())) == [(1, 1, 51.0), (1, 2, 62.0), (1, 4, 64.0)]


def test_nearest_distance_grows_its_rings(spark):
    """Clustered targets, points far outside, keys without targets, one target many times, values that are no numbers."""
    rng = random.Random(5)
    targets = [(v, rng.gauss(500, 200), rng.gauss(300, 100)) for v in (0, 1) for _ in range(120)] + [(2, 5.0, 5.0)] * 3 + [(4, float("nan"), 1.0), (0, None, 1.0)]
    points = [(v, i, rng.gauss(500, 400 if i % 10 else 40_000), rng.gauss(300, 300)) for v in (0, 1, 2, 3) for i in range(120)]
    points += [(0, 900, None, 1.0), (0, 901, float("nan"), 1.0), (4, 902, 1.0, 1.0)]
    got = spatial.nearest_distance_to(spark.createDataFrame(points, "video_id long, id long, x double, y double"),
                                      spark.createDataFrame(targets, "video_id long, bx double, by double"), "x", "y", "bx", "by")
    found = {(r.video_id, r.id): r.distance for r in got.collect()}
    assert len(found) == len(points)
    for v, i, x, y in points:
        fine = x is not None and x == x
        want = min((math.hypot(x - c, y - d) for w, c, d in targets if w == v and c is not None and c == c), default=None) if fine else None
        assert found[v, i] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_shared_tables_are_built_once_and_again_when_files_change(spark, tmp_path):
    from spanloom.sources.durable import shared

    source, built = f"file://{tmp_path}/source", []

    def build():
        built.append(1)
        return spark.read.parquet(source).groupBy().count()

    spark.range(3).write.parquet(source)
    assert [shared(spark, "count", [source], build).first()[0] for _ in range(3)] == [3, 3, 3] and len(built) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert shared(spark, "count", [source], build).first()[0] == 5 and len(built) == 2


# ---- nested plans

def test_contexts_are_composed_and_survive_json(spark):
    from spanloom.operators import composition

    related = spark.createDataFrame([(1, 1, 0, 99, 5, 5, "UNKNOWN"), (1, 2, 100, 149, 6, 5, "SAME_CANONICAL_IDENTITY"), (1, 3, 150, 199, None, None, "UNKNOWN"), (2, 1, 0, 199, None, None, "UNKNOWN")],
                                    "video_id long, context int, start_frame long, end_frame long, subject long, key long, relation string")
    moving = spark.createDataFrame([(1, 5, 10, 60, 120), (1, 6, 101, 140, 140)], "video_id long, track_id long, first_frame long, last_moving long, last_frame long")
    heroes = spark.createDataFrame([(1, 5)], "video_id long, track_id long")
    events = spark.createDataFrame([(1, "MOTION_5")], "video_id long, event_id string")
    cuts = spark.createDataFrame([(1, 100, 0.8)], "video_id long, frame long, confidence double")
    composed = composition.compose_contexts(related, moving, heroes, events, cuts)
    got = {r.video_id: r.contexts for r in composed.collect()}
    assert [c.shot_context_id for c in got[1]] == ["SHOT_CONTEXT_01", "SHOT_CONTEXT_02", "SHOT_CONTEXT_03"] and len(got[2]) == 1
    first, second, third = got[1]
    assert (first.active_tracks, first.hero_evidence.present, first.hero_evidence.frozen_tail, first.cut_before, first.cut_after, first.confidence) == ([5], True, True, None, 100, 1.0)
    assert (second.active_tracks, second.hero_evidence.present, second.confidence, second.identity_relation) == ([5, 6], False, 0.8, "SAME_CANONICAL_IDENTITY")
    assert second.evidence == ["frames:100-149", "hero_event:MOTION_5", "cut_before:100", "cut_after:150", "track:6", "identity_relation:SAME_CANONICAL_IDENTITY"]
    assert (third.active_tracks, third.primary_subject, third.confidence, third.cut_after, third.duration_s) == ([], None, 0.0, None, 1.6667)
    assert got[2][0].hero_evidence.hero_track is None and not got[2][0].event_evidence.present
    back = composition.from_journal(composition.to_journal(composed))
    assert {r.video_id: r.contexts for r in back.collect()} == got


def test_shots_say_what_they_follow(spark):
    from spanloom.operators import composition

    segments = spark.createDataFrame([(1, "HOOK", 0, 29, "NORMAL", 1.0, 1.0, "linear"), (1, "HERO", 30, 59, "HERO_SLOW", 0.76, 0.6, "in_out"), (1, "HERO", 60, 89, "NORMAL", 1.0, 1.0, "linear"),
                                      (1, "CUTAWAY", 90, 99, "NORMAL", 1.0, 1.0, "linear")],
                                     "video_id long, phase string, start_frame long, end_frame long, behaviour string, start_factor double, end_factor double, easing string")
    heroes = spark.createDataFrame([(1, 7, 20, 50, "MOTION_7")], "video_id long, track_id long, first_frame long, last_moving long, event_id string")
    dominant = spark.createDataFrame([(1, 0, 3), (1, 60, 4), (1, 90, 4)], "video_id long, frame long, track_id long")
    cuts = spark.createDataFrame([(1, 60), (1, 70), (1, 90)], "video_id long, frame long")
    (row,) = composition.compose_shots(segments, heroes, dominant, cuts).collect()
    assert [(s.shot_id, s.selected_track, s.camera_reset, s.cut_before, s.cut_after, s.internal_cuts) for s in row.shots] == [
        ("SHOT_001", 3, False, None, None, []), ("SHOT_002", 7, False, None, 60, []), ("SHOT_003", 4, True, 60, 90, [70]), ("SHOT_004", None, True, 90, None, [])]
    assert row.shots[2].evidence == ["frames:60-89", "source_frames:30", "hero_event:MOTION_7", "track:4", "hero_centric:true", "source_cut_boundary", "boundary_layer:REAL_CUT", "cut_before:60",
                                     "cut_after:90", "internal_cut:no_blend;camera_reset", "camera_reset:true", "speed:NORMAL"]
