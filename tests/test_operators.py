"""Operators on small inputs, against brute force or known results."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import expr
from spanloom.operators import checks, continuity, events, records, scene, timeline, tracking, tracks, vectors
from spanloom.sources.tables import fragment_rows, read_json, write_report

OBS = "video_id long, track_id long, frame long, cx double, cy double, confidence double, class_name string"


def series(track, points, video=0):
    return [(video, track, f, float(x), float(y), 0.9, "view") for f, x, y in points]


def test_expressions_keep_nulls_and_round_one_way(spark):
    row = spark.range(1).select(
        expr.clamp(F.lit(None).cast("double")).alias("a"), expr.clamp(F.lit(3.0)).alias("b"), expr.fixed(F.lit(0.0000005)).alias("c"),
        expr.saturate(F.lit(-1.0), 5.0).alias("d"), expr.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e"),
        expr.cosine(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("f"),
        expr.weighted({"x": (F.lit(1.0), 0.5), "y": (F.lit(None).cast("double"), 0.5)}).alias("g"),
        expr.first_tag(F.array(F.lit("x:1"), F.lit("track:9"), F.lit("track:4")), "track").alias("h"),
        expr.file_name(F.lit("/a/b/..my  file!.png")).alias("i"), expr.file_name(F.lit("///")).alias("j")).first()
    assert row.asDict() == {"a": None, "b": 1.0, "c": 1e-6, "d": 0.0, "e": None, "f": 1.0, "g": 1.0, "h": "9", "i": "my_file_.png", "j": "upload"}


def test_track_statistics_and_frozen_tail(spark):
    obs = spark.createDataFrame(series(2, [(0, 0, 0), (1, 30, 40), (5, 30, 40)]), OBS)
    stats = tracks.track_stats(obs).first()
    assert (stats.n, stats.span, stats.continuity, stats.displacement) == (3, 6, 0.5, 50.0)
    moving = tracks.moving_ranges(obs).first()
    assert (moving.first_frame, moving.last_moving, moving.last_frame, moving.moving_frames) == (0, 1, 5, 1)
    assert tracks.track_stats(obs.limit(0)).count() == 0


def test_edge_velocity_is_a_median(spark):
    points = [(f, 10 * f, 0) for f in range(20)]
    points[17] = (17, 1000, 0)
    v = tracks.edge_velocity(spark.createDataFrame(series(1, points), OBS), ["video_id", "track_id"]).first()
    assert (v.vx, v.vy, v.samples, v.moving) == (10.0, 0.0, 6, True)
    single = tracks.edge_velocity(spark.createDataFrame(series(1, points[:1]), OBS), ["video_id", "track_id"]).first()
    assert (single.vx, single.samples, single.dispersion, single.moving) == (0.0, 0, 0.75, False)


def test_fragments_split_at_long_gaps(spark):
    rows = fragment_rows(spark.createDataFrame(series(3, [(0, 0, 0), (24, 0, 0), (49, 0, 0)]), OBS)).orderBy("frame").collect()
    assert [r.fragment_id for r in rows] == [3000, 3000, 3001]


def test_motion_events_gate(spark):
    obs = spark.createDataFrame(series(1, [(0, 0, 0), (1, 20, 0), (2, 40, 0)]) + series(2, [(0, 0, 0), (1, 20, 0), (2, 450, 0)]) + series(3, [(0, 0, 0), (9, 99, 0)]), OBS)
    found = events.motion_events(obs).collect()
    assert [(e.track_id, e.peak_frame, e.confidence, e.evidence) for e in found] == [(2, 1, 0.99, ["track:2", "displacement:450.0"])]


def test_hero_ties_go_to_the_later_event_name(spark):
    signals = spark.createDataFrame([(0, 1, "MOTION_18", 0.5, 10, 5.0), (0, 2, "MOTION_9", 0.5, 10, 5.0)],
                                    "video_id long, track_id long, event_id string, score double, persistence_frames long, amplitude_px double")
    assert [r.event_id for r in events.rank_heroes(signals).orderBy("rank").collect()] == ["MOTION_9", "MOTION_18"]


def test_nearest_distance_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [r for t in range(5) for r in series(t, [(f, rng.randrange(100), rng.randrange(100)) for f in sorted(rng.sample(range(60), 9))], t % 2)]
    balls = [(v, f, float(rng.randrange(100)), float(rng.randrange(100))) for v in (0, 1) for f in rng.sample(range(60), 7)]
    got = {r.track_id: r.ball_distance for r in events.nearest_distance(
        spark.createDataFrame(rows, OBS), spark.createDataFrame(balls, "video_id long, frame long, bx double, by double")).collect()}
    for t in range(5):
        own = [r for r in rows if r[1] == t]
        near = [min(own, key=lambda r: (abs(r[2] - f), r[2])) + (x, y) for v, f, x, y in balls if v == t % 2]
        assert got[t] == pytest.approx(min(math.hypot(r[3] - r[7], r[4] - r[8]) for r in near))


def test_nearest_distance_moves_no_pairs_of_balls_and_tracks(spark):
    rows = [r for t in range(300) for r in series(t, [(t % 7, t, 0), (500, t, 9), (500, t, 3)], 0)]
    balls = [(0, f, float(f), 0.0) for f in range(0, 600, 2)] + [(1, 5, 0.0, 0.0)]
    store, quantiles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        found = store.stageList(None, False, False, quantiles, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = written()
    got = {r.track_id: r.ball_distance for r in events.nearest_distance(
        spark.createDataFrame(rows, OBS), spark.createDataFrame(balls, "video_id long, frame long, bx double, by double")).collect()}
    assert sum(n for stage, n in written().items() if stage not in before) < 300 * 20  # 300 tracks, 300 balls in their video
    for t in range(300):  # of two observations in a frame the greater counts
        early = [f for f in range(0, 600, 2) if abs(f - t % 7) <= abs(f - 500)]
        assert got[t] == pytest.approx(min([abs(t - f) for f in early] + [math.hypot(t - f, 9) for f in range(0, 600, 2) if f not in early]))


def test_candidate_pairs_match_a_theta_join(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), i, a := rng.randrange(300), a + rng.randrange(40)) for i in range(80)]
    got = {(r.src, r.tgt, r.gap) for r in continuity.candidate_pairs(spark.createDataFrame(rows, "video_id long, fragment_id long, first_frame long, last_frame long")).collect()}
    assert got == {(a[1], b[1], b[2] - a[3]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and 1 <= b[2] - a[3] <= 45}


def test_candidate_pairs_of_one_crowded_frame_are_shared_among_tasks(spark):
    rows = [(0, i, 0, 10) for i in range(150)] + [(0, i, 20 + i % 2, 90) for i in range(150, 450)] + [(1, 1, 0, 10), (1, 2, 12, None), (1, None, 13, 20), (1, 3, None, 20)]
    pairs = continuity.candidate_pairs(spark.createDataFrame(rows, "video_id long, fragment_id long, first_frame long, last_frame long"))
    got = [(r.video_id, r.src, r.tgt, r.gap, r.at) for r in pairs.withColumn("at", F.spark_partition_id()).collect()]
    assert sorted(r[:4] for r in got) == [(0, a, b, 10 + b % 2) for a in range(150) for b in range(150, 450)] + [(1, 1, 2, 2)]
    assert max(Counter(r[4] for r in got).values()) * 2 < len(got)  # all sources and targets of video 0 meet in one bucket


def test_greedy_matching_and_lineages(spark):
    rng = random.Random(2)
    edges = list({(v, s, s + rng.randrange(1, 6)): (v, s, s + rng.randrange(1, 6), rng.randrange(4) / 4) for v in (0, 1) for s in range(25) for _ in range(3)}.values())
    edges = list({e[:3]: e for e in edges}.values())
    used, want = set(), set()
    for v, s, t, score in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if not {(v, "s", s), (v, "t", t)} & used:
            used |= {(v, "s", s), (v, "t", t)}
            want.add((v, s, t))
    links = continuity.greedy_matching(spark.createDataFrame(edges, "video_id long, src long, tgt long, score double"))
    assert {(r.video_id, r.src, r.tgt) for r in links.collect()} == want
    before = {(v, t): s for v, s, t in want}
    nodes = [(v, n) for v in (0, 1) for n in range(32)]
    def head(v, n):
        while (v, n) in before:
            n = before[v, n]
        return n
    got = continuity.lineages(spark.createDataFrame(nodes, "video_id long, node long"), links)
    assert {(r.video_id, r.node, r.head) for r in got.collect()} == {(v, n, head(v, n)) for v, n in nodes}


def test_link_guards_fire_in_order(spark):
    base = {"gap": 5, "cosine": 0.9, "error": 10.0, "velocity_off": 1.0, "tolerance": 5.0, "a_moving": True, "diagonals": 0.5, "score": 0.8}
    cases = [({}, None), ({"cosine": 0.1, "error": 999.0}, "CONTRADICTORY_APPEARANCE"), ({"cosine": None, "error": 261.0}, "SPATIAL_VELOCITY_CONFLICT"),
             ({"error": 151.0, "velocity_off": 6.0}, "SPATIAL_VELOCITY_CONFLICT"), ({"error": 151.0}, None), ({"diagonals": 3.1}, "PREDICTION_ERROR_TOO_LARGE"),
             ({"diagonals": 3.1, "a_moving": False}, None), ({"score": 0.54}, "BELOW_THRESHOLD"), ({"gap": 46}, "LONG_GAP")]
    rows = [(i, *(base | change).values()) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, gap long, cosine double, error double, velocity_off double, tolerance double, a_moving boolean, diagonals double, score double")
    assert [r.rejection_reason for r in continuity.decide(df).orderBy("i").collect()] == [reason for _, reason in cases]


def test_active_interval_first_in_order(spark):
    frames = spark.createDataFrame([(0, f) for f in (0, 5, 70, 200)], "video_id long, frame long")
    spans = spark.createDataFrame([(0, 3, 80, 7), (0, 60, 190, 8)], "video_id long, first_frame long, last_frame long, member long")
    assert {r.frame: r.member for r in continuity.active_at(frames, spans).collect()} == {0: None, 5: 7, 70: 7, 200: None}


def test_beats_and_cuts(spark):
    speed = [0.0] * 60
    speed[10], speed[40] = 5.0, 3.0
    profile = spark.createDataFrame([(0, 1, f, v) for f, v in enumerate(speed)], "video_id long, track_id long, frame long, speed double")
    b = scene.beats(profile).first()
    assert (b.primary_beat, b.secondary_beat, b.onset) == (10, 40, 9)
    motion = spark.createDataFrame([(0, f, 20.0 if f == 30 else 0.5) for f in range(60)], "video_id long, frame long, value double")
    assert [r.frame for r in scene.cuts(motion).collect()] == [30]


def test_merge_short_against_step_by_step():
    assert timeline.merge_short([(0, 4, "A", 1), (5, 30, "B", 2), (31, 35, "C", 3), (36, 60, "B", 2)]) == [(0, 60, "B")]
    assert timeline.merge_short([(0, 3, "A", 1)]) == [(0, 3, "A")]
    rng = random.Random(5)
    for _ in range(200):
        at, rows = 0, []
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(1, 30)
            rows.append((at, at + n - 1, rng.choice("ABC"), rng.randint(1, 3)))
            at += n
        got = timeline.merge_short(rows)
        assert got[0][0] == 0 and got[-1][1] == at - 1 and all(a[1] + 1 == b[0] and a[2] != b[2] for a, b in itertools.pairwise(got))
        assert len(got) == 1 or all(z - a + 1 >= timeline.MIN_SHOT for a, z, _ in got)


def brute_budget(parts, total):
    """Passes of giving or taking, straight from the definition; parts: (length, mean speed)."""
    weights = [n / f for n, f in parts]
    ideal = [total * w / sum(weights) for w in weights]
    lo, hi = [math.ceil(n / 1.15) for n, _ in parts], [math.floor(n / 0.55) for n, _ in parts]
    got = [min(hi[i], max(lo[i], math.floor(ideal[i]))) for i in range(len(parts))]
    left, guard = total - sum(got), 0
    order = sorted(range(len(parts)), key=lambda i: (-round(ideal[i] - math.floor(ideal[i]), 9), i))
    while left and guard < 20 * len(parts) + 20:
        guard, moved = guard + 1, False
        for i in order:
            step = (left > 0) - (left < 0)
            if step and lo[i] <= got[i] + step <= hi[i]:
                got[i], left, moved = got[i] + step, left - step, True
        if not moved:
            break
    return got, left == 0


def test_budget_matches_passes(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for video in range(250):
        parts = [(rng.randint(1, 400), rng.choice([0.6, 0.76, 0.9, 1.0, 1.1])) for _ in range(rng.randint(1, 10))]
        at = 0
        for n, f in parts:
            rows.append((video, "HERO", at, at + n - 1, f, f))
            at += n
        total = max(1, round(at * rng.choice([0.7, 0.9, 1.0, 1.2, 1.7, 3.0])))
        want[video] = total, brute_budget(parts, total)
    segments = spark.createDataFrame(rows, "video_id long, phase string, start_frame long, end_frame long, start_factor double, end_factor double")
    by_total = {}
    for video, (total, _) in want.items():
        by_total.setdefault(total, []).append(video)
    for total in list(by_total)[:40]:
        got = {}
        for r in timeline.budget(segments.where(F.col("video_id").isin(by_total[total])), total).orderBy("start_frame").collect():
            got.setdefault(r.video_id, []).append((r.out_frames, r.preserved))
        for video in by_total[total]:
            frames, kept = want[video][1]
            assert got[video] == [(n, kept) for n in frames]


def test_frame_map(spark):
    rows = [(0, "HERO", 0, 99, 0.76, 0.6), (0, "OUTRO", 100, 149, 1.0, 1.0), (1, "HOOK", 0, 9, 1.0, 1.0)]
    segments = spark.createDataFrame(rows, "video_id long, phase string, start_frame long, end_frame long, start_factor double, end_factor double")
    fm = timeline.frame_map(timeline.budget(segments.where("video_id = 0"), 190), spark.createDataFrame([(0, 50)], "video_id long, frame long")).orderBy("out_frame").collect()
    assert [r.out_frame for r in fm] == list(range(190)) and all(r.blend == 0 for r in fm if r.src_frame < 50 <= r.src_next)
    dropped = timeline.frame_map(timeline.budget(segments.where("video_id = 0"), 140), spark.createDataFrame([], "video_id long, frame long")).collect()
    assert all(r.src_next == r.src_frame and r.blend == 0 for r in dropped)
    single = spark.createDataFrame([(0, "HOOK", 5, 9, 5, 1)], "video_id long, phase string, start_frame long, end_frame long, n long, out_frames long")
    assert [tuple(r) for r in timeline.frame_map(single, spark.createDataFrame([], "video_id long, frame long")).collect()] == [(0, 0, 5, 5, 0.0, "HOOK")]


def test_camera_follows_seen_frames_only(spark):
    obs = spark.createDataFrame([(0, f, float(f)) for f in (0, 10, 40, 50, 200)], "video_id long, frame long, cx double")
    event = spark.createDataFrame([(0, 60, 45)], "video_id long, start_frame long, end_frame long")  # ends before it begins: swapped
    rows = {r.frame: (r.phase, r.target_x) for r in timeline.camera_phases(obs, event).collect()}
    assert sorted(rows) == sorted({0, 10, 40, 50, 200} | set(range(15, 60 + 24 + 30 + 1)))
    assert rows[0] == ("track", 0.0) and rows[16] == ("anticipation", 10.0) and rows[45] == ("hero_moment", 40.0) and rows[60] == ("hero_moment", 50.0)
    assert rows[61] == ("reaction", 50.0) and rows[85] == ("celebration", 50.0) and rows[200] == ("track", 200.0)
    alone = timeline.camera_phases(obs, event.limit(0)).collect()
    assert [(r.frame, r.phase) for r in sorted(alone)] == [(f, "track") for f in (0, 10, 40, 50, 200)]


def test_gate_by_evidence(spark):
    columns = "video_id long, context int, start_frame long, end_frame long, track_id long, present boolean, person_sized boolean, moving_frames long, track_frames long"
    rows = [(0, 2, 0, 10, 1, True, True, 30, 60), (0, 3, 0, 99, None, False, False, 0, 0), (0, 4, 0, 99, 1, True, False, 50, 90), (0, 5, 0, 99, 1, True, True, 30, 60),
            (0, 6, 0, 99, 1, True, True, 30, 60), (0, 7, 0, 99, 1, True, True, 10, 20), (0, 8, 0, 99, 1, True, True, 10, 20), (0, 9, 0, 99, 1, True, True, 3, 90),
            (1, 7, 0, 99, 1, True, True, 10, 20)]
    distances = spark.createDataFrame([(0, 8, 100.0)], "video_id long, context int, ball_distance double")
    relations = spark.createDataFrame([(0, 6, "SAME_CANONICAL_IDENTITY"), (0, 5, "NEW_IDENTITY")], "video_id long, context int, relation string")
    gated = timeline.post_cut_gate(spark.createDataFrame(rows, columns), distances, spark.createDataFrame([(0,), (0,)], "video_id long"), relations)
    got = {(r.video_id, r.context): r.phase for r in gated.collect()}
    # a ball was seen in video 0, but near no subject of context 7: no reaction; video 1 has no ball at all
    assert got == {(0, 2): "OMITTED", (0, 3): "CUTAWAY", (0, 4): "CUTAWAY", (0, 5): "HERO", (0, 6): "FINAL_HERO", (0, 7): "CELEBRATION", (0, 8): "REACTION",
                   (0, 9): "SECONDARY", (1, 7): "REACTION"}
    segments = {r.context: (r.phase, r.filled) for r in timeline.post_cut_segments(gated.where("video_id = 0")).collect()}
    assert segments[2] == ("CUTAWAY", True) and segments[6] == ("FINAL_HERO", False)


def test_plans_replace_only_what_stays_whole(spark):
    schema = "video_id long, start_frame long, end_frame long, phase string"
    before = spark.createDataFrame([(v, a, z, p) for v in (0, 1) for a, z, p in ((0, 39, "HOOK"), (40, 99, "HERO"))], schema)
    after = spark.createDataFrame([(0, 60, 99, "REACTION"), (1, 30, 49, "HERO"), (1, 60, 99, "REACTION")], schema)
    got = sorted(tuple(r) for r in timeline.plan_segments(before, after, 100).select("video_id", "start_frame", "end_frame", "phase", "replaced").collect())
    assert got == [(0, 0, 39, "HOOK", True), (0, 40, 59, "HERO", True), (0, 60, 99, "REACTION", True), (1, 0, 39, "HOOK", False), (1, 40, 99, "HERO", False)]
    videos = before.select("video_id").distinct()
    assert timeline.without_hero(videos, 100).count() == 4 and timeline.without_hero(videos, 40).count() == 2


def test_speed_needs_an_event(spark):
    segments = spark.createDataFrame([(0, "HERO", 0, 9, True), (0, "CLIMAX", 10, 19, False), (0, "HOOK", 20, 29, True)],
                                     "video_id long, phase string, start_frame long, end_frame long, event boolean")
    got = {r.phase: r for r in timeline.with_speed(segments, timeline.phase_table(spark), F.lit(0.5), F.col("event")).collect()}
    assert (got["HERO"].behaviour, got["HERO"].start_factor, got["HERO"].reason, got["HERO"].fallback) == ("HERO_SLOW", 0.76, "HERO_EVENT_LINKED", "TEMPORAL_RESAMPLE_NO_RIFE")
    assert got["HERO"].end_factor == pytest.approx(0.67)
    for phase in ("CLIMAX", "HOOK"):
        assert (got[phase].behaviour, got[phase].start_factor, got[phase].end_factor, got[phase].reason, got[phase].fallback) == ("NORMAL", 1.0, 1.0, "NO_SPEED_EVIDENCE", None)


def test_split_at_cuts_keeps_short_parts_whole(spark):
    segments = spark.createDataFrame([(0, "HERO", 0, 59), (0, "OUTRO", 60, 80)], "video_id long, phase string, start_frame long, end_frame long")
    cuts = spark.createDataFrame([(0, 30), (0, 65)], "video_id long, frame long")
    got = {(r.start_frame, r.end_frame, r.kept_whole) for r in timeline.split_at_cuts(segments, cuts).collect()}
    assert got == {(0, 29, False), (30, 59, False), (60, 80, True)}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        small, large = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
        assert sum(cost[i, j] for i, j in tracking.assign(cost)) == pytest.approx(best)


def test_tracker_keeps_an_id_and_drops_lost_ones():
    t = tracking.Tracker()
    box = np.array([[0.0, 0, 20, 50]])
    for f in range(5):
        out = t.update(box + f, np.array([0.9]))
    assert out == [(1, 0, 5, 0)]
    for _ in range(tracking.MAX_LOST):
        out = t.update(np.empty((0, 4)), np.empty(0))
    assert out == [(1, -1, 5, tracking.MAX_LOST)]
    assert t.update(box + 500, np.array([0.9])) == [(2, 0, 1, 0)]
    assert t.update(box + 900, np.array([0.2])) == [(2, -1, 1, 1)]


def test_silent_frames_are_misses(spark):
    """A track that is not seen in 31 sampled frames is gone, whether or not these have rows."""
    rows = [(0, f, n, 0.0, 0.0, 20.0, 50.0, 0.9) for n, f in enumerate((0, 1, 40, 41))]
    boxes = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    spine = spark.range(45).selectExpr("0L AS video_id", "id AS frame")
    assert {r.track for r in tracking.track_boxes(boxes, with_lost=False).collect()} == {1}
    assert {r.track for r in tracking.track_boxes(boxes, with_lost=False, frames=spine).collect()} == {1, 2}


def test_link_rejections_and_hero(spark):
    links = spark.createDataFrame([(0, 1, 2, 3, 0.9, None, "ACCEPTED"), (0, 1, 3, 5, 0.8, None, "ACCEPTED"), (0, 4, 5, 2, 0.1, "BELOW_THRESHOLD", "REJECTED")],
                                  "video_id long, src long, tgt long, gap long, score double, rejection_reason string, decision string")
    matched = continuity.greedy_matching(links.where("decision = 'ACCEPTED'"))
    final = {(r.src, r.tgt): (r.decision, r.rejection_reason) for r in continuity.superseded(links, matched).collect()}
    assert final == {(1, 2): ("ACCEPTED", None), (1, 3): ("REJECTED", "SUPERSEDED_BY_STRONGER_LINK"), (4, 5): ("REJECTED", "BELOW_THRESHOLD")}
    fragments = spark.createDataFrame([(v, f, f, 10 * f, 10 * f + 5) for v, f in ((0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 6))],
                                      "video_id long, track_id long, fragment_id long, first_frame long, last_frame long")
    members = continuity.lineages(fragments.select("video_id", F.col("fragment_id").alias("node")), matched)
    videos = spark.range(3).selectExpr("id AS video_id")
    for track, want in ((1, (1, 2, 0.9, None, None)), (4, (4, 1, 1.0, "UNRESOLVED_TRACK_FRAGMENT", 5))):
        hero = continuity.hero_members(members, fragments, spark.createDataFrame([(0, track), (1, 6)], "video_id long, track_id long"))
        got = {r.video_id: (r.canonical_id, r.members, r.confidence, r.fallback, r.refused) for r in continuity.hero_identity(
            videos, hero, continuity.superseded(links, matched), fragments, matched).collect()}
        assert got == {0: want, 1: (6, 1, 1.0, None, None), 2: (None, 0, 0.0, "NO_HERO_TRACK", None)}
    keys = continuity.identity_keys(members, spark.createDataFrame([(1, 6)], "video_id long, node long"))
    assert {(r.video_id, r.node, r.key) for r in keys.collect()} == {(0, 1, 1), (0, 2, 1), (1, 6, 6)}


def test_event_term_of_a_link(spark):
    side = "video_id long, track_id long, fragment_id long, n long, start_x double, start_y double, end_x double, end_y double, mean_w double, mean_h double"
    fragments = spark.createDataFrame([(0, 1, 1, 60, 0.0, 0.0, 10.0, 0.0, 20.0, 50.0), (0, 2, 2, 60, 14.0, 0.0, 30.0, 0.0, 20.0, 50.0)], side)
    velocities = spark.createDataFrame([(0, i, i, 2.0, 0.0, 0.75, True) for i in (1, 2)], "video_id long, track_id long, fragment_id long, vx double, vy double, dispersion double, moving boolean")
    pairs = spark.createDataFrame([(0, 1, 2, 2)], "video_id long, src long, tgt long, gap long")
    plain = continuity.score_links(pairs, fragments, velocities, velocities).first()
    balls = spark.createDataFrame([(0, 3, 14.0, 70.0), (0, 4, 900.0, 0.0)], "video_id long, frame long, bx double, by double")
    with_ball = continuity.score_links(pairs, fragments, velocities, velocities, balls=balls).first()
    assert plain.ball_distance is None and with_ball.ball_distance == pytest.approx(70.0)
    assert with_ball.score == pytest.approx((plain.score + 0.08 * math.exp(-70 / 140)) / 1.08, abs=2e-6)


def test_online_clusters_replace_the_vector(spark):
    a, b = [1.0, 0.0], [0.7, 0.72]
    assert vectors.cluster_in_order(np.array([a, b, [0.0, 1.0], a])) == [0, 0, 0, 1]


def test_rules_prompt_and_nodes(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, " ")], "k int, v double, s string")
    got = records.rule_errors(df, {"LOW": F.col("v") > 3, "NAME": F.col("s") == "a"}, ["k"]).orderBy("k").collect()
    assert [(r.errors, r.passed) for r in got] == [("", True), ("LOW,NAME", False)]
    assert [r[0] for r in df.select(records.build_prompt(F.col("s"), F.lit("base"))).collect()] == ["a, base", "base"]


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    for fmt in ("json", "parquet", "orc", "csv"):
        write_report(df, f"file://{tmp_path}/{fmt}", fmt)
    assert read_json(spark, f"file://{tmp_path}/json", "k int, s string").collect() == df.collect()


def test_missing_models_say_so(spark):
    from spanloom.functions import registry

    df = spark.createDataFrame([(1, 2.0)], "k long, x double")
    assert registry.apply_model(df, "depth", "k").collect() == [(1, "MODEL_UNAVAILABLE", None)]
    registry.register("depth", lambda batches: batches, "k long, x double")
    assert registry.apply_model(df, "depth", "k").collect() == [(1, 2.0)]
    registry.unregister("depth")


def test_nearest_frames_and_timeouts(spark):
    from spanloom.operators import checks

    there = spark.createDataFrame([(0, 5), (0, 9), (0, 9)], "video_id long, frame long")
    wanted = spark.createDataFrame([(0, f) for f in (1, 5, 7, 8, 20)], "video_id long, frame long")
    assert {r.frame: r.nearest for r in checks.nearest_frames(wanted, there).collect()} == {1: 5, 5: 5, 7: 5, 8: 9, 20: 9}
    log = spark.createDataFrame([(1, s, at * 1_000_000) for s, at in enumerate((0, 10, 100, 300))], "job_id long, step long, at_us long")
    assert checks.timeouts(log, 60, 1, 2).collect() == [(1, 2, 2, "FAILED")]


def test_nearest_identity_in_blocks(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    c /= np.linalg.norm(c, axis=1)[:, None]
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, vector array<double>")
    known = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "label long, centroid array<double>")
    want = {i: int((c @ v).argmax()) for i, v in enumerate(x)}
    for block in (64, 4096):
        got = {r.vec_id: r.identity for r in vectors.nearest_identity(vecs, known, "label", least=-1.0, block=block).collect()}
        assert got == want | {99: None}


def hero_cases(spark):
    heroes = spark.createDataFrame([(1, 100, 400, 250, None, 320), (2, 5, 40, 30, 10, None), (3, 600, 719, 700, 650, None)],
                                   "video_id long, first_frame long, last_frame long, peak long, onset long, second long")
    peaks = {1: 500, 2: 20, 3: 10}
    motion = spark.createDataFrame([(v, f, 9.0 if f == peaks[v] else 1.0) for v in peaks for f in range(720)], "video_id long, frame long, value double")
    return heroes, motion


def test_phase_candidates_stay_with_the_hero(spark):
    heroes, motion = hero_cases(spark)
    got = {}
    for row in timeline.phase_candidates(heroes, motion, 720).collect():
        got.setdefault(row.video_id, set()).add((row.phase, row.start_frame, row.end_frame))
    assert got[1] == {("HERO", 221, 317), ("ANTICIPATION", 191, 220), ("ACTION", 155, 190), ("BUILD_UP", 30, 154), ("HOOK", 0, 29), ("REACTION", 318, 347),
                      ("CELEBRATION", 348, 481), ("CLIMAX", 482, 518), ("SECONDARY", 519, 701), ("CELEBRATION", 482, 518), ("OUTRO", 702, 719)}
    # ends with its hero; the video's peak lies before, so the tail is no climax
    assert got[2] == {("HERO", 10, 40), ("ANTICIPATION", 5, 9), ("CELEBRATION", 41, 701), ("OUTRO", 702, 719)}
    # the hero lasts to the end: nothing is left
    assert got[3] == {("HERO", 650, 719), ("ANTICIPATION", 620, 649), ("ACTION", 600, 619), ("BUILD_UP", 30, 599), ("HOOK", 0, 29)}


def test_absent_phases_say_why(spark):
    heroes, motion = hero_cases(spark)
    got = {}
    for row in timeline.phases_absent(timeline.phase_candidates(heroes, motion, 720), timeline.phase_windows(heroes, motion, 720)).collect():
        got.setdefault(row.video_id, set()).add((row.phase, row.reason))
    assert got[1] == {("FINAL_HERO", "SECOND_BEAT_TOO_SHORT"), ("CUTAWAY", "INSUFFICIENT_EVIDENCE")}
    last = {("FINAL_HERO", "HERO_NOT_TRACKED_IN_FINAL_WINDOW"), ("FINAL_HERO", "NO_SECOND_HERO_BEAT"), ("CUTAWAY", "INSUFFICIENT_EVIDENCE")}
    assert got[2] == last | {("HOOK", "NO_PRE_HERO_FRAMES"), ("REACTION", "NO_POST_HERO_FRAMES"), ("CLIMAX", "NO_ISOLATED_MOTION_PEAK"),
                             ("ACTION", "INSUFFICIENT_EVIDENCE"), ("BUILD_UP", "INSUFFICIENT_EVIDENCE"), ("SECONDARY", "INSUFFICIENT_EVIDENCE")}
    assert got[3] == last | {("REACTION", "NO_POST_HERO_FRAMES"), ("CELEBRATION", "TAIL_TOO_SHORT_FOR_CELEBRATION"), ("CLIMAX", "INSUFFICIENT_EVIDENCE"),
                             ("SECONDARY", "INSUFFICIENT_EVIDENCE"), ("OUTRO", "INSUFFICIENT_EVIDENCE")}


def test_cut_terms_meet_no_pairs_and_keep_sides(spark):
    found = spark.createDataFrame([(0, 10, 40.0, 4.0), (0, 30, 50.0, 0.0), (1, 10, 40.0, 4.0)], "video_id long, frame long, value double, baseline double")
    ranges = spark.createDataFrame([(0, 1, 0, 9), (0, 2, 10, 40), (0, 3, 5, 20), (0, 4, 12, 29)], "video_id long, track_id long, first_frame long, last_frame long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "track_id long, vector array<double>")
    got = {(r.video_id, r.frame): r for r in scene.cut_terms(found, ranges, vectors).collect()}
    # at 10: 2 and 4 begin, 3 goes on, 1 has ended
    assert got[0, 10].tracking_discontinuity == 0.6667 and got[0, 10].appearance_change == 1.0
    # at 30: only 2 goes on, and nothing begins after it
    assert got[0, 30].tracking_discontinuity == 0.0 and got[0, 30].appearance_change is None
    assert got[1, 10].tracking_discontinuity is None and got[1, 10].motion_change == 1.0
    plan = scene.cut_terms(found, ranges, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_frame_transforms_find_a_turn(spark):
    angle, size = math.radians(30), 1.5
    rows = []
    for track, (x, y) in enumerate([(0, 0), (10, 0), (0, 7), (5, 5), (None, 3)]):
        rows.append((0, track, 0, None if x is None else float(x), float(y)))
        if x is not None:
            rows.append((0, track, 1, size * (math.cos(angle) * x - math.sin(angle) * y) + 3, size * (math.sin(angle) * x + math.cos(angle) * y) - 4))
    got = scene.frame_transforms(spark.createDataFrame(rows, "video_id long, track_id long, frame long, cx double, cy double"), 4).collect()
    assert len(got) == 1 and got[0].tracks == 4
    assert np.allclose((got[0].dx, got[0].dy, got[0].scale, got[0].rotation_deg), (3, -4, 1.5, 30))


def test_frame_weights_at_fades_and_dissolves(spark):
    allotted = spark.createDataFrame([(0, "HOOK", 0, 24, 3), (0, "HERO", 24, 6, 2), (0, "OUTRO", 30, 24, 1)], "video_id long, phase string, start_frame long, n long, out_frames long")
    turns = spark.createDataFrame([(0, 0, "FADE_IN", None), (0, 24, "DISSOLVE", None), (0, 30, "HARD_CUT", "FADE_OUT")],
                                  "video_id long, start_frame long, transition_in string, transition_out string")
    got = [(r.light, r.previous) for r in timeline.frame_weights(allotted, turns).orderBy("out_frame").collect()]
    assert got == [(1.0, 0.0), (0.75, 0.0), (0.5, 0.0), (1.0, 1.0), (1.0, 0.0), (0.5, 0.0)]


def test_probe_verdicts_and_prompts(spark):
    rows = spark.createDataFrame([("30000/1001", None, 2.0), ("25", 7, 1.0), ("25/", None, 0.1), ("1/0", None, 1.0), (None, None, 1.0), ("x", 3, None)], "rate string, n long, s double")
    found = checks.probed(F.col("rate"), F.col("n"), F.col("s"))
    got = [tuple(r) for r in rows.select(F.round(found["fps"], 4), found["frames"]).collect()]
    assert got == [(29.97, 60), (25.0, 7), (25.0, 2), (None, None), (None, None), (None, 3)]
    said = spark.range(1).select(
        records.event_verdict(F.lit("a"), F.lit(1), F.lit("a"), F.lit(1)).alias("a"), records.event_verdict(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)).alias("b"),
        records.event_verdict(F.lit(None), F.lit(None), F.lit("b"), F.lit(1)).alias("c"), records.identity_verdict(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(said) == ("OK", "QC_REJECTED", "UNKNOWN", "UNKNOWN")
    asked = spark.createDataFrame([(1, "pan", None, None), (2, None, " own ", ""), (3, "gone", " ", "no")], "k long, preset string, own_positive string, own_negative string")
    presets = spark.createDataFrame([("zoom", "in", ""), ("pan", "along", "crowd")], "preset string, positive string, negative string")
    got = {r.k: (r.used, r.positive_prompt, r.negative_prompt) for r in records.prompts(asked, presets, "zoom", ("light", "text")).collect()}
    assert got == {1: ("pan", "along, light", "crowd, text"), 2: ("zoom", "own, light", "text"), 3: ("zoom", "in, light", "no, text")}


def test_evidence_of_a_video_with_little_to_see(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = scene.evidence(spark.createDataFrame([(0,)], "video_id long"), none("video_id long, person_sized boolean"), none("video_id long, frame long"), none("video_id long, frame long"),
                         none("video_id long, frame long, value double"), none("video_id long, samples long, mean_dx double")).collect()
    assert len(got) == 1 and got[0].tracks == got[0].balls == got[0].cuts == 0 and got[0].first_ball is None and got[0].motion_peak_frame is None


# ---- subjects that are not there

def test_a_context_without_a_subject_has_no_evidence(spark):
    """One without a subject, one whose subject has no rows, one whose subject is elsewhere, one with a subject."""
    chosen = spark.createDataFrame([(0, 2, 100, 199, None), (0, 3, 200, 299, 7), (0, 4, 300, 399, 5), (0, 5, 400, 420, 5), (0, 6, 421, 425, None)],
                                   "video_id long, context long, start_frame long, end_frame long, track_id long")
    rows = spark.createDataFrame(series(5, [(f, f, 0) for f in range(350, 411)]), OBS).withColumns({"w": F.lit(50.0), "h": F.lit(100.0)})
    found = timeline.subject_evidence(chosen, tracks.moving_ranges(rows), tracks.track_stats(rows), tracks.person_sized(rows))
    nothing = (0, False, False, 0, 0, 0.0)
    want = {2: nothing, 3: nothing, 4: (50, True, True, 50, 61, 1.0), 5: (11, True, True, 11, 61, 1.0), 6: nothing}
    assert {r.context: (r.overlap, r.present, r.person_sized, r.moving_frames, r.track_frames, r.continuity) for r in found.collect()} == want
    none = spark.createDataFrame([], "video_id long, context long, ball_distance double")
    relations = chosen.select("video_id", "context", F.lit("UNKNOWN").alias("relation"))
    gated = timeline.post_cut_gate(found, none, none.select("video_id"), relations)
    assert {r.context: (r.phase, r.reason) for r in gated.collect()} == {
        2: ("CUTAWAY", "NO_PERSON_SIZED_SUBJECT"), 3: ("CUTAWAY", "NO_PERSON_SIZED_SUBJECT"), 4: ("HERO", "STRONG_HERO_EVIDENCE"),
        5: ("REACTION", "REACTION_EVIDENCE"), 6: ("OMITTED", "CONTEXT_TOO_SHORT")}


def test_crops_without_a_centre_stay_null(spark):
    points = spark.createDataFrame([(None, 5.0), (5.0, None), (999.0, 500.0)], "cx double, cy double")
    window = checks.crop_window(F.col("cx"), F.col("cy"), F.lit(0.5), F.lit(0.5), 1000.0, 600.0)
    assert [tuple(r) for r in points.select(window["left"], window["top"]).collect()] == [(None, 0.0), (0.0, None), (500.0, 300.0)]
    for crop in (0.5, 2000.0):
        assert [r.target_x is None for r in timeline.clamp_targets(points, crop, 1000.0).collect()] == [True, False, False]


def test_assignment_of_many_boxes_is_best_and_takes_few_steps():
    """Rows whose cheapest column is their own take no search; totals are those of the slow way."""
    rng = np.random.default_rng(3)
    for shape in ((6, 6), (3, 7), (7, 3)):
        for _ in range(20):
            cost = rng.random(shape).round(1)
            small = cost if shape[0] <= shape[1] else cost.T
            best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            assert sum(cost[i, j] for i, j in tracking.assign(cost)) == pytest.approx(best)
    wide = 1 - np.eye(900, 1500)
    begun = time.process_time()
    assert tracking.assign(wide) == [(i, i) for i in range(900)]
    assert time.process_time() - begun < 0.05


def test_boxes_assigned_by_frames_equal_those_by_components_and_write_no_pairs(spark, tmp_path, monkeypatch):
    from spanloom.operators import matching
    from spanloom.sources import durable
    rng = random.Random(8)

    def boxes(count):
        rows = [(k % 2, k % 3, k, rng.uniform(0, 300), rng.uniform(0, 200)) for k in range(count)]
        rows = [(v, f, k, x, y, x + rng.uniform(5, 80), y + rng.uniform(5, 80)) for v, f, k, x, y in rows] + [(0, 9, 900, 0.0, 0.0, 5.0, 5.0), (0, None, 901, 0.0, 0.0, 5.0, 5.0), (0, 0, 902, None, 0.0, 5.0, 5.0)]
        return spark.createDataFrame(rows, "video_id long, frame long, id long, x1 double, y1 double, x2 double, y2 double")

    left, right = boxes(90), boxes(70)
    want = sorted(map(str, matching.assign_boxes(left, right, 0.1, dense=0).collect()))
    monkeypatch.setattr(durable, "fresh_path", lambda _, name, n=iter(range(10_000)): f"{tmp_path}/{name}-{next(n)}")
    assert sorted(map(str, matching.assign_boxes(left, right, 0.1).collect())) == want and sum("MATCHED" in w and "UN" not in w for w in want) > 20
    assert not list(tmp_path.glob("overlaps-*")) and not list(tmp_path.glob("components-*")) and list(tmp_path.glob("assigned-*"))
    assert sorted(map(str, matching.assign_boxes(left, right, 0.1, dense=150).collect())) == want
    onward = left.withColumn("frame", F.col("frame") - 1)  # one side that comes from the other, as q81 has it
    by_frame, mixed = (sorted(map(str, matching.assign_boxes(left, onward, 0.1, dense=dense).collect())) for dense in (10**6, 150))
    assert by_frame == mixed
