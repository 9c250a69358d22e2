"""Assignments, plan validation, models and maps against brute force or known results."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import registry
from spanloom.operators import continuity, matching, records, tracks, validation

BOX = "video_id long, frame long, id long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda z: max(0, z[2] - z[0]) * max(0, z[3] - z[1])
    return inter / (area(a) + area(b) - inter + 1e-9)


def best_assignment(left, right):
    """Of all assignments the one of greatest total overlap, as pairs that overlap."""
    few, many = sorted((left, right), key=len)
    found = max((list(zip(few, chosen, strict=True)) for chosen in itertools.permutations(many, len(few))), key=lambda p: sum(iou(few[a], many[b]) for a, b in p))
    pairs = [(a, b) if few is left else (b, a) for a, b in found]
    return {(a, b): iou(left[a], right[b]) for a, b in pairs if iou(left[a], right[b]) > 0}


@pytest.mark.parametrize("cell", [30.0, 160.0, 5000.0])
def test_assignment_matches_brute_force(spark, cell):
    rng = random.Random(int(cell))

    def boxes(n, first):
        out = {}
        for i in range(n):
            x, y = rng.uniform(-100, 150), rng.uniform(-100, 150)
            out[first + i] = (x, y, x + rng.uniform(5, 130), y + rng.uniform(5, 130))
        return out

    frames = {(v, f): (boxes(rng.randint(0, 5), 0), boxes(rng.randint(0, 6), 100)) for v in (1, 2) for f in range(25)}
    frames[1, 99] = ({1: (0.0, 0.0, 10.0, 10.0), 2: (0.0, 0.0, 0.0, 5.0)}, {101: (0.0, 0.0, 10.0, 10.0), 102: (500.0, 500.0, 510.0, 510.0)})
    side = lambda k: spark.createDataFrame([(v, f, i, *b) for (v, f), both in frames.items() for i, b in both[k].items()], BOX)
    got = matching.assign_boxes(side(0), side(1), 0.2, cell).collect()
    for (v, f), (left, right) in frames.items():
        rows = [r for r in got if (r.video_id, r.frame) == (v, f)]
        want = {pair: value for pair, value in best_assignment(left, right).items() if value >= 0.2}
        matched = {(r.left, r.right): r.overlap for r in rows if r.status == "MATCHED"}
        assert matched == {pair: pytest.approx(value) for pair, value in want.items()}
        assert {r.left for r in rows if r.status == "UNMATCHED_LEFT"} == set(left) - {a for a, _ in want}
        assert {r.right for r in rows if r.status == "UNMATCHED_RIGHT"} == set(right) - {b for _, b in want}
        assert len(rows) == len(left) + len(right) - len(want)
    assert matching.assign_boxes(side(0).limit(0), side(1), 0.2).where("status = 'MATCHED'").count() == 0


def test_of_two_equally_good_boxes_the_greater_is_assigned(spark):
    lefts = spark.createDataFrame([(1, 1, i, 0.0, 0.0, 10.0, 10.0) for i in (3, 8, 5)], BOX)
    right = spark.createDataFrame([(1, 1, 9, 2.0, 0.0, 12.0, 10.0)], BOX)
    got = matching.assign_boxes(lefts, right, 0.2).collect()
    assert sorted((r.left, r.right) for r in got) == [(3, None), (5, None), (8, 9)]


def test_plans_tell_every_error_in_order(spark):
    shots = spark.createDataFrame([(1, 1, 0, 29, 1.0), (1, 2, 30, 59, None), (2, 1, 2, 29, 2.0), (2, 2, 31, 50, 0.1), (2, 3, 40, 60, 0.55), (3, 1, 0, 9, 1.15)],
                                  "plan_id long, shot_id long, start_frame long, end_frame long, effective_factor double")
    plans = spark.createDataFrame([(1, 60, True, 5, 5), (2, 99, False, 5, 6), (3, 10, True, None, 6), (4, 0, True, 5, None), (5, 7, None, None, None)],
                                  "plan_id long, total_frames long, duration_preserved boolean, hero_track long, followed_track long")
    got = {r.plan_id: (r.status, r.errors, r.shots, r.expected_frames) for r in validation.validate_plans(shots, plans).collect()}
    assert got == {
        1: ("OK", [], 2, 60), 3: ("OK", [], 1, 10), 4: ("QC_REJECTED", ["hero_camera_contract"], 0, 0),
        2: ("QC_REJECTED", ["timeline_gap:1:2!=0", "timeline_gap:2:31!=30", "timeline_gap:3:40!=51", "timeline_end:61!=99", "duration_not_preserved",
                            "speed_out_of_bounds:1:2.0", "speed_out_of_bounds:2:0.1", "hero_camera_contract"], 3, 61),
        5: ("QC_REJECTED", ["timeline_end:0!=7", "duration_not_preserved"], 0, 0)}


def test_models_load_once_a_process_and_fail_by_class(spark, tmp_path):
    log = str(tmp_path / "loads")

    def slow():
        import os
        import time

        time.sleep(0.2)
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda batch: pa.array([2.0 * x for x in batch.column(1).to_pylist()])

    def failing():
        raise OSError("no weights")

    def at_work():
        def run(batch):
            raise RuntimeError("bad batch")
        return run

    def gone():
        raise registry.ModelUnavailable("no library", "DEPENDENCY_MISSING")

    models = [registry.Model("slow", slow), registry.Model("failing", failing), registry.Model("work", at_work), registry.Model("gone", gone), registry.Model("off", slow, enabled=False),
              registry.Model("missing", slow, requires=(str(tmp_path / "no.pt"),)), registry.Model("unknown"), registry.Model("empty", lambda: None)]
    df = spark.range(400).repartition(16).select("id", F.col("id").cast("double").alias("x"))
    scored, metric = registry.observe_failures(registry.score_with(df, models, "id"), models)
    rows = scored.collect()
    assert len(rows) == 400 * 8 and all(r.value == 2 * r.id for r in rows if r.model == "slow") and all(r.value is None for r in rows if r.model != "slow")
    with open(log) as lines:
        pids = lines.read().split()
    assert len(pids) == len(set(pids))  # never twice in a process
    assert metric.get == {m.name: 0 if m.name == "slow" else 400 for m in models}
    states = {r.model: (r.status, r.truth, r.rows, r.answered) for r in registry.model_states(scored).collect()}
    assert states == {
        "slow": ("OK", "READY", 400, 400), "failing": ("ERROR", "LOAD_ERROR", 400, 0), "work": ("ERROR", "INFERENCE_ERROR", 400, 0),
        "gone": ("MODEL_UNAVAILABLE", "DEPENDENCY_MISSING", 400, 0), "off": ("MODEL_UNAVAILABLE", "DISABLED", 400, 0),
        "missing": ("MODEL_UNAVAILABLE", "CHECKPOINT_MISSING", 400, 0), "unknown": ("MODEL_UNAVAILABLE", "MODEL_UNAVAILABLE", 400, 0),
        "empty": ("MODEL_UNAVAILABLE", "MODEL_UNAVAILABLE", 400, 0)}


def test_keyframes_are_about_eight(spark):
    obs = spark.createDataFrame([(0, n, f) for n in (1, 7, 8, 15, 16, 35) for f in range(n)], "video_id long, track_id long, frame long")
    got = {}
    for r in tracks.keyframes(obs).collect():
        got.setdefault(r.track_id, []).append(r.frame)
    assert {n: sorted(f) for n, f in got.items()} == {n: list(range(n))[:: max(1, n // 8)] for n in (1, 7, 8, 15, 16, 35)}


def test_maps_of_named_values(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 5), (1, None, 9), (2, "c", 3)], "k long, name string, v long")
    named = records.named_values(rows, ["k"], "name", "v")
    entries = lambda df, name: {r.k: [tuple(e) for e in r.e] for r in df.select("k", F.map_entries(name).alias("e")).collect()}
    assert entries(named, "values") == {1: [("a", 5), ("b", 2)], 2: [("c", 3)]}
    zeros = F.create_map(F.lit("b"), F.lit(0).cast("long"), F.lit("d"), F.lit(0).cast("long"))
    merged = named.select("k", records.merged_maps(zeros, F.col("values")).alias("m"))
    assert entries(merged, "m") == {1: [("a", 5), ("b", 2), ("d", 0)], 2: [("b", 0), ("c", 3), ("d", 0)]}


def test_heroes_without_a_fragment_say_so(spark):
    videos = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    fragments = spark.createDataFrame([(1, 10, 0, 5)], "video_id long, fragment_id long, first_frame long, last_frame long")
    hero = spark.createDataFrame([(1, 10, 10, 10)], "video_id long, head long, hero_fragment long, node long")
    links = spark.createDataFrame([(1, 10, 11, 4, 0.2, "REJECTED", "BELOW_THRESHOLD"), (1, 10, 12, 2, 0.1, "REJECTED", "SPATIAL_VELOCITY_CONFLICT")],
                                  "video_id long, src long, tgt long, gap long, score double, decision string, rejection_reason string")
    matched = links.limit(0).select("video_id", "src", "tgt", "score")
    heroes = spark.createDataFrame([(1, 10), (2, 7)], "video_id long, track_id long")
    got = {r.video_id: tuple(r)[1:] for r in continuity.hero_identity(videos, hero, links, fragments, matched, heroes).collect()}
    assert got == {1: (10, 1, 0, 5, 1.0, "UNRESOLVED_TRACK_FRAGMENT", 12, "SPATIAL_VELOCITY_CONFLICT", 0.1),
                   2: (7, 1, None, None, 0.0, "HERO_FRAGMENT_MISSING", None, None, None), 3: (None, 0, None, None, 0.0, "NO_HERO_TRACK", None, None, None)}


def test_chain_pairs_follow_each_other(spark):
    members = spark.createDataFrame([(1, 5, 5), (1, 6, 5), (1, 7, 5), (1, 8, 8)], "video_id long, node long, head long")
    fragments = spark.createDataFrame([(1, 5, 0, 10), (1, 6, 30, 40), (1, 7, 12, 20), (1, 8, 0, 9)], "video_id long, fragment_id long, first_frame long, last_frame long")
    assert sorted(map(tuple, continuity.chain_pairs(members, fragments).collect())) == [(1, 5, 0, 5, 7, 2), (1, 5, 1, 7, 6, 10)]
