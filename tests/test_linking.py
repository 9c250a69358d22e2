"""Links that stream from their join: against pairs that are scored one by one, brute force, and matching at once."""

import math
import random

from pyspark.sql import functions as F

from spanloom.operators import continuity, spatial
from spanloom.sources import durable

ENDS = ("video_id long, track_id long, fragment_id long, n long, first_frame long, last_frame long, start_x double, start_y double, end_x double, end_y double, "
        "mean_w double, mean_h double")
VELOCITY = "video_id long, track_id long, fragment_id long, vx double, vy double, dispersion double, moving boolean"


def parts(spark, count=60):
    rng = random.Random(5)
    rows, speeds = [], ([], [])
    for i in range(count):
        first = rng.randrange(120)
        rows.append((i % 2, i, i * 1000, rng.randrange(1, 50), first, first + rng.randrange(20), *(rng.uniform(0, 300) for _ in range(4)), rng.uniform(20, 90), rng.uniform(40, 150)))
        for side in speeds:
            side.append((i % 2, i, i * 1000, rng.gauss(0, 3), rng.gauss(0, 3), rng.uniform(0.75, 3), rng.random() < 0.5))
    balls = [(0, f, rng.expovariate(0.02), float(rng.randrange(100))) for f in range(150)]  # video 1 has none
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, count, 2)]
    return (spark.createDataFrame(rows, ENDS), spark.createDataFrame(speeds[0], VELOCITY), spark.createDataFrame(speeds[1], VELOCITY),
            spark.createDataFrame(vectors, "track_id long, vector array<float>"), spark.createDataFrame(balls, "video_id long, frame long, bx double, by double"))


def test_streamed_links_equal_scored_pairs_and_bands_equal_one_matching(spark):
    fragments, leaving, entering, vectors, balls = parts(spark)
    pairs = continuity.candidate_pairs(fragments)
    want = continuity.decide(continuity.score_links(pairs, fragments, leaving, entering, vectors, balls))
    ends = durable.cut_lineage(continuity.link_ends(fragments, leaving, entering, vectors), "ends")
    cells = durable.cut_lineage(spatial.nearest_cells(balls, "bx", "by"), "cells")
    got = continuity.decide(continuity.linked(ends, None, cells))
    names = ["video_id", "src", "tgt", "gap", "score", "rejection_reason"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    once = continuity.greedy_matching(want.where("score > 0.3"))
    bands = continuity.matching_in_bands(lambda a, b: continuity.decide(continuity.linked(a, b, cells)).where("score > 0.3"), ends, share=1)
    assert sorted(map(tuple, bands.collect())) == sorted(map(tuple, once.collect())) and once.count() > 10
    nothing = continuity.matching_in_bands(lambda a, b: continuity.linked(a, b, cells).where("score > 2"), ends)
    assert nothing.count() == 0
    final = continuity.superseded(want, once)
    carried = ends.join(once.select("video_id", F.col("src").alias("fragment_id"), F.col("tgt").alias("won")), ["video_id", "fragment_id"], "left")
    streamed = continuity.superseded_from(continuity.decide(continuity.linked(carried, ends, cells, ("won",))))
    names = ["video_id", "src", "tgt", "rejection_reason", "decision"]
    assert sorted(map(str, streamed.select(names).collect())) == sorted(map(str, final.select(names).collect()))


def test_distance_by_cells_equals_brute_force_near_and_far(spark):
    rng = random.Random(6)
    targets = [(0, rng.expovariate(0.02), float(rng.randrange(100))) for _ in range(300)] + [(1, 5.0, 5.0)] * 3 + [(2, math.nan, 1.0)]
    points = [(k % 4, k, rng.gauss(50, 10 ** rng.uniform(0, 9)), rng.gauss(50, 10 ** rng.uniform(0, 9))) for k in range(600)]
    points += [(0, 600, *targets[0][1:]), (0, 601, math.inf, 0.0), (0, 602, None, 0.0)]
    cells = durable.cut_lineage(spatial.nearest_cells(spark.createDataFrame(targets, "video_id long, tx double, ty double"), "tx", "ty"), "cells")
    rows = spark.createDataFrame(points, "video_id long, id long, x double, y double").join(spatial.grids_of(cells), "video_id", "left")
    for r in spatial.distance_by_cells(rows, cells, "x", "y", "grid", "distance").collect():
        known = [math.hypot(r.x - x, r.y - y) for v, x, y in targets if v == r.video_id and x == x] if r.x is not None and math.isfinite(r.x) else []
        assert r.distance == (min(known) if known else None) or abs(r.distance - min(known)) <= 1e-12 * min(known)


def test_links_are_not_written(spark, tmp_path):
    import __spark_entry__
    sf = "/root/testdata/sf0.001"
    for name in ("q17_link_scores_and_decisions", "q18b_final_decisions", "q66_nearest_rejected_link"):
        __spark_entry__.queries()[name](spark, sf).count()
    written = {key[1] for key in durable._shared}
    assert "links" not in written and {"link-ends", "ball-cells", "matched"} <= written


def test_bounded_bands_equal_one_matching_and_leave_no_edges(spark, tmp_path, monkeypatch):
    """Pairs that cannot be accepted are left out early, edges are counted at some sources only, and what a round wrote is deleted."""
    fragments, leaving, entering, vectors, balls = parts(spark)
    ends = durable.cut_lineage(continuity.link_ends(fragments, leaving, entering, vectors), "ends")
    cells = durable.cut_lineage(spatial.nearest_cells(balls, "bx", "by"), "cells")

    def edges(sources, targets, least=0.45):
        links = continuity.linked(sources, targets, cells, least=least)
        return links.where((F.col("error") <= continuity.FAR) & (F.col("score") >= least))

    whole = continuity.linked(ends, None, cells).where((F.col("error") <= continuity.FAR) & (F.col("score") >= 0.45)).select("video_id", "src", "tgt", "score")
    assert sorted(map(tuple, edges(ends, ends).select("video_id", "src", "tgt", "score").collect())) == sorted(map(tuple, whole.collect()))
    want = sorted(map(tuple, continuity.greedy_matching(whole).collect()))
    monkeypatch.setattr(continuity, "COUNTED", 3)
    before = spark.conf.get(continuity.HUGE)
    monkeypatch.setattr(durable, "fresh_path", lambda _, name, n=iter(range(10_000)): f"{tmp_path}/{name}-{next(n)}")
    got = continuity.matching_in_bands(edges, ends, share=4, bounded=True)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5
    assert spark.conf.get(continuity.HUGE) == before and not list(tmp_path.glob("edges-*")) and list(tmp_path.glob("matching-*"))


def test_blocks_of_fragments_equal_scored_pairs_on_odd_values(spark, monkeypatch):
    """Several blocks of a bucket, missing places and sizes, vectors of other lengths and without a norm, and only the columns that are asked for."""
    from spanloom.operators import pairing
    fragments, leaving, entering, vectors, balls = parts(spark, 90)
    some = F.col("track_id")
    fragments = fragments.withColumns({
        "end_x": F.when(some % 7 != 0, F.col("end_x")), "start_y": F.when(some % 11 != 0, F.col("start_y")), "mean_w": F.when(some % 13 != 0, F.col("mean_w")),
        "start_x": F.when(some % 17 == 0, F.lit(1e9)).otherwise(F.col("start_x")), "first_frame": F.floor(F.col("first_frame") / 30) * 30})
    leaving = leaving.withColumn("dispersion", F.when(some % 5 != 0, F.col("dispersion")))
    vectors = vectors.withColumn("vector", F.when(some % 3 == 0, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).when(some % 8 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    ends = durable.cut_lineage(continuity.link_ends(fragments, leaving, entering, vectors), "ends")
    cells = durable.cut_lineage(spatial.nearest_cells(balls, "bx", "by"), "cells")
    want = continuity.score_links(continuity.candidate_pairs(fragments), fragments, leaving, entering, vectors, balls)
    for name, size in (("SOURCES", 4), ("TARGETS", 5), ("STEP", 3)):
        monkeypatch.setattr(pairing, name, size)
    names = [c for c in want.columns if c in (*pairing.MEASURES, "video_id", "src", "tgt", "gap", "a_moving")]

    def told(links):
        return sorted(tuple("none" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in links.select(names).collect())

    got = continuity.linked(ends, None, cells)
    assert told(got) == told(want) and want.where("error IS NULL").count() and want.where("cosine IS NULL").count() and want.where("cosine IS NOT NULL").count()
    few = continuity.linked(ends, None, cells, columns=("video_id", "src", "widths"))
    assert few.columns == ["video_id", "src", "widths"] and few.count() == want.count()
    accepted = continuity.decide(want).where("decision = 'ACCEPTED' AND score >= 0.6").select("video_id", "src", "tgt", "score")
    early = continuity.decide(continuity.linked(ends, None, cells, least=0.6)).where("decision = 'ACCEPTED'").select("video_id", "src", "tgt", "score")
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, accepted.collect())) and accepted.count()
