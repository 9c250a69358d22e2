"""The analysis as one call, for programs and for the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_settings
from .operators import continuity, events, scene, tracks
from .sources.durable import cut_lineage
from .sources.shipping import ship_package
from .sources.tables import fragment_rows, write_report


def analyse(obs: DataFrame, ball: str = "purchase", height: float = 1000.0, vectors: DataFrame | None = None, half_width: float = 10.0,
            half_height: float = 25.0) -> dict[str, DataFrame]:
    """All tables of the analysis of observations (video_id, track_id, frame, cx, cy, confidence, class_name): stats, ranges,
    motion events, ranked heroes, links with their final decisions, matched links, lineages, hero identities, speed profiles
    and beats. Boxes have the given half sizes where obs has no w and h."""
    ship_package(obs.sparkSession)
    if "w" not in obs.columns:
        obs = obs.withColumns({"w": F.lit(2 * half_width), "h": F.lit(2 * half_height)})
    obs = cut_lineage(obs, "observations")  # read by every table
    stats = tracks.track_stats(obs)
    found = events.motion_events(obs)
    signals = events.hero_signals(found, stats, events.ball_evidence(obs, ball), events.nearest_distance(obs, events.ball_centres(obs, ball)), height)
    rows = fragment_rows(obs)
    key = ["video_id", "track_id", "fragment_id"]
    fragments = tracks.track_stats(rows, key)
    links = cut_lineage(continuity.decide(continuity.score_links(
        continuity.candidate_pairs(fragments), fragments, tracks.edge_velocity(rows, key), tracks.edge_velocity(rows, key, at_start=True), vectors,
        events.ball_centres(rows, ball))), "links")
    matched = continuity.greedy_matching(links.where("decision = 'ACCEPTED'"))
    members = continuity.lineages(fragments.select("video_id", F.col("fragment_id").alias("node")), matched)
    decided = continuity.superseded(links, matched)
    heroes = events.rank_heroes(signals)
    hero = continuity.hero_members(members, fragments, heroes.where("rank = 1"))
    profile = scene.speed_profile(obs)
    return {"track_stats": stats, "moving_ranges": tracks.moving_ranges(obs), "motion_events": found, "heroes": heroes, "links": decided,
            "matched": matched, "lineages": continuity.lineage_table(members, fragments, matched),
            "hero_identity": continuity.hero_identity(obs.select("video_id").distinct(), hero, decided, fragments, matched), "speed_profile": profile, "beats": scene.beats(profile)}


def sampled(obs: DataFrame, stride: int = 1, most: int = 0, unplaced: bool = False) -> DataFrame:
    """Every `stride`-th frame, and of each video the first `most` of these (0: all); rows without a frame only if `unplaced`."""
    stride, frame = max(1, stride), F.col("frame")
    kept = frame % stride == 0
    if most > 0:
        kept = kept & (frame < most * stride)
    return obs.where(kept | frame.isNull() if unplaced else kept)


def verify(obs: DataFrame) -> DataFrame:
    """Per video: rows, tracks and frames, and how many rows lack what the analysis needs (a box's centre, a frame, a track)
    or repeat a track's frame. Such rows are left as they are."""
    keys = ["video_id", "track_id", "frame"]
    bad = F.lit(False)
    for name in (*keys, "cx", "cy"):
        bad = bad | F.col(name).isNull()
    unique = obs.where(~bad).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.sum(F.col("n") - 1).alias("repeats"))
    counts = obs.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("incomplete"), F.count_distinct("track_id").alias("tracks"),
                                         F.count_distinct("frame").alias("frames"))
    joined = counts.join(unique.withColumnRenamed("video_id", "v"), F.col("video_id").eqNullSafe(F.col("v")), "left").drop("v")
    return joined.withColumn("repeats", F.coalesce("repeats", F.lit(0))).withColumn("usable", (F.col("incomplete") == 0) & (F.col("repeats") == 0))


SHOWN = 20  # videos that a printed report names


def verify_report(obs: DataFrame, out: str | None, fmt: str) -> dict:
    """Totals over all videos, and the first SHOWN of those that can't be used, by how many rows are at fault; with a folder
    the whole table is written there."""
    found = cut_lineage(verify(obs), "verified")
    totals = found.agg(F.count(F.lit(1)).alias("videos"), F.count_if("usable").alias("usable"), F.sum("rows").alias("rows"),
                       F.sum("incomplete").alias("incomplete"), F.sum("repeats").alias("repeats")).first().asDict()
    worst = found.where("NOT usable").orderBy(F.desc(F.col("incomplete") + F.col("repeats")), "video_id").limit(SHOWN).collect()
    report = {**totals, "unusable": totals["videos"] - totals["usable"], "shown": len(worst), "worst": [row.asDict() for row in worst]}
    if out:
        write_report(found, f"{out}/verify", fmt)
        report["table"] = f"{out}/verify"
    return report


def main(args: list[str] | None = None) -> None:
    """`analyze` (also without the word) writes the reports, `verify` says whether a table can be analysed."""
    args = sys.argv[1:] if args is None else list(args)
    command = args.pop(0) if args and args[0] in ("analyze", "verify") else "analyze"
    defaults = load_settings()
    parser = argparse.ArgumentParser(prog=f"spanloom {command}", description="Analyses a table of observations.")
    parser.add_argument("observations", help="parquet of video_id, track_id, frame, cx, cy, confidence, class_name")
    parser.add_argument("--out", required=command == "analyze", help="folder for the reports (of verify: for the table of all videos)")
    parser.add_argument("--format", default=defaults.format, choices=("parquet", "json", "orc", "csv"))
    parser.add_argument("--every", type=int, default=defaults.frame_stride, help="keep every n-th frame")
    parser.add_argument("--max-frames", type=int, default=defaults.max_frames, help="keep so many frames of each video at most (0: all)")
    parser.add_argument("--ball", default=defaults.ball, help="class name of the ball")
    parser.add_argument("--embeddings", help="parquet of track_id and vector, for the appearance of fragments")
    parser.add_argument("--no-embeddings", action="store_true", default=not defaults.embeddings, help="link without appearance")
    parser.add_argument("--stages", "--only", nargs="*", dest="stages", help="tables to write")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    obs = sampled(spark.read.parquet(chosen.observations), chosen.every, chosen.max_frames, unplaced=command == "verify")
    if command == "verify":
        print(json.dumps(verify_report(obs, chosen.out, chosen.format)))
        return
    vectors = spark.read.parquet(chosen.embeddings) if chosen.embeddings and not chosen.no_embeddings else None
    written = {}
    for name, table in analyse(obs, chosen.ball, defaults.frame_height, vectors).items():
        if not chosen.stages or name in chosen.stages:
            if chosen.format == "csv":
                table = table.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else c for c, kind in table.dtypes))
            write_report(table, f"{chosen.out}/{name}", chosen.format)
            written[name] = f"{chosen.out}/{name}"
    print(json.dumps(written))


if __name__ == "__main__":
    main()
