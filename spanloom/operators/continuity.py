"""Identity linking: candidate pairs, link scores and decisions, one-to-one matching, lineages."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, clamp, decay, dot, fixed, saturate, weighted
from ..sources.durable import cut_lineage, cut_lineage_counted, forget
from ..sources.shipping import ship_package
from .asof import covering
from .pairing import MEASURES, block_pairs, grids_with_cells, score_blocks
from .spatial import nearest_distance_to

# Fixed values of the link model.
MIN_GAP, MAX_GAP, HORIZON = 1, 45, 30
WEIGHTS = {"temporal": 0.26, "spatial": 0.26, "velocity": 0.20, "geometry": 0.14, "persistence": 0.14, "appearance": 0.22, "event": 0.08}
TEMPORAL_SCALE, SPATIAL_SCALE, VELOCITY_SCALE, SIZE_SCALE, PERSISTENCE_SCALE, BALL_SCALE = 24.0, 120.0, 8.0, 40.0, 60.0, 140.0
TOLERANCE_BASE, TOLERANCE_SPREAD, TOLERANCE_GAP, TOLERANCE_MOST = 3.0, 2.5, 0.12, 10.0
BAND, BAND_MARKS = 20, 10_000  # edges a fragment that one band of a matching writes, and the steps of score they are counted by
TOGETHER, SLICES = 64, 16  # fragments of one first frame that meet a source as one row, and parts that a bucket's sources are dealt into
LEAST_COSINE, FAR, SOFT_FAR, FAR_DIAGONALS, ACCEPT = 0.20, 260.0, 150.0, 3.0, 0.55
MODEL = {"weights": WEIGHTS, "scales": {"temporal": TEMPORAL_SCALE, "spatial": SPATIAL_SCALE, "velocity": VELOCITY_SCALE, "geometry": SIZE_SCALE, "persistence": PERSISTENCE_SCALE, "event": BALL_SCALE},
         "tolerance": {"base": TOLERANCE_BASE, "spread": TOLERANCE_SPREAD, "gap": TOLERANCE_GAP, "most": TOLERANCE_MOST}, "horizon": HORIZON, "least_gap": MIN_GAP, "most": MAX_GAP, "far": FAR}
HUGE = "spark.sql.codegen.hugeMethodLimit"
COUNTED = 500  # sources, about, at which a bounded matching counts its edges
REASONS = ("TEMPORAL_OVERLAP", "LONG_GAP", "CONTRADICTORY_APPEARANCE", "SPATIAL_VELOCITY_CONFLICT", "PREDICTION_ERROR_TOO_LARGE", "BELOW_THRESHOLD", "SUPERSEDED_BY_STRONGER_LINK")
TARGET_BITS = 50  # of a fragment's number in a packed link; the rest holds the gap and the reason


def candidate_pairs(fragments: DataFrame, most: int = MAX_GAP) -> DataFrame:
    """Pairs (a, b) of one video where b begins 1 to `most` frames after a's end.

    A range join as an equi-join: see `_near`. Fragments that begin in one frame meet a source as one row and are told apart
    after it, so nearly all of the time goes into the pairs that are returned. A row holds at most TOGETHER of them, whatever
    the data, as what comes of one row is held at once.
    """
    a = fragments.select("video_id", F.col("fragment_id").alias("src"), F.col("last_frame").alias("src_last"))
    b = fragments.select("video_id", F.col("fragment_id").alias("tgt"), F.col("first_frame").alias("tgt_first"))
    number = F.row_number().over(Window.partitionBy("video_id", "tgt_first").orderBy("tgt"))
    b = b.withColumn("block", F.floor((number - 1) / TOGETHER)).groupBy("video_id", "tgt_first", "block").agg(F.collect_list("tgt").alias("tgts"))
    # sources are dealt out further, so that a frame in which many fragments begin is no one task's work
    a = a.withColumn("slice", F.pmod(F.hash("src"), F.lit(SLICES)))
    b = b.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return _near(a, b, most, "slice").select("video_id", "src", F.explode("tgts").alias("tgt"), "gap").where(F.col("src") != F.col("tgt"))


def _near(a: DataFrame, b: DataFrame, most: int = MAX_GAP, *more: str) -> DataFrame:
    """Rows of a (src_last) beside those of b (tgt_first) that begin 1 to `most` frames after, with `gap`; `more` columns must be equal.

    a's end is entered in every bucket of a fifth of `most` frames where such a b may begin, so most of what meets in a bucket
    is a pair. Both sides are dealt by number, as pairs are many more than rows: their size says nothing about the work.
    """
    width, spark = max(1, most // 5), a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["video_id", "bucket", *more]
    last = F.col("src_last")
    a = a.withColumn("bucket", F.explode(F.sequence(F.floor((last + MIN_GAP) / width), F.floor((last + most) / width))))
    b = b.withColumn("bucket", F.floor(F.col("tgt_first") / width))
    gap = F.col("tgt_first") - F.col("src_last")
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).withColumn("gap", gap).where(F.col("gap").between(MIN_GAP, most))


def score_links(pairs: DataFrame, fragments: DataFrame, leaving: DataFrame, entering: DataFrame, vectors: DataFrame | None = None,
                balls: DataFrame | None = None) -> DataFrame:
    """Pairs with prediction error (in pixels, in diagonals, widths and heights of the target, and by frame of the gap), velocity difference and tolerance, cosine, and the weighted score of the terms there are.

    fragments: fragment_id, track_id, n, start and end centre, mean_w, mean_h; leaving and entering: velocities at a
    fragment's end and start; vectors: (track_id, vector), optional; balls: (video_id, frame, bx, by), optional: with them the
    pairs are written once, on the way to the ball that is nearest to the middle between where one was going and the other began.
    """
    def side(prefix, velocities):
        columns = ["n", "start_x", "start_y", "end_x", "end_y", "mean_w", "mean_h", "track_id"]
        # both are dealt by track already, so this join needs no shuffle
        velocity = velocities.select("video_id", "track_id", "fragment_id", "vx", "vy", "dispersion", "moving")
        joined = fragments.select("video_id", "fragment_id", *columns).join(velocity, ["video_id", "track_id", "fragment_id"])
        if vectors is not None:
            joined = joined.join(vectors.select("track_id", "vector"), "track_id", "left")
        else:
            joined = joined.withColumn("vector", F.lit(None).cast("array<float>"))
        joined = joined.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))  # once a fragment, not once a pair
        return joined.select("video_id", *(F.col(c).alias(f"{prefix}_{c}") for c in joined.columns if c != "video_id"))

    p = (pairs.withColumn("a_fragment_id", F.col("src")).join(side("a", leaving), ["video_id", "a_fragment_id"])
         .withColumn("b_fragment_id", F.col("tgt")).join(side("b", entering), ["video_id", "b_fragment_id"]))
    p = _measured(p)
    if balls is not None:
        p = nearest_distance_to(p, balls, "mid_x", "mid_y", "bx", "by", out="ball_distance")
    else:
        p = p.withColumn("ball_distance", F.lit(None).cast("double"))
    return _scored(p)


def _measured(p: DataFrame) -> DataFrame:
    """Pairs with columns a_ and b_ of both fragments, measured."""
    ahead = F.greatest(F.lit(0), F.least(F.lit(HORIZON), F.lit(MAX_GAP), F.col("gap")))
    reach_x, reach_y = F.col("a_end_x") + F.col("a_vx") * ahead, F.col("a_end_y") + F.col("a_vy") * ahead
    error = F.hypot(reach_x - F.col("b_start_x"), reach_y - F.col("b_start_y"))
    off = F.hypot(F.col("a_vx") - F.col("b_vx"), F.col("a_vy") - F.col("b_vy"))
    tolerance = F.least(F.lit(TOLERANCE_MOST), F.lit(TOLERANCE_BASE) + F.lit(TOLERANCE_SPREAD) * F.greatest("a_dispersion", "b_dispersion")
                        + F.lit(TOLERANCE_GAP) * F.col("gap"))
    size = F.abs(F.col("a_mean_w") - F.col("b_mean_w")) + F.abs(F.col("a_mean_h") - F.col("b_mean_h"))
    aspect = F.abs(F.col("a_mean_w") / (F.col("a_mean_h") + EPS) - F.col("b_mean_w") / (F.col("b_mean_h") + EPS))
    diagonal = F.greatest(F.lit(EPS), F.hypot("b_mean_w", "b_mean_h"))
    similar = F.when((F.size("a_vector") == F.size("b_vector")) & (F.col("a_norm") > EPS) & (F.col("b_norm") > EPS),
                     dot(F.col("a_vector"), F.col("b_vector")) / (F.col("a_norm") * F.col("b_norm")))
    return p.select("video_id", "src", "tgt", "gap", "a_n", "b_n", "a_moving", error.alias("error"), off.alias("velocity_off"), tolerance.alias("tolerance"),
                 (error / diagonal).alias("diagonals"), (error / F.greatest(F.lit(EPS), "b_mean_w")).alias("widths"),
                 (error / F.greatest(F.lit(EPS), "b_mean_h")).alias("heights"), (error / F.greatest(F.lit(MIN_GAP), "gap")).alias("per_frame"), size.alias("size_off"), aspect.alias("aspect_off"), similar.alias("cosine"),
                 ((reach_x + F.col("b_start_x")) / 2).alias("mid_x"), ((reach_y + F.col("b_start_y")) / 2).alias("mid_y"))


def _scored(p: DataFrame) -> DataFrame:
    terms = {
        "temporal": decay(F.col("gap"), TEMPORAL_SCALE), "spatial": decay(F.col("error"), SPATIAL_SCALE),
        "velocity": decay(F.col("velocity_off"), VELOCITY_SCALE), "geometry": F.exp(-(F.col("size_off") / SIZE_SCALE + F.col("aspect_off"))),
        "persistence": saturate(F.least("a_n", "b_n").cast("double"), PERSISTENCE_SCALE),
        "appearance": F.when(F.col("cosine").isNotNull(), clamp((F.col("cosine") + 1.0) / 2.0)),
        "event": decay(F.col("ball_distance"), BALL_SCALE)}
    return p.withColumn("score", fixed(weighted({name: (value, WEIGHTS[name]) for name, value in terms.items()})))


def link_ends(fragments: DataFrame, leaving: DataFrame, entering: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row a fragment with all that a link asks of it, as source and as target; arguments as for `score_links`."""
    keys = ["video_id", "track_id", "fragment_id"]

    def side(prefix: str, velocities: DataFrame) -> DataFrame:
        return velocities.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in ("vx", "vy", "dispersion", "moving")))

    ends = fragments.select(*keys, "first_frame", "last_frame", "n", "start_x", "start_y", "end_x", "end_y", "mean_w", "mean_h").join(
        side("leaving", leaving), keys).join(side("entering", entering), keys)
    ends = ends.join(vectors.select("track_id", "vector"), "track_id", "left") if vectors is not None else ends.withColumn("vector", F.lit(None).cast("array<float>"))
    return ends.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))


def linked(ends: DataFrame, targets: DataFrame | None = None, cells: DataFrame | None = None, more: tuple[str, ...] = (), least: float | None = None,
           columns: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of `candidate_pairs`, measured and scored like `score_links`, but formed with both fragments' columns at once: blocks
    of fragments meet, and pairs stream from them to whoever takes them, and are neither shuffled nor written.

    ends: of `link_ends`, as sources; targets: those that may follow, else the same; cells: of `spatial.nearest_cells` over balls;
    more: further columns of the sources to keep; least: pairs that cannot be accepted with such a score are left out, most of them
    before their vectors and balls are looked at; columns: those to return, else all, as only what is asked for is measured.
    """
    common = ["n", "mean_w", "mean_h", "vector", "norm"]
    velocity = ["vx", "vy", "dispersion"]
    a = ends.select("video_id", F.col("fragment_id").alias("src"), F.col("last_frame").alias("src_last"), "end_x", "end_y", F.col("leaving_moving").alias("moving"),
                    *common, *(F.col(f"leaving_{c}").alias(c) for c in velocity), *more)
    b = (targets if targets is not None else ends).select("video_id", F.col("fragment_id").alias("tgt"), F.col("first_frame").alias("tgt_first"), "start_x", "start_y",
                                                          *common, *(F.col(f"entering_{c}").alias(c) for c in velocity))
    pairs = block_pairs(a, b, MIN_GAP, MAX_GAP)
    if cells is not None:
        pairs = pairs.join(F.broadcast(grids_with_cells(cells)), "video_id", "left")
    ship_package(ends.sparkSession)
    names = columns or ("video_id", "src", "tgt", "gap", "a_n", "b_n", "a_moving", *more, *MEASURES)
    return score_blocks(pairs, list(names), {name: ends.schema[name].dataType.simpleString() for name in more}, MODEL, least)


def decide(links: DataFrame) -> DataFrame:
    """The first guard that fires rejects; a null makes a guard silent."""
    reason = (F.when(F.col("gap") < MIN_GAP, "TEMPORAL_OVERLAP").when(F.col("gap") > MAX_GAP, "LONG_GAP")
              .when(F.col("cosine") < LEAST_COSINE, "CONTRADICTORY_APPEARANCE")
              .when((F.col("error") > FAR) | ((F.col("error") > SOFT_FAR) & (F.col("velocity_off") > F.col("tolerance"))), "SPATIAL_VELOCITY_CONFLICT")
              .when(F.col("a_moving") & (F.col("diagonals") > FAR_DIAGONALS), "PREDICTION_ERROR_TOO_LARGE")
              .when(F.col("score") < ACCEPT, "BELOW_THRESHOLD"))
    decided = links.withColumn("rejection_reason", reason)
    return decided.withColumns({
        "decision": F.when(F.col("rejection_reason").isNull(), "ACCEPTED").otherwise("REJECTED"),
        "confidence": F.when(F.col("rejection_reason").isNull() | (F.col("rejection_reason") == "BELOW_THRESHOLD"), F.col("score")).otherwise(F.lit(0.0))})


def superseded(links: DataFrame, matched: DataFrame) -> DataFrame:
    """Decided links, of which those accepted but not matched are rejected after all."""
    won = matched.select("video_id", "src", "tgt", F.lit(True).alias("won"))
    lost = (F.col("decision") == "ACCEPTED") & F.col("won").isNull()
    return links.join(won, ["video_id", "src", "tgt"], "left").withColumns({
        "rejection_reason": F.when(lost, "SUPERSEDED_BY_STRONGER_LINK").otherwise(F.col("rejection_reason")),
        "decision": F.when(lost, "REJECTED").otherwise(F.col("decision"))}).drop("won")


def superseded_from(links: DataFrame) -> DataFrame:
    """`superseded`, of links that carry with their source the target that it was matched with (`won`, else null): no join of pairs."""
    lost = (F.col("decision") == "ACCEPTED") & ~F.col("tgt").eqNullSafe(F.col("won"))
    return links.withColumns({
        "rejection_reason": F.when(lost, "SUPERSEDED_BY_STRONGER_LINK").otherwise(F.col("rejection_reason")),
        "decision": F.when(lost, "REJECTED").otherwise(F.col("decision"))}).drop("won")


def nearest_refusals(links: DataFrame) -> DataFrame:
    """(video_id, src, tgt, gap, rejection_reason): each source's rejected link of least gap, then lowest target.

    What orders links is packed in one long with the reason, so that they are aggregated by hash as they come and never sorted.
    """
    reasons = F.array(*(F.lit(r) for r in REASONS))
    code = F.array_position(reasons, F.col("rejection_reason"))
    fits = (F.col("tgt") >= 0) & (F.col("tgt") < 1 << TARGET_BITS)
    packed = F.when(fits, F.shiftleft(F.shiftleft(F.col("gap"), TARGET_BITS) + F.col("tgt"), 3) + code).otherwise(F.raise_error(F.lit("a fragment's number has more bits than a packed link holds")))
    best = links.where("decision = 'REJECTED'").groupBy("video_id", "src").agg(F.min(packed).alias("b"))
    place = F.shiftright("b", 3)
    return best.select("video_id", "src", place.bitwiseAND(F.lit((1 << TARGET_BITS) - 1)).alias("tgt"), F.shiftright(place, TARGET_BITS).alias("gap"),
                       F.element_at(reasons, F.col("b").bitwiseAND(F.lit(7)).cast("int")).alias("rejection_reason"))


def greedy_matching(edges: DataFrame) -> DataFrame:
    """(video_id, src, tgt, score) of the one-to-one matching that takes edges by (score desc, src, tgt) while both ends are free.

    In each round the edges that are first at both of their ends are taken together and what they touch is left out of the
    next; that gives what one edge after the other would. Rounds are few (at most one more than the longest chain of ever
    better neighbours). Edges are dealt by source once and stay where they are: a round moves each end's best edge alone,
    meets these, writes those taken and the edges that are left, and deletes what the round before wrote.
    """
    rank = F.struct((-F.col("score")).alias("down"), "src", "tgt")
    left = cut_lineage(edges.select("video_id", "src", "tgt", "score").repartition("video_id", "src"), "edges")
    taken = []
    while True:
        best_src = left.groupBy("video_id", "src").agg(F.min(rank).alias("best")).select("video_id", "best")
        best_tgt = left.groupBy("video_id", "tgt").agg(F.min(rank).alias("best")).select("video_id", "best")
        both = best_src.join(best_tgt, ["video_id", "best"]).select("video_id", "best.src", "best.tgt", (-F.col("best.down")).alias("score"))
        won, count = cut_lineage_counted(both, "matching", won=F.count(F.lit(1)))
        taken.append(won)
        if not count["won"]:
            break
        rest, count = cut_lineage_counted(left.join(won.select("video_id", "src"), ["video_id", "src"], "left_anti").join(
            won.select("video_id", "tgt"), ["video_id", "tgt"], "left_anti"), "edges", edges=F.count(F.lit(1)))
        forget(left)
        left = rest
        if not count["edges"]:
            break
    forget(left)
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def matching_in_bands(edges: Callable[..., DataFrame], ends: DataFrame, share: int = BAND, bounded: bool = False) -> DataFrame:
    """`greedy_matching` of edges that are too many to be written: `edges(sources, targets)` forms those between rows of ends (video_id,
    fragment_id, ...) anew each time it is asked; of a bounded one, `edges(sources, targets, least)` those of a score from `least` on.

    Edges are taken by falling score, so those from a score on can be matched by themselves, and what they match is then out
    of the reach of all others. In each band the edges between free fragments are counted by score; those of the best
    scores, as many as `share` a fragment, are written and matched. Few fragments are free afterwards, and so the next bands
    have few pairs to form. The last band holds all edges that are left. Where a band ends decides on the work and not on the
    result, so bounded edges are counted at every so many-th source only.
    """
    sources = targets = ends
    most = share * ends.count()
    mark = F.floor(F.col("score") * BAND_MARKS).alias("mark")
    with _methods_that_are_compiled(ends.sparkSession):
        return _in_bands(edges, sources, targets, mark, most, bounded)


@contextlib.contextmanager
def _methods_that_are_compiled(spark: SparkSession) -> Iterator[None]:
    """Forming and scoring a pair in one generated method makes it longer than what the JVM compiles (8000 bytes): it would be
    interpreted, many times slower. Within, Spark splits such stages; the session's setting is as before afterwards."""
    before = spark.conf.get(HUGE)
    spark.conf.set(HUGE, "8000")
    try:
        yield
    finally:
        spark.conf.set(HUGE, before)


def _in_bands(edges: Callable[..., DataFrame], sources: DataFrame, targets: DataFrame, mark: Column, most: int, bounded: bool) -> DataFrame:
    matched, every = None, 1
    while True:
        asked = sources
        if bounded and (every := max(1, sources.count() // COUNTED)) > 1:
            asked = cut_lineage(sources.where(F.pmod(F.xxhash64("video_id", "fragment_id"), F.lit(every)) == 0), "asked")
        counts = sorted(((r["mark"], r["n"] * every) for r in edges(asked, targets).groupBy(mark).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        taken = list(itertools.takewhile(lambda c: c <= most, itertools.accumulate(n for _, n in counts)))
        last = max(1, len(taken))
        if last >= len(counts):
            won = greedy_matching(edges(sources, targets))
        else:
            from_ = counts[last - 1][0]
            won = greedy_matching((edges(sources, targets, from_ / BAND_MARKS) if bounded else edges(sources, targets)).where(mark >= from_))
        matched = won if matched is None else matched.unionByName(won)
        if last >= len(counts):
            return matched

        def free(rows: DataFrame, end: str) -> DataFrame:
            return cut_lineage(rows.join(won.select("video_id", F.col(end).alias("fragment_id")), ["video_id", "fragment_id"], "left_anti"), "free")

        sources, targets = free(sources, "src"), free(targets, "tgt")


def lineages(nodes: DataFrame, links: DataFrame, rounds: int = 64) -> DataFrame:
    """(video_id, node, head) for nodes joined by one-to-one links (src, tgt), by pointer jumping: log2 of the longest path rounds."""
    before = links.select("video_id", F.col("tgt").alias("node"), F.col("src").alias("head"))
    jump = cut_lineage(nodes.select("video_id", "node").join(before, ["video_id", "node"], "left").select(
        "video_id", "node", F.coalesce("head", "node").alias("head")), "jump")
    for _ in range(rounds):
        onward = jump.select("video_id", F.col("node").alias("head"), F.col("head").alias("next"))
        met, count = cut_lineage_counted(jump.join(onward, ["video_id", "head"]), "jump", moved=F.count_if(F.col("next") != F.col("head")))
        jump = met.select("video_id", "node", F.col("next").alias("head"))
        if not count["moved"]:
            return jump
    raise RuntimeError("links do not end: they are no paths")


def lineage_table(members: DataFrame, fragments: DataFrame, matched: DataFrame) -> DataFrame:
    """One row a lineage: members in order of their first frame, frame range, and the mean score of its links (1 without any)."""
    entered = matched.select("video_id", F.col("tgt").alias("node"), "score")
    held = members.join(fragments.select("video_id", F.col("fragment_id").alias("node"), "first_frame", "last_frame"), ["video_id", "node"]).join(
        entered, ["video_id", "node"], "left")
    return held.groupBy("video_id", F.col("head").alias("canonical_id")).agg(
        F.count(F.lit(1)).alias("members"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"),
        fixed(F.coalesce(F.avg("score"), F.lit(1.0))).alias("confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_frame", "node"))), lambda m: m["node"].cast("string")), ",").alias("chain"))


def identity_keys(members: DataFrame, heroes: DataFrame) -> DataFrame:
    """(video_id, node, key) of nodes in a resolved identity: a lineage of several, or that of the video's hero, whose key is the hero.

    heroes: (video_id, node). Nodes that were joined with nothing have no key: nothing is claimed for them.
    """
    sizes = members.groupBy("video_id", "head").agg(F.count(F.lit(1)).alias("size"))
    own = members.join(heroes, ["video_id", "node"], "left_semi").select("video_id", "head").join(
        heroes.select("video_id", F.col("node").alias("hero")), "video_id")
    held = members.join(sizes, ["video_id", "head"]).join(own, ["video_id", "head"], "left")
    return held.where((F.col("size") > 1) | F.col("hero").isNotNull()).select("video_id", "node", F.coalesce("hero", "head").alias("key"))


def hero_members(members: DataFrame, fragments: DataFrame, heroes: DataFrame) -> DataFrame:
    """(video_id, head, hero_fragment, node): all members of the lineage of the first fragment of each video's hero track."""
    first = fragments.join(heroes.select("video_id", "track_id"), ["video_id", "track_id"]).groupBy("video_id").agg(
        F.min_by("fragment_id", "first_frame").alias("hero_fragment"))
    own = members.join(first, "video_id").where(F.col("node") == F.col("hero_fragment")).select("video_id", "head", "hero_fragment")
    return own.join(members, ["video_id", "head"])


def hero_identity(videos: DataFrame, hero: DataFrame, links: DataFrame, fragments: DataFrame, matched: DataFrame, heroes: DataFrame | None = None) -> DataFrame:
    """Each video's hero as an identity: fragments, range, confidence, and why it goes no further.

    `fallback` says that there is no hero, that the hero's track (of heroes: video_id, track_id) has no fragment, or that the
    hero's fragment stays alone though a link from it was tried and refused (then with the refused target of least gap, its
    reason and score). hero: of hero_members; links: with superseded ones rejected.
    """
    own = lineage_table(hero.select("video_id", F.col("hero_fragment").alias("head"), "node"), fragments, matched).drop("chain")
    first = F.min_by(F.struct("tgt", "rejection_reason", "score"), F.struct("gap", "tgt"))
    refused = links.where("decision = 'REJECTED'").groupBy("video_id", F.col("src").alias("canonical_id")).agg(first.alias("r"))
    out = videos.join(own, "video_id", "left").join(refused, ["video_id", "canonical_id"], "left")
    named = F.lit(None).cast("long")
    if heroes is not None:
        out, named = out.join(heroes.select("video_id", F.col("track_id").alias("hero_track")), "video_id", "left"), F.col("hero_track")
    lost = F.col("canonical_id").isNull() & named.isNotNull()
    alone = F.col("members") == 1
    return out.select(
        "video_id", F.coalesce("canonical_id", named).alias("canonical_id"), F.when(lost, 1).otherwise(F.coalesce("members", F.lit(0))).cast("long").alias("members"),
        "first_frame", "last_frame", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(lost, "HERO_FRAGMENT_MISSING").when(F.col("canonical_id").isNull(), "NO_HERO_TRACK")
        .when(alone & F.col("r").isNotNull(), "UNRESOLVED_TRACK_FRAGMENT").alias("fallback"),
        F.when(alone, F.col("r.tgt")).alias("refused"), F.when(alone, F.col("r.rejection_reason")).alias("refused_reason"),
        F.when(alone, F.col("r.score")).alias("refused_score"))


def chain_pairs(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """(video_id, head, place, node, next, gap): each two fragments that follow each other in a lineage, in order of their first frame."""
    held = members.join(fragments.select("video_id", F.col("fragment_id").alias("node"), "first_frame", "last_frame"), ["video_id", "node"])
    order = Window.partitionBy("video_id", "head").orderBy("first_frame", "node")
    after = F.lead(F.struct("node", "first_frame")).over(order)
    return held.select("video_id", "head", (F.row_number().over(order) - 1).alias("place"), "node", "last_frame", after.alias("after")).where("after IS NOT NULL").select(
        "video_id", "head", "place", "node", F.col("after.node").alias("next"), (F.col("after.first_frame") - F.col("last_frame")).alias("gap"))


def active_at(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Which interval (first_frame, last_frame, member) of the video holds a frame, the first in order if several; null if none."""
    met = covering(frames, intervals, ["video_id"], "frame", "first_frame", "last_frame", ["member"])
    return met.select(*frames.columns, F.col("match.member").alias("member"))
