"""Series and cuts: resampled positions, speed profiles, motion, cut boundaries, shot contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, clamp, cosine, fixed, weighted
from .asof import as_of, covering

# Fixed values of the cut model.
CUT_LEVEL, CUT_RATIO, BASELINE, FULL_RATIO, REAL_CUT = 18.0, 3.0, 6, 4.0, 0.60
CUT_WEIGHTS = {"motion_change": 0.45, "scene_change": 0.25, "appearance_change": 0.15, "tracking_discontinuity": 0.15}
SMOOTH, SECOND_AFTER, SECOND_RATIO, ONSET_RATIO = 5, 24, 0.30, 0.35
TRACK = ["video_id", "track_id"]


def hold_last(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every frame from a series' first to its last, with its own centre or the last one before, and whether it is held."""
    keys = keys or TRACK
    spine = obs.groupBy(*keys).agg(F.min("frame").alias("a"), F.max("frame").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("frame"))
    return as_of(spine, obs, keys, "frame", ["cx", "cy"]).select(
        *keys, "frame", F.col("match.cx").alias("cx"), F.col("match.cy").alias("cy"), (F.col("match.at") != F.col("frame")).alias("held"))


def track_targets(spans: DataFrame, obs: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """The centre to follow at every frame of spans (video_id, track_id, start_frame, end_frame): (video_id, track_id, frame, cx,
    cy, held, and with an identity fragment, identity).

    A frame without an observation holds the last centre before it, one before the track's first observation that first
    one. Tracks without observations have no targets. identity: (video_id, canonical, fragment, first_frame, last_frame), the
    fragments of each video's identity: the one active at a frame is its `fragment`, else the track itself.
    """
    frames = spans.select("video_id", "track_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    first = obs.groupBy("video_id", "track_id").agg(F.min_by(F.struct("cx", "cy"), "frame").alias("first"))
    met = as_of(frames, obs, TRACK, "frame", ["cx", "cy"]).join(first, TRACK)
    own = F.col("match").isNotNull()
    out = met.select("video_id", "track_id", "frame", fixed(F.when(own, F.col("match.cx")).otherwise(F.col("first.cx")), 3).alias("cx"),
                     fixed(F.when(own, F.col("match.cy")).otherwise(F.col("first.cy")), 3).alias("cy"),
                     (~F.coalesce(F.col("match.at") == F.col("frame"), F.lit(False))).alias("held"))
    if identity is None:
        return out
    names = identity.groupBy("video_id").agg(F.min("canonical").alias("identity"))
    return covering(out, identity, ["video_id"], "frame", "first_frame", "last_frame", ["fragment"]).join(names, "video_id", "left").select(
        *out.columns, F.coalesce("match.fragment", "track_id").alias("fragment"), "identity")


def group_geometry(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("video_id", "frame").agg(
        F.avg("cx").alias("mean_x"), F.min("x1").alias("left"), F.max("x2").alias("right"), F.count(F.lit(1)).alias("n"))


def dominant_track(boxes: DataFrame, persons: DataFrame) -> DataFrame:
    """The track with the largest box in each frame, of equal ones the lowest id; only person-sized tracks (video_id, track_id,
    person_sized) count in videos that have any."""
    some = persons.groupBy("video_id").agg(F.bool_or("person_sized").alias("some"))
    met = boxes.join(persons, TRACK).join(some, "video_id").where(F.col("person_sized") | ~F.col("some"))
    return met.groupBy("video_id", "frame").agg(F.max_by("track_id", F.struct("area", -F.col("track_id"))).alias("track_id"))


def motion_profile(motion: DataFrame, half: int, step: int) -> DataFrame:
    """Mean and peak (first frame of the maximum) of the closed window around every `step`-th frame."""
    near = Window.partitionBy("video_id").orderBy("frame").rangeBetween(-half, half)
    return motion.select("video_id", "frame", F.avg("value").over(near).alias("mean"), F.max("value").over(near).alias("peak"),
                         F.max(F.struct("value", (-F.col("frame")).alias("f"))).over(near)["f"].alias("f")).where(
        F.col("frame") % step == 0).select("video_id", "frame", "mean", "peak", (-F.col("f")).alias("peak_frame"))


def change_percentiles(motion: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("frame")
    change = motion.withColumn("change", F.abs(F.col("value") - F.lag("value").over(order)))
    return change.groupBy("video_id").agg(F.avg("change").alias("mean_change"), F.percentile("change", F.array(F.lit(0.95), F.lit(0.99))).alias("p")).select(
        "video_id", "mean_change", F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"))


def shift_summary(geometry: DataFrame) -> DataFrame:
    """Samples, mean and range of the frame-to-frame shift of a group's mean position."""
    order = Window.partitionBy("video_id").orderBy("frame")
    return geometry.withColumn("dx", F.col("mean_x") - F.lag("mean_x").over(order)).groupBy("video_id").agg(
        F.count("dx").alias("samples"), F.avg("dx").alias("mean_dx"), F.min("dx").alias("min_dx"), F.max("dx").alias("max_dx"),
        (F.count("dx") > 0).alias("available"))


def frame_transforms(obs: DataFrame, least: int = 8) -> DataFrame:
    """How the picture moved up to each frame: shift, scale and rotation (degrees) of the similarity that takes the places where
    its tracks were seen before to where they are, by least squares over at least `least` tracks that don't all lie on one point.

    obs: (video_id, track_id, frame, cx, cy). All is sums over a frame's tracks.
    """
    order = Window.partitionBy(*TRACK).orderBy("frame")
    p = obs.select("video_id", "frame", F.lag("cx").over(order).alias("px"), F.lag("cy").over(order).alias("py"), F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    s = p.where("px IS NOT NULL AND py IS NOT NULL AND qx IS NOT NULL AND qy IS NOT NULL").groupBy("video_id", "frame").agg(
        F.count(F.lit(1)).alias("tracks"), *(F.avg(c).alias(c) for c in ("px", "py", "qx", "qy")),
        F.avg(px * px + py * py).alias("pp"), F.avg(px * qx + py * qy).alias("pq"), F.avg(px * qy - py * qx).alias("cross"))
    spread = F.col("pp") - px * px - py * py
    s = s.where((F.col("tracks") >= least) & (spread > EPS)).withColumns({
        "a": (F.col("pq") - px * qx - py * qy) / spread, "b": (F.col("cross") - px * qy + py * qx) / spread})
    a, b = F.col("a"), F.col("b")
    return s.select("video_id", "frame", "tracks", (qx - (a * px - b * py)).alias("dx"), (qy - (b * px + a * py)).alias("dy"),
                    F.hypot(a, b).alias("scale"), F.degrees(F.atan2(b, a)).alias("rotation_deg"))


def evidence(videos: DataFrame, persons: DataFrame, balls: DataFrame, found: DataFrame, motion: DataFrame, shifts: DataFrame) -> DataFrame:
    """All that is measured of each video, in one row: tracks and person-sized ones, balls and their frames, cuts, motion and
    its first peak, shifts of the picture. What was not seen counts 0, and its frames are null."""
    parts = (
        persons.groupBy("video_id").agg(F.count(F.lit(1)).alias("tracks"), F.count_if("person_sized").alias("person_sized_tracks")),
        balls.groupBy("video_id").agg(F.count(F.lit(1)).alias("balls"), F.min("frame").alias("first_ball"), F.max("frame").alias("last_ball")),
        found.groupBy("video_id").agg(F.count(F.lit(1)).alias("cuts")),
        motion.groupBy("video_id").agg(F.count(F.lit(1)).alias("motion_frames"), F.avg("value").alias("motion_mean"),
                                       F.max_by("frame", F.struct("value", -F.col("frame"))).alias("motion_peak_frame"), F.max("value").alias("motion_peak")),
        shifts.select("video_id", F.col("samples").alias("shifts"), "mean_dx"))
    out = videos
    for part in parts:
        out = out.join(part, "video_id", "left")
    return out.na.fill(0, ["tracks", "person_sized_tracks", "balls", "cuts", "motion_frames", "motion_mean", "motion_peak", "shifts"])


def speed_profile(obs: DataFrame) -> DataFrame:
    """Distance from the observation before, as a centred moving average; the first observation has none."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    steps = obs.select(*TRACK, "frame", F.hypot(F.col("cx") - F.lag("cx").over(order), F.col("cy") - F.lag("cy").over(order)).alias("raw")).where("raw IS NOT NULL")
    return steps.select(*TRACK, "frame", fixed(F.avg("raw").over(order.rowsBetween(-(SMOOTH // 2), SMOOTH // 2)), 4).alias("speed"))


def beats(profile: DataFrame) -> DataFrame:
    """Primary beat (first maximum), secondary beat (a later local maximum that is large enough), and where action sets in."""
    order = Window.partitionBy(*TRACK).orderBy("frame")
    whole = Window.partitionBy(*TRACK)
    p = profile.select("*", F.max("speed").over(whole).alias("most"), F.coalesce(F.lag("speed").over(order), F.lit(0.0)).alias("before"),
                       F.coalesce(F.lead("speed").over(order), F.lit(0.0)).alias("after"))
    p = p.where("most > 1e-6").withColumn("primary", F.min(F.when(F.col("speed") == F.col("most"), F.col("frame"))).over(whole))
    local = ((F.col("frame") >= F.col("primary") + SECOND_AFTER) & (F.col("speed") >= SECOND_RATIO * F.col("most"))
             & (F.col("speed") >= F.col("before")) & (F.col("speed") >= F.col("after")))
    slow = (F.col("frame") < F.col("primary")) & (F.col("speed") < ONSET_RATIO * F.col("most"))
    return p.groupBy(*TRACK).agg(
        F.first("primary").alias("primary_beat"), F.max_by("frame", F.when(local, F.struct("speed", -F.col("frame")))).alias("secondary_beat"),
        F.first("most").alias("peak_speed"), F.max(F.when(slow, F.col("frame"))).alias("onset"))


def cuts(motion: DataFrame) -> DataFrame:
    """Frames whose motion is high and several times the mean of the frames before, with that baseline."""
    before = Window.partitionBy("video_id").orderBy("frame").rowsBetween(-BASELINE, -1)
    base = motion.withColumn("baseline", F.avg("value").over(before))
    return base.where((F.col("frame") >= 1) & (F.col("value") > CUT_LEVEL) & (F.col("value") > CUT_RATIO * F.greatest(F.col("baseline"), F.lit(1e-6))))


def _passed(cuts: DataFrame, entries: DataFrame, keys: list[str], at: str, later: bool) -> DataFrame:
    """For each cut the number and the sum of the entries' x whose `at` lies before it (later: at or after it).

    One ordered pass over the entries and cuts of a key; no cut meets an entry.
    """
    line = entries.select(*keys, F.col(at).alias("frame"), "x", F.lit(1).alias("one")).unionByName(
        cuts.select(*keys, "frame", F.lit(None).cast("double").alias("x"), F.lit(0).alias("one")))
    place = -F.col("frame") if later else F.col("frame")
    upto = Window.partitionBy(*keys).orderBy(place).rangeBetween(Window.unboundedPreceding, 0 if later else -1)
    return line.select(*keys, "frame", "one", F.coalesce(F.sum("one").over(upto), F.lit(0)).alias("n"), F.sum("x").over(upto).alias("total")).where("one = 0").drop("one")


def cut_terms(found: DataFrame, ranges: DataFrame, vectors: DataFrame) -> DataFrame:
    """What speaks for each cut: motion, scene, tracks that begin rather than go on, and appearance before against after.

    vectors: (track_id, vector). Tracks that ended before a cut, or begin at or after it, are running sums in the order of
    frames, component by component for their mean vectors. Without tracks of a video, or vectors on both sides, a term is null.
    """
    value, base = F.col("value"), F.col("baseline")
    measured = found.select("video_id", "frame", clamp(value / F.greatest(base, F.lit(EPS)) / FULL_RATIO).alias("motion_change"),
                            clamp((value - base) / F.greatest(F.lit(EPS), value + base)).alias("scene_change"))
    at = found.select("video_id", "frame").join(ranges.select("video_id").distinct(), "video_id", "left_semi")
    counted = ranges.withColumn("x", F.lit(None).cast("double"))
    starting = _passed(at, counted, ["video_id"], "first_frame", True).select("video_id", "frame", F.col("n").alias("starting"))
    lasting = _passed(at, counted, ["video_id"], "last_frame", True).select("video_id", "frame", F.col("n").alias("lasting"))
    tracking = starting.join(lasting, ["video_id", "frame"]).select("video_id", "frame", F.when(
        F.col("lasting") > 0, F.col("starting") / F.col("lasting")).otherwise(F.lit(0.0)).alias("tracking_discontinuity"))
    parts = ranges.join(vectors, "track_id").select("video_id", "first_frame", "last_frame", F.posexplode("vector").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    wanted = found.select("video_id", "frame").join(parts.select("video_id", "at").distinct(), "video_id")
    keys = ["video_id", "at"]
    sides = [_passed(wanted, parts, keys, edge, later).where("n > 0").groupBy("video_id", "frame").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("at", (F.col("total") / F.col("n")).alias("x")))), lambda p: p["x"]).alias(name))
        for name, edge, later in (("pre", "last_frame", False), ("post", "first_frame", True))]
    appearance = sides[0].join(sides[1], ["video_id", "frame"]).select(
        "video_id", "frame", clamp((1.0 - cosine(F.col("pre"), F.col("post"))) / 2.0).alias("appearance_change"))
    return measured.join(tracking, ["video_id", "frame"], "left").join(appearance, ["video_id", "frame"], "left").select(
        "video_id", "frame", *(fixed(F.col(name), 4).alias(name) for name in CUT_WEIGHTS))


def cut_confidence(terms: DataFrame) -> DataFrame:
    sure = weighted({name: (F.col(name), weight) for name, weight in CUT_WEIGHTS.items()})
    return terms.withColumn("raw", sure).select(
        "video_id", "frame", fixed(F.col("raw"), 4).alias("confidence"), F.when(F.col("raw") >= REAL_CUT, "REAL_CUT").otherwise("SOFT_TRANSITION").alias("kind"))


def context_bounds(videos: DataFrame, boundaries: DataFrame, frames: int) -> DataFrame:
    """Half-open stretches between cuts as closed frame ranges, numbered from 1."""
    starts = videos.select("video_id", F.lit(0).cast("long").alias("start_frame")).unionByName(
        boundaries.select("video_id", F.col("frame").alias("start_frame"))).distinct()
    order = Window.partitionBy("video_id").orderBy("start_frame")
    return starts.select("video_id", F.row_number().over(order).alias("context"), "start_frame",
                         (F.coalesce(F.lead("start_frame").over(order), F.lit(frames).cast("long")) - 1).alias("end_frame"))


WIDTH = 64  # frames of a bucket


def overlapping(contexts: DataFrame, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Contexts with the spans that overlap them. Either is entered at every bucket of frames that it touches; a pair counts
    in the first bucket that both touch."""
    def buckets(a, z):
        return F.explode(F.sequence(F.floor(F.col(a) / WIDTH), F.floor(F.col(z) / WIDTH)))

    at = contexts.withColumn("bucket", buckets("start_frame", "end_frame"))
    there = spans.withColumn("bucket", buckets(first, last))
    return at.join(there, ["video_id", "bucket"]).where(
        (F.col(first) <= F.col("end_frame")) & (F.col(last) >= F.col("start_frame"))
        & (F.col("bucket") == F.floor(F.greatest(first, "start_frame") / WIDTH))).drop("bucket")


def primary_subjects(contexts: DataFrame, moving: DataFrame, heroes: DataFrame) -> DataFrame:
    """Each context's subject: the video's hero if it moves in there, else the person-sized track that moves there longest (then lowest id).

    moving: first_frame, last_moving and person_sized of each track.
    """
    met = overlapping(contexts, moving.select("video_id", "track_id", "first_frame", "last_moving", "person_sized"), "first_frame", "last_moving")
    met = met.join(heroes.select("video_id", F.col("track_id").alias("hero")), "video_id", "left")
    overlap = F.least("last_moving", "end_frame") - F.greatest("first_frame", "start_frame") + 1
    is_hero = F.coalesce(F.col("track_id") == F.col("hero"), F.lit(False))
    best = met.where(is_hero | F.col("person_sized")).groupBy("video_id", "context").agg(
        F.max_by(F.struct("track_id", overlap.alias("overlap")), F.struct(is_hero, overlap, -F.col("track_id"))).alias("s"))
    return contexts.join(best, ["video_id", "context"], "left").select("*", F.col("s.track_id").alias("subject"), F.col("s.overlap").alias("overlap")).drop("s")


def relations(subjects: DataFrame, keys: DataFrame) -> DataFrame:
    """How a context's subject relates to that of the context before, by identity keys.

    keys: (video_id, track_id, key) of tracks in resolved identities; a subject without a key leaves the relation unknown.
    """
    named = subjects.join(keys.select("video_id", F.col("track_id").alias("subject"), "key"), ["video_id", "subject"], "left")
    before = F.lag("key").over(Window.partitionBy("video_id").orderBy("context"))
    return named.withColumn("relation", F.when(before.isNull() | F.col("key").isNull(), "UNKNOWN")
                            .when(before == F.col("key"), "SAME_CANONICAL_IDENTITY").otherwise("NEW_IDENTITY"))
