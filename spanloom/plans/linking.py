"""Queries that link fragments to identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuity as co
from ..operators import events as ev
from ..operators import tracks as tr
from ..operators.spatial import nearest_cells
from ..sources import tables as src
from ..sources.durable import shared
from ..sources.tables import FRAG_ROWS, r6
from .core import BALLS, SIGNALS, VELOCITY, signals_of

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ["video_id", "track_id", "fragment_id"]


def query(name: str, sql: str | None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


def fragments_of(spark, d):
    """Fragments and their rows."""
    rows = shared(spark, "fragment-rows", [f"{d}/events.parquet"], lambda: src.fragment_rows(src.observations(spark, d)))
    return tr.track_stats(rows, KEY), rows


FRAGS = FRAG_ROWS + """,
frags AS (
  SELECT video_id, track_id, fragment_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame,
    arg_min(cx, frame) AS start_x, arg_min(cy, frame) AS start_y, arg_max(cx, frame) AS end_x, arg_max(cy, frame) AS end_y, avg(w) AS mean_w, avg(h) AS mean_h
  FROM frows GROUP BY video_id, track_id, fragment_id)"""
PAIRS = FRAGS + """,
pairs AS (
  SELECT a.video_id, a.fragment_id AS src, b.fragment_id AS tgt, b.first_frame - a.last_frame AS gap, a.track_id AS src_track, b.track_id AS tgt_track
  FROM frags a JOIN frags b ON a.video_id = b.video_id AND a.fragment_id <> b.fragment_id
    AND b.first_frame > a.last_frame AND b.first_frame - a.last_frame <= 45)"""


@query("q16_candidate_pairs", f"WITH {PAIRS} SELECT video_id, src, tgt, gap FROM pairs")
def q16(spark, d):
    return co.candidate_pairs(fragments_of(spark, d)[0])


def _start(velocity: str) -> str:
    """The velocity views, at the other end of a fragment."""
    return velocity.replace("ORDER BY frame DESC", "ORDER BY frame").replace("near", "snear").replace("vsteps", "ssteps").replace("mids", "smids").replace("mads", "smads")


LINKS = PAIRS + f""", {BALLS}, {VELOCITY}, {_start(VELOCITY)},
vel AS (SELECT video_id, fragment_id, coalesce(vx, 0.0) AS vx, coalesce(vy, 0.0) AS vy, greatest(coalesce(mad, 0.75), 0.75) AS dispersion, moving
  FROM mids JOIN mads USING (video_id, fragment_id)),
svel AS (SELECT video_id, fragment_id, coalesce(vx, 0.0) AS vx, coalesce(vy, 0.0) AS vy, greatest(coalesce(mad, 0.75), 0.75) AS dispersion
  FROM smids JOIN smads USING (video_id, fragment_id)),
vecs AS (SELECT vec_id AS track_id, embedding::DOUBLE[] AS v FROM embeddings),
measured AS (
  SELECT p.video_id, p.src, p.tgt, p.gap, a.n AS a_n, b.n AS b_n, va.moving AS a_moving,
    sqrt((a.end_x + va.vx * least(30, p.gap) - b.start_x) ** 2 + (a.end_y + va.vy * least(30, p.gap) - b.start_y) ** 2) AS error,
    sqrt((va.vx - vb.vx) ** 2 + (va.vy - vb.vy) ** 2) AS velocity_off,
    least(10.0::DOUBLE, 3.0::DOUBLE + 2.5::DOUBLE * greatest(va.dispersion, vb.dispersion) + 0.12::DOUBLE * p.gap) AS tolerance,
    CASE WHEN ea.v IS NOT NULL AND eb.v IS NOT NULL THEN list_cosine_similarity(ea.v, eb.v) END AS cosine,
    abs(a.mean_w - b.mean_w) + abs(a.mean_h - b.mean_h) AS size_off, abs(a.mean_w / (a.mean_h + 1e-9::DOUBLE) - b.mean_w / (b.mean_h + 1e-9::DOUBLE)) AS aspect_off,
    sqrt(b.mean_w ** 2 + b.mean_h ** 2) AS diagonal, b.mean_w AS b_w, b.mean_h AS b_h,
    list_min(list_transform(c.cloud, lambda z: sqrt(((a.end_x + va.vx * least(30, p.gap) + b.start_x) / 2 - z.bx) ** 2 + ((a.end_y + va.vy * least(30, p.gap) + b.start_y) / 2 - z.by_) ** 2))) AS ball
  FROM pairs p JOIN frags a ON p.video_id = a.video_id AND p.src = a.fragment_id JOIN frags b ON p.video_id = b.video_id AND p.tgt = b.fragment_id
  JOIN vel va ON p.video_id = va.video_id AND p.src = va.fragment_id JOIN svel vb ON p.video_id = vb.video_id AND p.tgt = vb.fragment_id
  LEFT JOIN vecs ea ON p.src_track = ea.track_id LEFT JOIN vecs eb ON p.tgt_track = eb.track_id
  LEFT JOIN (SELECT video_id, list({{'bx': bx, 'by_': by_}}) AS cloud FROM balls GROUP BY video_id) c ON p.video_id = c.video_id),
scored AS (
  SELECT *, error / greatest(1e-9::DOUBLE, diagonal) AS diagonals,
    {r6('''(0.26::DOUBLE * exp(-gap / 24.0::DOUBLE) + 0.26::DOUBLE * exp(-error / 120.0::DOUBLE) + 0.20::DOUBLE * exp(-velocity_off / 8.0::DOUBLE)
      + 0.14::DOUBLE * exp(-(size_off / 40.0::DOUBLE + aspect_off)) + 0.14::DOUBLE * (least(a_n, b_n) / (least(a_n, b_n) + 60.0::DOUBLE))
      + CASE WHEN cosine IS NULL THEN 0.0 ELSE 0.22::DOUBLE * greatest(0.0, least(1.0, (cosine + 1.0::DOUBLE) / 2.0::DOUBLE)) END
      + CASE WHEN ball IS NULL THEN 0.0 ELSE 0.08::DOUBLE * exp(-ball / 140.0::DOUBLE) END)
      / (1.0::DOUBLE + CASE WHEN cosine IS NULL THEN 0.0 ELSE 0.22::DOUBLE END + CASE WHEN ball IS NULL THEN 0.0 ELSE 0.08::DOUBLE END)''')} AS score
  FROM measured),
links AS (
  SELECT *, CASE WHEN gap < 1 THEN 'TEMPORAL_OVERLAP' WHEN gap > 45 THEN 'LONG_GAP' WHEN cosine < 0.20 THEN 'CONTRADICTORY_APPEARANCE'
      WHEN error > 260 OR (error > 150 AND velocity_off > tolerance) THEN 'SPATIAL_VELOCITY_CONFLICT'
      WHEN a_moving AND diagonals > 3.0 THEN 'PREDICTION_ERROR_TOO_LARGE' WHEN score < 0.55 THEN 'BELOW_THRESHOLD' END AS rejection_reason
  FROM scored)"""


TABLES = ("events", "embeddings")
DECIDING = ("video_id", "src", "tgt", "gap", "a_moving", "error", "velocity_off", "tolerance", "diagonals", "cosine", "score")  # what `decide` asks for


def _files(d):
    return [f"{d}/{name}.parquet" for name in TABLES]


def link_parts(spark, d):
    """The fragments' ends and the balls' cells that links are formed from, each written once a session, and fragments and their rows."""
    fragments, rows = fragments_of(spark, d)

    def ends():
        vectors = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))
        return co.link_ends(fragments, tr.edge_velocity(rows, KEY), tr.edge_velocity(rows, KEY, at_start=True), vectors)

    return (shared(spark, "link-ends", _files(d), ends),
            shared(spark, "ball-cells", _files(d), lambda: nearest_cells(ev.ball_centres(rows, src.BALL), "bx", "by")), fragments, rows)


def links_of(spark, d, matched=None, sources=None):
    """Decided links (DECIDING and the decision), fragments and their rows. Pairs grow with the square of a video's fragments: they are formed and scored as
    they are read, and never written. With a matching, links that lost are rejected; with sources (video_id, src), only their links."""
    ends, cells, fragments, rows = link_parts(spark, d)
    begun, more = ends, ()
    if sources is not None:
        begun = begun.join(sources.select("video_id", F.col("src").alias("fragment_id")).distinct(), ["video_id", "fragment_id"], "left_semi")
    if matched is not None:
        begun, more = begun.join(matched.select("video_id", F.col("src").alias("fragment_id"), F.col("tgt").alias("won")), ["video_id", "fragment_id"], "left"), ("won",)
    links = co.decide(co.linked(begun, ends, cells, more, columns=(*DECIDING, *more)))
    return co.superseded_from(links) if matched is not None else links, fragments, rows


@query("q17_link_scores_and_decisions", f"""WITH {LINKS}
SELECT video_id, src, tgt, gap, {r6('error', 3)} AS error, {r6('velocity_off', 3)} AS velocity_off, {r6('tolerance', 3)} AS tolerance,
  {r6('cosine', 4)} AS cosine, score, rejection_reason, CASE WHEN rejection_reason IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision,
  CASE WHEN rejection_reason IS NULL OR rejection_reason = 'BELOW_THRESHOLD' THEN score ELSE 0.0::DOUBLE END AS confidence FROM links""")
def q17(spark, d):
    out = links_of(spark, d)[0]
    return tr.rounded(tr.rounded(out, "error", "velocity_off", "tolerance", places=3), "cosine", places=4).select(
        "video_id", "src", "tgt", "gap", "error", "velocity_off", "tolerance", "cosine", "score", "rejection_reason", "decision", "confidence")


@query("q17b_prediction_errors", f"""WITH {LINKS}
SELECT video_id, src, tgt, gap, {r6('error / greatest(1e-9::DOUBLE, diagonal)', 4)} AS diagonals, {r6('error / greatest(1e-9::DOUBLE, b_w)', 4)} AS widths,
  {r6('error / greatest(1e-9::DOUBLE, b_h)', 4)} AS heights, {r6('error / greatest(1, gap)', 3)} AS per_frame FROM links""")
def q17b(spark, d):
    ends, cells = link_parts(spark, d)[:2]
    errors = co.linked(ends, ends, cells, columns=("video_id", "src", "tgt", "gap", "diagonals", "widths", "heights", "per_frame"))
    out = tr.rounded(errors, "diagonals", "widths", "heights", places=4)
    return tr.rounded(out, "per_frame", places=3).select("video_id", "src", "tgt", "gap", "diagonals", "widths", "heights", "per_frame")


MATCHED = LINKS + """,
numbered AS (SELECT video_id, src, tgt, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, src, tgt) AS i FROM links WHERE rejection_reason IS NULL),
greedy AS (
  SELECT video_id, 0::BIGINT AS i, []::BIGINT[] AS used_src, []::BIGINT[] AS used_tgt, false AS taken FROM (SELECT DISTINCT video_id FROM numbered)
  UNION ALL
  SELECT g.video_id, n.i,
    CASE WHEN list_contains(g.used_src, n.src) OR list_contains(g.used_tgt, n.tgt) THEN g.used_src ELSE list_append(g.used_src, n.src) END,
    CASE WHEN list_contains(g.used_src, n.src) OR list_contains(g.used_tgt, n.tgt) THEN g.used_tgt ELSE list_append(g.used_tgt, n.tgt) END,
    NOT (list_contains(g.used_src, n.src) OR list_contains(g.used_tgt, n.tgt))
  FROM greedy g JOIN numbered n ON g.video_id = n.video_id AND n.i = g.i + 1),
matched AS (SELECT n.video_id, n.src, n.tgt, n.score FROM greedy g JOIN numbered n ON g.video_id = n.video_id AND g.i = n.i WHERE g.taken)"""


def matched_of(spark, d):
    """The matching of the accepted links, fragments and their rows."""
    ends, cells, fragments, rows = link_parts(spark, d)
    matched = shared(spark, "matched", _files(d), lambda: co.matching_in_bands(
        lambda sources, targets, least=co.ACCEPT: co.decide(co.linked(sources, targets, cells, least=least, columns=DECIDING)).where("decision = 'ACCEPTED'"), ends, bounded=True))
    return matched, fragments, rows


@query("q18_greedy_matching", f"WITH RECURSIVE {MATCHED} SELECT video_id, src, tgt, score FROM matched")
def q18(spark, d):
    return matched_of(spark, d)[0]


FINAL = MATCHED + """,
final AS (SELECT l.video_id, l.src, l.tgt, l.gap, l.score,
  CASE WHEN l.rejection_reason IS NULL AND m.src IS NULL THEN 'SUPERSEDED_BY_STRONGER_LINK' ELSE l.rejection_reason END AS rejection_reason
  FROM links l LEFT JOIN matched m USING (video_id, src, tgt))"""


@query("q18b_final_decisions", f"""WITH RECURSIVE {FINAL}
SELECT video_id, src, tgt, score, rejection_reason, CASE WHEN rejection_reason IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision FROM final""")
def q18b(spark, d):
    return links_of(spark, d, matched_of(spark, d)[0])[0].select("video_id", "src", "tgt", "score", "rejection_reason", "decision")


CHAINS = FINAL + """,
walk AS (
  SELECT f.video_id, f.fragment_id AS node, f.fragment_id AS head FROM frags f
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.video_id = f.video_id AND m.tgt = f.fragment_id)
  UNION ALL
  SELECT w.video_id, m.tgt, w.head FROM walk w JOIN matched m ON w.video_id = m.video_id AND w.node = m.src)"""


def lineages_of(spark, d):
    matched, fragments, rows = matched_of(spark, d)
    members = shared(spark, "members", _files(d),
                     lambda: co.lineages(fragments.select("video_id", F.col("fragment_id").alias("node")), matched))
    return members, fragments, rows, matched


@query("q19_lineages", f"""WITH RECURSIVE {CHAINS}
SELECT w.video_id, w.head AS canonical_id, count(*) AS members, min(f.first_frame) AS first_frame, max(f.last_frame) AS last_frame,
  {r6('coalesce(avg(m.score), 1.0::DOUBLE)')} AS confidence, string_agg(w.node::VARCHAR, ',' ORDER BY f.first_frame, w.node) AS chain
FROM walk w JOIN frags f ON w.video_id = f.video_id AND w.node = f.fragment_id
LEFT JOIN matched m ON w.video_id = m.video_id AND w.node = m.tgt GROUP BY w.video_id, w.head""")
def q19(spark, d):
    members, fragments, _, matched = lineages_of(spark, d)
    return co.lineage_table(members, fragments, matched)


@query("q19c_chain_pairs", f"""WITH RECURSIVE {CHAINS},
ordered AS (SELECT w.video_id, w.head, w.node, f.last_frame, row_number() OVER v - 1 AS place, lead(w.node) OVER v AS next, lead(f.first_frame) OVER v AS onward
  FROM walk w JOIN frags f ON w.video_id = f.video_id AND w.node = f.fragment_id WINDOW v AS (PARTITION BY w.video_id, w.head ORDER BY f.first_frame, w.node))
SELECT video_id, head, place::INTEGER AS place, node, next, onward - last_frame AS gap FROM ordered WHERE next IS NOT NULL""")
def q19c(spark, d):
    members, fragments, _, _ = lineages_of(spark, d)
    return co.chain_pairs(members, fragments)


@query("q19b_link_statistics", f"""WITH RECURSIVE {MATCHED}
SELECT l.video_id, count(*) AS evaluated, count(*) FILTER (rejection_reason IS NULL) AS plausible,
  (SELECT count(*) FROM matched m WHERE m.video_id = l.video_id) AS accepted, (SELECT count(*) FROM matched m WHERE m.video_id = l.video_id) AS merged
FROM links l GROUP BY l.video_id""")
def q19b(spark, d):
    matched, links = matched_of(spark, d)[0], links_of(spark, d)[0]
    counts = links.groupBy("video_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("decision") == "ACCEPTED").alias("plausible"))
    won = matched.groupBy("video_id").agg(F.count(F.lit(1)).alias("accepted"))
    return counts.join(won, "video_id", "left").select("video_id", "evaluated", "plausible", F.coalesce("accepted", F.lit(0)).alias("accepted"),
                                                  F.coalesce("accepted", F.lit(0)).alias("merged"))  # each accepted link takes one fragment into a lineage


def hero_lineage(spark, d):
    """The lineage of the first fragment of each video's best-ranked track; all lineages' members, fragments, rows, matching."""
    members, fragments, rows, matched = lineages_of(spark, d)
    hero = co.hero_members(members, fragments, ev.rank_heroes(signals_of(spark, d), 1))
    return hero, members, fragments, rows, matched


HERO_BEST = """
best AS (SELECT video_id, track_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {score} DESC, persistence_frames DESC, {amplitude} DESC, event_id DESC) AS rank FROM signals) WHERE rank = 1),
first AS (SELECT f.video_id, arg_min(f.fragment_id, f.first_frame) AS hero_fragment FROM frags f JOIN best b USING (video_id, track_id) GROUP BY f.video_id),
own AS (SELECT w.video_id, w.head, f.hero_fragment FROM walk w JOIN first f ON w.video_id = f.video_id AND w.node = f.hero_fragment),
hero AS (SELECT o.video_id, o.head, o.hero_fragment, w.node FROM own o JOIN walk w ON o.video_id = w.video_id AND o.head = w.head)""".format(
    score=r6("score", 12), amplitude=r6("amplitude_px"))
HERO_SQL = CHAINS + ",\n" + SIGNALS[SIGNALS.index("stats AS ("):].replace(BALLS + ",", "") + "," + HERO_BEST


@query("q20_hero_identity", f"""WITH RECURSIVE {HERO_SQL},
whole AS (SELECT h.video_id, h.hero_fragment, count(*) AS members, min(f.first_frame) AS first_frame, max(f.last_frame) AS last_frame, {r6('coalesce(avg(m.score), 1.0::DOUBLE)')} AS confidence
  FROM hero h JOIN frags f ON h.video_id = f.video_id AND h.node = f.fragment_id LEFT JOIN matched m ON h.video_id = m.video_id AND h.node = m.tgt GROUP BY h.video_id, h.hero_fragment),
refused AS (SELECT video_id, src, tgt, rejection_reason, score, row_number() OVER (PARTITION BY video_id, src ORDER BY gap, tgt) AS rn FROM final WHERE rejection_reason IS NOT NULL)
SELECT v.video_id, h.hero_fragment AS canonical_id, coalesce(h.members, 0) AS members, h.first_frame, h.last_frame, coalesce(h.confidence, 0.0::DOUBLE) AS confidence,
  CASE WHEN h.video_id IS NULL THEN 'NO_HERO_TRACK' WHEN members = 1 AND r.tgt IS NOT NULL THEN 'UNRESOLVED_TRACK_FRAGMENT' END AS fallback,
  CASE WHEN members = 1 THEN r.tgt END AS refused, CASE WHEN members = 1 THEN r.rejection_reason END AS refused_reason, CASE WHEN members = 1 THEN r.score END AS refused_score
FROM (SELECT DISTINCT video_id FROM obs) v LEFT JOIN whole h USING (video_id)
LEFT JOIN refused r ON h.video_id = r.video_id AND h.hero_fragment = r.src AND r.rn = 1""")
def q20(spark, d):
    hero, _, fragments, rows, matched = hero_lineage(spark, d)
    links = links_of(spark, d, matched, hero.select("video_id", F.col("hero_fragment").alias("src")))[0]
    return co.hero_identity(rows.select("video_id").distinct(), hero, links, fragments, matched)


@query("q20b_identity_frames", f"""WITH RECURSIVE {HERO_SQL}
SELECT r.video_id, r.frame, r.fragment_id, r.cx, r.cy FROM frows r JOIN hero h ON r.video_id = h.video_id AND r.fragment_id = h.node""")
def q20b(spark, d):
    hero, _, _, rows, _ = hero_lineage(spark, d)
    return rows.join(hero.select("video_id", F.col("node").alias("fragment_id")), ["video_id", "fragment_id"], "left_semi").select(
        "video_id", "frame", "fragment_id", "cx", "cy")


@query("q20c_active_fragment", f"""WITH RECURSIVE {HERO_SQL},
spots AS (SELECT v.video_id, s.frame FROM (SELECT DISTINCT video_id FROM hero) v CROSS JOIN (SELECT unnest(range(0, 720)) AS frame) s),
held AS (SELECT h.video_id, h.node, f.first_frame, f.last_frame FROM hero h JOIN frags f ON h.video_id = f.video_id AND h.node = f.fragment_id)
SELECT a.video_id, a.frame, arg_min(h.node, h.first_frame) AS fragment_id
FROM spots a LEFT JOIN held h ON a.video_id = h.video_id AND a.frame BETWEEN h.first_frame AND h.last_frame GROUP BY a.video_id, a.frame""")
def q20c(spark, d):
    hero, _, fragments, _, _ = hero_lineage(spark, d)
    held = hero.join(fragments.select("video_id", F.col("fragment_id").alias("node"), "first_frame", "last_frame"), ["video_id", "node"])
    frames = hero.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(719)).cast("array<bigint>")).alias("frame"))
    return co.active_at(frames, held.withColumn("member", F.col("node"))).select("video_id", "frame", F.col("member").alias("fragment_id"))
