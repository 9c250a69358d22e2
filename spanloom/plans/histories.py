"""Queries on streams with state that timers let go: job lifecycles and the ball's history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as src
from ..streaming import replay

QUERIES: dict = {}
ORACLES: dict = {}
TTL_MS = 36 * 3_600_000


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return add


@query("q79_job_lifecycle", """
WITH RECURSIVE entries AS (
  SELECT user_id * 100 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // (5 * 86400000000) AS job_id, event_id, ts,
    CASE WHEN event_id % 11 = 0 THEN 'FAILED' WHEN event_type = 'view' THEN 'GENERATING' WHEN event_type = 'click' THEN 'PROCESSING'
      WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'COMPLETED' END AS state,
    CASE WHEN event_id % 5 <> 0 THEN event_id % 140 - 20 END AS progress FROM events),
placed AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM entries),
lives AS (
  SELECT job_id, i, us AS began, state, greatest(0, least(100, coalesce(progress, 0))) AS progress, 1 AS entries, us AS updated FROM placed WHERE i = 1
  UNION ALL
  SELECT p.job_id, p.i, CASE WHEN fresh THEN p.us ELSE began END, CASE WHEN fresh THEN p.state WHEN closed THEN l.state ELSE coalesce(p.state, l.state) END,
    CASE WHEN closed AND NOT fresh THEN l.progress WHEN p.progress IS NOT NULL THEN greatest(0, least(100, p.progress)) WHEN fresh THEN 0 ELSE l.progress END,
    CASE WHEN fresh THEN 1 WHEN closed THEN l.entries ELSE l.entries + 1 END, CASE WHEN closed AND NOT fresh THEN l.updated ELSE p.us END
  FROM (SELECT l.*, n.us > l.updated + 36 * 3600000000 AS fresh, coalesce(l.state IN ('COMPLETED', 'FAILED'), false) AS closed FROM lives l JOIN placed n ON n.job_id = l.job_id AND n.i = l.i + 1) l
  JOIN placed p ON p.job_id = l.job_id AND p.i = l.i + 1),
last_ AS (SELECT *, row_number() OVER (PARTITION BY job_id, began ORDER BY i DESC) AS back, max(began) OVER (PARTITION BY job_id) AS newest FROM lives)
SELECT job_id, began AS began_us, state, progress::INTEGER AS progress, entries::INTEGER AS entries,
  began < newest OR epoch_ms(make_timestamp(updated)) + 36 * 3600000 <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events) AS expired, updated AS updated_us FROM last_ WHERE back = 1""")
def q79(spark, d):
    """Every tenth entry comes twice; a job is five days of a user, and lives as long as no 36 hours pass without an entry that counts."""
    e = replay.event_stream(spark, d)
    since = F.unix_micros("at") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    state = F.when(F.col("event_id") % 11 == 0, "FAILED").when(F.col("event_type") == "view", "GENERATING").when(F.col("event_type") == "click", "PROCESSING").when(
        (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "COMPLETED")
    log = e.select((F.col("user_id") * 100 + F.floor(since / (5 * 86_400_000_000))).alias("job_id"), F.col("event_id").alias("step"), state.alias("state"),
                   F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 140 - 20).alias("progress"), "at",
                   F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("delivery")).drop("delivery")
    told = replay.drain(replay.job_lifecycle(log, TTL_MS), "jobs", "append", timers=True)
    last = F.max_by(F.struct("state", "progress", "entries", "expired", "updated"), F.struct("entries", "expired")).alias("j")
    return told.groupBy("job_id", F.unix_micros("began").alias("began_us")).agg(last).select(
        "job_id", "began_us", "j.state", "j.progress", "j.entries", "j.expired", F.unix_micros("j.updated").alias("updated_us"))


@query("q80_ball_history", f"""
WITH upto AS (SELECT (epoch_ms(max(ts)) - 86400000 - epoch_ms(TIMESTAMP '{src.EPOCH}')) // 3600000 AS frames FROM events),
spine AS (SELECT v.video_id, unnest(range(0, (SELECT frames FROM upto)))::BIGINT AS frame FROM (SELECT DISTINCT user_id % 10 AS video_id FROM events) v),
balls AS (SELECT user_id % 10 AS video_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '{src.EPOCH}')) // 3600000000)::BIGINT AS frame, count(*)::INTEGER AS n FROM events WHERE event_type = '{src.BALL}' GROUP BY ALL)
SELECT s.video_id, s.frame, coalesce(b.n, 0)::INTEGER AS candidates, CASE WHEN b.n > 0 THEN 'VISIBLE_FROM_SOURCE' ELSE 'UNKNOWN' END AS status
FROM spine s LEFT JOIN balls b USING (video_id, frame)""")
def q80(spark, d):
    e = replay.event_stream(spark, d)
    frame = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{src.EPOCH}', ts)").cast("long")
    seen = e.select(F.pmod("user_id", F.lit(10)).alias("video_id"), frame.alias("frame"), F.col("event_type").alias("class_name"), "at")
    return replay.drain(replay.ball_history(seen, src.BALL, 1_704_067_200_000, 3_600_000), "history", "append", timers=True)
