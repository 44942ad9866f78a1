"""Queries of streams that reorder and that join, with their SQL."""

from pyspark.sql import functions as F

from tessera.streaming.events import all_available, event_stream
from tessera.streaming.reorder import interval_joined, reordered_all

HOUR = 3_600_000_000


def _arrivals(spark, sf):
    """Events with the order they arrive in: up to two hours after their time, by a rule of their id."""
    turn = (F.unix_micros("time") + (F.col("event_id") * 7919) % 7200 * 1_000_000) * 64 + F.col("event_id") % 64
    return event_stream(spark, sf).withColumn("turn", turn)


def stream_reordered(spark, sf):
    """Each user's events in the order of their times, with the watermark and how uncertain their place is."""
    return reordered_all(_arrivals(spark, sf), "user_id", "turn", HOUR)


REORDERED = """WITH e AS (
  SELECT user_id, epoch_us(ts) AS us, (epoch_us(ts) + (event_id * 7919) % 7200 * 1000000) * 64 + event_id % 64 AS turn FROM events
), n AS (
  SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY turn) AS newest FROM e
), s AS (
  SELECT a.user_id, a.us, a.turn, coalesce(min(b.turn), 9223372036854775807) AS step
  FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.newest >= a.us + 3600000000 AND b.turn >= a.turn GROUP BY 1, 2, 3
), o AS (
  SELECT *, row_number() OVER w - 1 AS place, max(us) OVER (PARTITION BY user_id ORDER BY step, us, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step, us, turn)
)
SELECT user_id, turn, us, watermark, greatest(coalesce(watermark - us, 0), 0) AS uncertainty, place FROM o"""


def stream_interval_join(spark, sf):
    """Errors with the signups of their user in the six hours before, both as streams."""
    rows = event_stream(spark, sf).withColumnRenamed("event_id", "id")
    pairs = interval_joined(rows.filter("event_type = 'error'"), rows.filter("event_type = 'signup'"), "user_id", "6 HOURS", ("1 hour", "2 hours"))
    return all_available(pairs, "interval-join")


INTERVAL_JOIN = """SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, epoch_us(a.ts) AS left_us, epoch_us(b.ts) AS right_us
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 HOURS"""

QUERIES = {q.__name__: q for q in (stream_reordered, stream_interval_join)}
ORACLE = {"stream_reordered": REORDERED, "stream_interval_join": INTERVAL_JOIN}
