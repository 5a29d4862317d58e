"""Queries of the optional tier: as-of and rolling windows, sessions, rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")
def rolling_average(t):
    """A five-row moving average per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("moving_avg"))


@query("""
WITH v AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_last_view(t):
    """Each purchase with the user's latest view: a union and a window, so one shuffle on the user."""
    e = t.events.where("event_type in ('view', 'purchase')")
    # of rows at one time, views come first
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session
""")
def sessions(t):
    """Sessions that a gap of six hours ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    g = t.events.select("user_id", "ts", "event_id", F.when(gap <= 6 * 3600 * 10**6, 0).otherwise(1).alias("new"))
    return g.select("user_id", F.sum("new").over(w).alias("session")).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def rollup_sources(t):
    """Counts by source and language with subtotals."""
    return t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
