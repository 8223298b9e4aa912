"""Queries on account marks and venue calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import accounts
from tidemark.plans.registry import query
from tidemark.sources.views import table


@query("s14_nav_to_returns", """WITH m AS (SELECT o_custkey AS account_id, o_orderdate AS observed_at, o_orderdate + to_days(CAST(o_orderkey % 3 - 1 AS INT)) AS ingested_at, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS equity, 'm' || o_orderkey AS ref FROM orders),
    l AS (SELECT *, lag(observed_at) OVER w AS start, lag(equity) OVER w AS base, lag(ref) OVER w AS before FROM m WINDOW w AS (PARTITION BY account_id ORDER BY observed_at, ingested_at, ref)),
    i AS (SELECT *, CASE WHEN observed_at <= start THEN 'non_increasing_account_performance_time' WHEN NOT (base > 0 AND equity > 0) THEN 'invalid_account_equity' END AS issue FROM l WHERE start IS NOT NULL)
    SELECT account_id, start AS period_start, observed_at AS period_end, CASE WHEN issue IS NULL THEN round(equity / base - 1, 6) END AS return_fraction, before || '->' || ref AS source_reference, greatest(ingested_at, observed_at) AS ingested_at, issue FROM i""")
def s14(spark, d):
    """A customer's orders as marks of an account."""
    o = table(spark, d, "orders")
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    marks = o.select(F.col("o_custkey").alias("account_id"), at.alias("observed_at"), (at + F.make_dt_interval(days=(key % 3 - 1).cast("int"))).alias("ingested_at"), F.when(key % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("equity"), F.concat(F.lit("m"), key).alias("source_reference"))
    return accounts.nav_to_returns(marks, "orders").drop("provider").withColumn("return_fraction", F.round("return_fraction", 6))


@query("a31_trading_session", """WITH ses AS (SELECT n_nationkey AS venue, w.weekday, 540 + 30 * (n_nationkey % 3) AS opens, 960 AS closes, CASE n_regionkey WHEN 0 THEN 'Africa/Cairo' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Tokyo' ELSE 'Europe/Berlin' END AS zone FROM nation, (SELECT unnest([0, 1, 2, 3, 4]) AS weekday) w),
    hol AS (SELECT DISTINCT event_id % 25 AS venue, CAST(ts AS DATE) AS holiday FROM events WHERE event_type = 'error' AND value > 80),
    m AS (SELECT DISTINCT event_id, ses.venue, weekday, opens, closes, timezone(zone, ts AT TIME ZONE 'UTC') AS local FROM events JOIN ses ON ses.venue = user_id % 25),
    h AS (SELECT event_id FROM m LEFT JOIN hol ON hol.venue = m.venue AND hol.holiday = CAST(local AS DATE) WHERE hol.venue IS NULL AND isodow(local) - 1 = weekday AND hour(local) * 60 + minute(local) BETWEEN opens AND closes - 1)
    SELECT event_id, event_id IN (SELECT event_id FROM h) AS is_open FROM events""")
def a31(spark, d):
    """Nations as venues; days of large errors are their holidays."""
    n, e = table(spark, d, "nation"), table(spark, d, "events")
    region = F.col("n_regionkey")
    zone = F.when(region == 0, "Africa/Cairo").when(region == 1, "America/New_York").when(region == 2, "Asia/Tokyo").otherwise("Europe/Berlin")
    sessions = n.select(F.col("n_nationkey").cast("long").alias("venue"), F.explode(F.array(*map(F.lit, range(5)))).alias("weekday"), (540 + 30 * (F.col("n_nationkey") % 3)).alias("opens_at"), F.lit(960).alias("closes_at"), zone.alias("zone"))
    holidays = e.where("event_type = 'error' AND value > 80").select((F.col("event_id") % 25).alias("venue"), F.to_date("ts").alias("holiday"))
    moments = e.select("event_id", (F.col("user_id") % 25).alias("venue"), F.col("ts").alias("observed_at"))
    return accounts.trading_sessions(moments, "event_id", sessions, holidays)
