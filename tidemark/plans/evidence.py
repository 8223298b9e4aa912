"""Queries on market hours, regime rules, materialised features and facts, and cost-value assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.features import sma
from tidemark.operators import evidence
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views

DAY = "1996-06-30"


@query("a32_market_open", """WITH cal AS (SELECT r_regionkey AS calendar_id, CASE WHEN r_regionkey = 4 THEN 3 ELSE r_regionkey END AS venue, CASE r_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Europe/Berlin' END AS zone,
    TIMESTAMP '2024-01-03 00:00:00' AS ingested_at FROM region),
    ses AS (SELECT calendar_id, w.weekday, CASE WHEN calendar_id = 2 THEN 22 * 60 ELSE 9 * 60 + 30 END AS opens, CASE WHEN calendar_id = 2 THEN 5 * 60 ELSE 16 * 60 END AS closes, CASE WHEN calendar_id = 2 THEN 1 ELSE 0 END AS days FROM cal, (SELECT unnest([0, 1, 2, 3, 4]) AS weekday) w),
    exc AS (SELECT DISTINCT user_id % 5 AS calendar_id, CAST(ts AS DATE) AS session_date, day(ts) % 11 = 0 AS holiday FROM events WHERE day(ts) % 11 = 0 OR day(ts) % 7 = 0),
    m AS (SELECT event_id, ts AS seen, timezone(zone, ts AT TIME ZONE 'UTC') AS local, cal.calendar_id FROM events LEFT JOIN cal ON venue = user_id % 5 AND ingested_at <= ts),
    d AS (SELECT m.*, CAST(local AS DATE) - k AS session_date FROM m, (SELECT unnest([0, 1]) AS k) x),
    o AS (SELECT d.event_id, d.calendar_id, coalesce(NOT coalesce(exc.holiday, false) AND CAST(d.session_date AS TIMESTAMP) + to_minutes(opens) <= local
        AND local < CASE WHEN exc.holiday = false THEN CAST(d.session_date AS TIMESTAMP) + to_minutes(13 * 60) ELSE CAST(d.session_date + days AS TIMESTAMP) + to_minutes(closes) END, false) AS open
        FROM d LEFT JOIN exc ON exc.calendar_id = d.calendar_id AND exc.session_date = d.session_date AND CAST(exc.session_date AS TIMESTAMP) <= seen LEFT JOIN ses ON ses.calendar_id = d.calendar_id AND ses.weekday = isodow(d.session_date) - 1)
    SELECT event_id, CASE WHEN count(DISTINCT calendar_id) = 1 THEN bool_or(open) END AS is_open, CASE count(DISTINCT calendar_id) WHEN 0 THEN 'calendar_not_found' WHEN 1 THEN NULL ELSE 'ambiguous_calendar' END AS issue FROM o GROUP BY event_id""")
def a32(spark, d):
    events, k = table(spark, d, "events"), F.col("calendar_id")
    since = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    zone = F.when(k == 0, "America/New_York").when(k == 1, "Asia/Tokyo").otherwise("Europe/Berlin")
    calendars = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("calendar_id")).select(
        "calendar_id", F.when(k == 4, 3).otherwise(k).alias("market"), zone.alias("zone"), F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"), since.alias("ingested_at")
    )
    night = k == 2  # a session that ends on the next day
    sessions = calendars.select("calendar_id", F.explode(F.array(*map(F.lit, range(5)))).alias("weekday"), F.when(night, 1320).otherwise(570).alias("opens_at"), F.when(night, 300).otherwise(960).alias("closes_at"), F.when(night, 1).otherwise(0).alias("close_day_offset"), "ingested_at")
    date, day = F.to_date("ts"), F.dayofmonth("ts")
    exceptions = events.where((day % 11 == 0) | (day % 7 == 0)).select((F.col("user_id") % 5).alias("calendar_id"), date.alias("session_date"), F.when(day % 11 == 0, "HOLIDAY").otherwise("EARLY_CLOSE").alias("kind"), F.lit(780).alias("closes_at"), date.cast("timestamp_ntz").alias("ingested_at")).distinct()
    moments = events.select("event_id", (F.col("user_id") % 5).alias("venue"), F.col("ts").alias("observed_at"), F.col("ts").alias("known_at"))
    return evidence.market_open(moments, "event_id", calendars, sessions, exceptions)


_ROLES = {"trend": 1, "volatility": 2, "liquidity": 3, "inflation": 4, "policy": 5}


@query("r4_aligned_features", """WITH f AS (SELECT l_partkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) + 15 AS event_at, l_linenumber AS feature_id, CAST(l_shipdate AS DATE) AS known_at, CAST(l_shipdate AS DATE) + CAST(l_suppkey % 3 AS INTEGER) AS computed_at,
    l_extendedprice AS value, l_returnflag <> 'R' AS ok FROM lineitem), s AS (SELECT * FROM f WHERE known_at <= event_at AND computed_at <= event_at),
    l AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, event_at, feature_id ORDER BY known_at DESC, computed_at DESC, value DESC) AS rn FROM s)
    SELECT instrument_id, event_at, """ + ", ".join(f"max(value) FILTER (WHERE rn = 1 AND ok AND feature_id = {f}) AS {role}" for role, f in _ROLES.items()) + " FROM l GROUP BY instrument_id, event_at")
def r4(spark, d):
    shipped = F.to_date("l_shipdate")
    features = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("instrument_id"), F.date_add(F.trunc("l_shipdate", "month"), 15).alias("event_at"), F.col("l_linenumber").alias("feature_id"), shipped.alias("known_at"), F.date_add(shipped, (F.col("l_suppkey") % 3).cast("int")).alias("computed_at"),
        F.col("l_extendedprice").alias("value"), F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("VALIDATED").alias("status"),
    )
    return evidence.aligned_features(features, ["instrument_id"], _ROLES)


def _roles(spark, d):
    b, c = views.bars(spark, d), F.col
    some = lambda n, x: F.when(c("trades") % n != 0, x)  # noqa: E731  absent on some days
    return b.select(
        "instrument_id", "day", (c("close") / c("open") - 1).alias("trend"), some(5, (c("high") - c("low")) / c("close")).alias("volatility"), some(7, c("volume") * 1000).alias("liquidity"), some(3, c("high") / c("open") - 1.05).alias("inflation"), (c("low") / c("open") - 0.95).alias("policy"),
        (c("close") / 110 - 1).alias("credit"), (c("open") / 100 - 1).alias("currency"), some(11, c("volume") / 100).alias("commodity"), (c("high") / 50 - 2).alias("correlation"),
    )


_ROLES_SQL = with_views("bars") + """, f AS (SELECT instrument_id, day, close / open - 1 AS t, CASE WHEN trades % 5 <> 0 THEN (high - low) / close END AS v, CASE WHEN trades % 7 <> 0 THEN volume * 1000 END AS q, CASE WHEN trades % 3 <> 0 THEN high / open - 1.05::DOUBLE END AS inf, low / open - 0.95::DOUBLE AS pol,
    abs(close / 110 - 1) AS s1, abs(open / 100 - 1) AS s2, CASE WHEN trades % 11 <> 0 THEN abs(volume / 100) END AS s3, abs(high / 50 - 2) AS s4 FROM bars)"""


@query("r5_regime_rules", _ROLES_SQL + """, g AS (SELECT *, lag(v) OVER w AS v0, lag(q) OVER w AS q0, CASE WHEN t > 0.05 THEN 1 WHEN t < -0.05 THEN -1 ELSE t / 0.05::DOUBLE END AS x, CASE WHEN v > 0.04 THEN 1 ELSE v / 0.04::DOUBLE END AS y FROM f WINDOW w AS (PARTITION BY instrument_id ORDER BY day)),
    u AS (SELECT instrument_id, day, 'TREND' AS dimension, [CASE WHEN x > 0 THEN x ELSE 0 END, CASE WHEN x < 0 THEN -x ELSE 0 END, 1 - abs(x)]::DOUBLE[] AS p FROM g
    UNION ALL SELECT instrument_id, day, 'VOLATILITY_LEVEL', CASE WHEN v IS NOT NULL THEN [greatest(v / 0.02::DOUBLE, 0.01::DOUBLE), 1]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'VOLATILITY_DIRECTION', CASE WHEN v >= v0 THEN [1, 0.1]::DOUBLE[] WHEN v < v0 THEN [0.1, 1]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'LIQUIDITY_LEVEL', CASE WHEN q IS NOT NULL THEN [greatest(q / 1000000, 0.01::DOUBLE), 1]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'LIQUIDITY_DIRECTION', CASE WHEN q < q0 THEN [1, 0.1]::DOUBLE[] WHEN q >= q0 THEN [0.1, 1]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'RISK_APPETITE', CASE WHEN y IS NOT NULL THEN [greatest(0.01::DOUBLE, 1 + x - y), greatest(0.01::DOUBLE, 1 - x + y)]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'MACRO_CYCLE', CASE WHEN inf >= 0 AND t >= 0 AND pol <= 0 THEN [0.7, 0.1, 0.1, 0.1]::DOUBLE[] WHEN inf >= 0 THEN [0.1, 0.7, 0.1, 0.1]::DOUBLE[] WHEN inf < 0 AND t >= 0 AND pol <= 0 THEN [0.1, 0.1, 0.7, 0.1]::DOUBLE[] WHEN inf < 0 THEN [0.1, 0.1, 0.1, 0.7]::DOUBLE[] END FROM g
    UNION ALL SELECT instrument_id, day, 'STRESS', CASE WHEN s3 IS NOT NULL THEN [1, s1, s2, s3, s4, greatest(s1 - 0.5::DOUBLE, 0) + greatest(s2 - 0.5::DOUBLE, 0) + greatest(s3 - 0.5::DOUBLE, 0) + greatest(s4 - 0.5::DOUBLE, 0)]::DOUBLE[] END FROM g)
    SELECT instrument_id, day, dimension, list_position(p, list_max(p))::INTEGER AS state, round(list_max(p) / list_sum(p), 7) AS probability FROM u""")
def r5(spark, d):
    return evidence.likeliest_state(evidence.regime_rules(_roles(spark, d), ["instrument_id"], "day")).withColumn("probability", F.round("probability", 7))


@query("r9_regime_run_status", _ROLES_SQL + """, s AS (SELECT instrument_id, bool_or(v IS NULL) AS gap FROM f GROUP BY 1), h AS (SELECT DISTINCT p_brand AS instrument_id, right(p_brand, 1) = '1' AS blocked FROM part),
    r AS (SELECT instrument_id, concat_ws(',', CASE WHEN gap THEN 'required_regime_feature_unavailable' END, CASE WHEN blocked THEN 'data_health_blocked' END, CASE WHEN instrument_id NOT IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'oos_regime_validation_unavailable' END) AS reasons FROM s LEFT JOIN h USING (instrument_id))
    SELECT instrument_id, reasons, CASE WHEN reasons = '' THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS status FROM r""")
def r9(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "instrument_id")
    health = part.select("instrument_id", F.when(F.col("instrument_id").endswith("1"), "BLOCKED").otherwise("HEALTHY").alias("health")).distinct()
    return evidence.regime_run_status(_roles(spark, d), "instrument_id", ["trend", "volatility"], health, part.where("p_size = 1"))


@query("f19_materialize_features", with_views("bars") + f""", k AS (SELECT *, day + CAST(trades % 4 AS INTEGER) AS known_at, instrument_id || ':' || CAST(day AS VARCHAR) || ':' || CAST(trades AS VARCHAR) AS source FROM bars),
    h AS (SELECT instrument_id, day, avg(close) OVER w AS a, count(*) OVER w AS inputs, max(known_at) OVER w AS last_known, min(close) OVER w AS lowest, sha256(array_to_string(list(source) OVER w, ',')) AS data_version FROM k WINDOW w AS (PARTITION BY instrument_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, CASE WHEN inputs < 5 THEN 'insufficient_or_invalid_bar_history' WHEN last_known > DATE '{DAY}' THEN 'feature_input_not_available_as_of_decision' WHEN lowest <= 0 THEN 'invalid_feature_bars' WHEN a NOT BETWEEN 107 AND 113 THEN 'feature_value_outside_expected_range' ELSE 'VALIDATED' END AS status FROM h)
    SELECT instrument_id, day, CASE WHEN status = 'VALIDATED' THEN round(a, 7) END AS value, inputs, data_version, status FROM s""")
def f19(spark, d):
    trades = F.col("trades")
    bars = views.bars(spark, d).withColumn("known_at", F.date_add("day", (trades % 4).cast("int"))).withColumn("source", F.concat_ws(":", "instrument_id", F.col("day").cast("string"), trades.cast("string")))
    return evidence.materialize_features(bars, "instrument_id", "day", 5, sma(5), 107.0, 113.0, F.lit(DAY).cast("date")).withColumn("value", F.round("value", 7))


@query("i14_facts_from_fundamentals", f"""WITH f AS (SELECT l_partkey AS instrument_id, CASE l_linenumber WHEN 1 THEN 'revenue' WHEN 2 THEN 'debt' ELSE 'other' END AS fact_name, l_extendedprice AS value, last_day(l_shipdate) AS period_end, CAST(l_shipdate AS DATE) AS filed_at, CAST(l_shipdate AS DATE) + l_linenumber AS ingested_at,
    l_returnflag AS provider, l_orderkey AS source_identifier, l_suppkey AS revision FROM lineitem), r AS (SELECT *, 'fundamental:' || provider || ':' || source_identifier || ':' || revision AS ref FROM f WHERE fact_name IN ('revenue', 'debt') AND filed_at <= DATE '{DAY}' AND ingested_at <= DATE '{DAY}')
    SELECT instrument_id, fact_name, value, period_end, filed_at AS effective_at, ingested_at, revision, ref AS source_reference, sha256(instrument_id || '|' || ref || '|' || period_end) AS fact_id FROM r""")
def i14(spark, d):
    shipped, n = F.to_date("l_shipdate"), F.col("l_linenumber")
    fundamentals = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("instrument_id"), F.when(n == 1, "revenue").when(n == 2, "debt").otherwise("other").alias("fact_name"), F.col("l_extendedprice").alias("value"), F.last_day("l_shipdate").alias("period_end"), shipped.alias("filed_at"), shipped.alias("effective_at"), F.date_add(shipped, n).alias("ingested_at"),
        F.col("l_returnflag").alias("provider"), F.col("l_orderkey").alias("source_identifier"), F.col("l_suppkey").alias("revision"),
    )
    return evidence.facts_from_fundamentals(fundamentals, ["revenue", "debt"], F.lit(DAY).cast("date"))


@query("o10_cost_value", """WITH c AS (SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END AS cost, o_totalprice * (o_custkey % 5 - 1) AS benefit, o_orderstatus <> 'P' AS enabled, o_orderpriority = '1-URGENT' AS ai, o_custkey % 2 = 0 AS plain FROM orders)
    SELECT candidate_id, CASE WHEN benefit >= 0 AND cost > 0 THEN benefit / cost END AS ratio,
    CASE WHEN benefit < 0 THEN 'INVALID' WHEN NOT enabled THEN 'BLOCKED_POLICY_DISABLED' WHEN (ai AND plain) OR (cost > 0 AND benefit / cost < 1.5) THEN 'NOT_JUSTIFIED_REVIEW_REQUIRED' ELSE 'JUSTIFIED_FOR_REVIEW' END AS outcome,
    CASE WHEN benefit < 0 THEN 'invalid_cost_value_assessment_input' WHEN NOT enabled THEN 'cost_budget_policy_disabled' WHEN ai AND plain THEN 'deterministic_code_preferred_over_ai_inference' WHEN cost > 0 AND benefit / cost < 1.5 THEN 'minimum_value_to_cost_ratio_not_met' END AS reason FROM c""")
def o10(spark, d):
    price, customer = F.col("o_totalprice"), F.col("o_custkey")
    candidates = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(price).alias("cost"), (price * (customer % 5 - 1)).alias("benefit"), (F.col("o_orderstatus") != "P").alias("enabled"), F.lit(1.5).alias("least_ratio"), (F.col("o_orderpriority") == "1-URGENT").alias("ai"), (customer % 2 == 0).alias("plain_alternative"),
    )
    return evidence.cost_value(candidates).select("candidate_id", "ratio", "outcome", "reason")
