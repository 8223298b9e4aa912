"""Queries on sensitivity analyses, regimes, fundamentals, construction and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import features as f
from tidemark.operators import asof, backtest, portfolio, signals, text
from tidemark.plans.market import RUN_SQL, SIGNALS_SQL
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views

KEYS = ["strategy", "instrument_id"]


def r6(c, name):
    return F.round(c, 6).alias(name)


def _run(spark, d):
    return backtest.vector_backtest(signals.baseline_signals(views.bars(spark, d)))


# as-of reads


@query("a2_corporate_actions_as_of", """SELECT l_partkey, l_suppkey, l_extendedprice AS amount, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_orderkey DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-06-30') WHERE rn = 1""")
def a2(spark, d):
    known = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1996-06-30").cast("timestamp_ntz"))
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_orderkey", "l_extendedprice")]
    return asof.latest_by(known, ["l_partkey", "l_suppkey"], *order).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("amount"), "l_shipdate")


@query("a12_master_as_of", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS at FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1")
def a12(spark, d):
    known = table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz"))
    return known.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("at"))


@query("a18_policy_return_window", with_views("returns") + """, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY day DESC) AS rn FROM returns WHERE day <= DATE '1997-06-30')
    SELECT instrument_id, count(*) AS n, round(sum(r), 6) AS total, max(day) AS latest, CASE WHEN count(*) < 60 THEN 'TOO_FEW' WHEN DATE '1997-06-30' - max(day) > 5 THEN 'TOO_OLD' ELSE 'AVAILABLE' END AS status FROM k WHERE rn <= 60 GROUP BY 1""")
def a18(spark, d):
    t = F.lit("1997-06-30").cast("date")
    last = views.returns(spark, d).where(F.col("day") <= t).withColumn("rn", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("day")))).where("rn <= 60")
    status = F.when(F.count(F.lit(1)) < 60, "TOO_FEW").when(F.datediff(t, F.max("day")) > 5, "TOO_OLD").otherwise("AVAILABLE")
    return last.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("r"), "total"), F.max("day").alias("latest"), status.alias("status"))


@query("a24_active_prediction", with_views("validity") + """ SELECT d.c_custkey AS symbol, arg_max(v.mapping_id, (v.valid_from, v.mapping_id)) AS mapping_id FROM customer d JOIN validity v ON v.symbol = d.c_custkey AND v.valid_from <= TIMESTAMP '1996-06-30' AND (v.valid_until IS NULL OR TIMESTAMP '1996-06-30' < v.valid_until) GROUP BY 1""")
def a24(spark, d):
    t = F.lit("1996-06-30").cast("timestamp_ntz")
    live = views.validity(spark, d).where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (t < F.col("valid_until"))))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"))
    return live.join(known, "symbol", "left_semi").groupBy("symbol").agg(F.max_by("mapping_id", F.struct("valid_from", "mapping_id")).alias("mapping_id"))


@query("a28_signal_board", """WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS seen FROM orders GROUP BY 1) SELECT c_custkey, coalesce(status, 'NONE') AS status,
    CASE WHEN seen IS NULL THEN 'UNKNOWN' WHEN seen < TIMESTAMP '1997-01-01' THEN 'EXPIRED' WHEN seen < TIMESTAMP '1998-01-01' THEN 'OVERDUE' ELSE 'CURRENT' END AS freshness FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def a28(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max("o_orderdate").alias("at"))
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    fresh = F.when(F.col("at").isNull(), "UNKNOWN").when(F.col("at") < ts("1997-01-01"), "EXPIRED").when(F.col("at") < ts("1998-01-01"), "OVERDUE").otherwise("CURRENT")
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("status", F.lit("NONE")).alias("status"), fresh.alias("freshness"))


# sensitivity


@query("v7_slippage_sensitivity", RUN_SQL + """, s AS (SELECT strategy, instrument_id, m, ln(product(1 + position * move - turnover * 0.001::DOUBLE * m)) AS total FROM run CROSS JOIN (VALUES (0), (1), (2), (5)) AS x(m) GROUP BY 1, 2, 3)
    SELECT strategy, instrument_id, m AS multiplier, round(total, 6) AS log_growth, round(total - max(CASE WHEN m = 1 THEN total END) OVER (PARTITION BY strategy, instrument_id), 6) AS versus_base FROM s""")
def v7(spark, d):
    run = _run(spark, d).withColumn("multiplier", F.explode(F.array(*map(F.lit, (0, 1, 2, 5)))))
    net = F.col("position") * F.col("move") - F.col("turnover") * 0.001 * F.col("multiplier")
    s = run.groupBy(*KEYS, "multiplier").agg(F.sum(F.log1p(net)).alias("t"))
    base = F.max(F.when(F.col("multiplier") == 1, F.col("t"))).over(Window.partitionBy(*KEYS))
    return s.select(*KEYS, "multiplier", r6(F.col("t"), "log_growth"), r6(F.col("t") - base, "versus_base"))



# regimes and fundamentals


@query("r6_regime_labels", with_views("bars") + """, m AS (SELECT instrument_id, day, close / lag(close, 4) OVER (PARTITION BY instrument_id ORDER BY day) - 1 AS m FROM bars), s AS (SELECT *, least(0.4::DOUBLE, abs(m) * 10) AS s FROM m WHERE m IS NOT NULL),
    p AS (SELECT instrument_id, day, CASE WHEN m > 0 THEN 0.3::DOUBLE + s ELSE 0.3 END AS u, CASE WHEN m < 0 THEN 0.3::DOUBLE + s ELSE 0.3 END AS w FROM s), q AS (SELECT *, 1 - u - w AS g FROM p)
    SELECT instrument_id, CASE WHEN u >= w AND u >= g THEN 'UP' WHEN w >= g THEN 'DOWN' ELSE 'RANGE' END AS label, count(*) AS n FROM q GROUP BY 1, 2""")
def r6_labels(spark, d):
    from tidemark.operators.validation import simple_regimes

    p = F.array("p_up", "p_down", "p_range")
    label = F.element_at(F.array(*map(F.lit, ("UP", "DOWN", "RANGE"))), F.array_position(p, F.array_max(p)).cast("int"))  # the first maximum
    return simple_regimes(views.bars(spark, d), 5).groupBy("instrument_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("i2_growth", with_views("revisions") + """, v AS (SELECT instrument_id, year(period)::INT AS y, sum(value) AS revenue FROM revisions GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY y DESC) AS rn FROM v)
    SELECT instrument_id, max(y) AS y, round(max(CASE WHEN rn = 1 THEN revenue END) / max(CASE WHEN rn = 2 THEN revenue END) - 1, 6) AS growth FROM k WHERE rn <= 2 GROUP BY 1""")
def i2(spark, d):
    v = views.revisions(spark, d).groupBy("instrument_id", F.year("period").alias("y")).agg(F.sum("value").alias("revenue"))
    k = v.withColumn("rn", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("y")))).where("rn <= 2")
    pick = lambda n: F.max(F.when(F.col("rn") == n, F.col("revenue")))
    return k.groupBy("instrument_id").agg(F.max("y").alias("y"), r6(pick(1) / pick(2) - 1, "growth"))


@query("i4_discounted_cash_flow", "SELECT p_partkey, round(list_sum(list_transform(range(1, 6), lambda k: p_retailprice * pow(1.05::DOUBLE, k) / pow(1.1::DOUBLE, k))) + p_retailprice * pow(1.05::DOUBLE, 5) * 1.02::DOUBLE / (0.1::DOUBLE - 0.02::DOUBLE) / pow(1.1::DOUBLE, 5), 6) AS value FROM part")
def i4(spark, d):
    cash = F.col("p_retailprice").cast("double")
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0.0), lambda acc, k: acc + cash * F.pow(F.lit(1.05), k) / F.pow(F.lit(1.1), k))
    terminal = cash * F.pow(F.lit(1.05), F.lit(5)) * 1.02 / (F.lit(0.1) - F.lit(0.02)) / F.pow(F.lit(1.1), F.lit(5))
    return table(spark, d, "part").select("p_partkey", r6(flows + terminal, "value"))


@query("i8_rebalance_plan", with_views("exposures") + """, a AS (SELECT portfolio_id, sector, sum(abs(notional)) AS v FROM exposures WHERE currency <> 'ASIA' GROUP BY 1, 2), b AS (SELECT portfolio_id, sector, sum(abs(notional)) AS v FROM exposures WHERE currency <> 'EUROPE' GROUP BY 1, 2)
    SELECT portfolio_id, sector, round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS delta FROM a FULL JOIN b USING (portfolio_id, sector) WHERE coalesce(b.v, 0) <> coalesce(a.v, 0)""")
def i8(spark, d):
    e = views.exposures(spark, d)
    side = lambda x, n: x.groupBy("portfolio_id", "sector").agg(F.sum(F.abs("notional")).alias(n))
    both = side(e.where("currency <> 'ASIA'"), "have").join(side(e.where("currency <> 'EUROPE'"), "want"), ["portfolio_id", "sector"], "full_outer").fillna(0.0, ["have", "want"])
    return both.where("have <> want").select("portfolio_id", "sector", F.round(F.col("want") - F.col("have"), 2).alias("delta"))


# portfolio


@query("p8_maximum_drawdown", with_views("returns") + """, e AS (SELECT *, product(1 + r) OVER (PARTITION BY instrument_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS e FROM returns), p AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY instrument_id ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM e)
    SELECT instrument_id, round(max(1 - e / pk), 6) AS drawdown FROM p GROUP BY 1""")
def p8(spark, d):
    run = views.returns(spark, d).withColumnRenamed("r", "net")
    return backtest.equity_curve(run, ("instrument_id",)).groupBy("instrument_id").agg(r6(F.max("drawdown"), "drawdown"))


@query("p25_kill_switches", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM l WHERE last = 'purchase' AND (user_id = c_custkey OR user_id = c_nationkey + 100))""")
def p25(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).where("last = 'purchase'")
    scopes = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.col("c_custkey").cast("long"), (F.col("c_nationkey") + 100).cast("long"))).alias("user_id"))
    return scopes.join(last, "user_id", "left_semi").select("c_custkey").distinct()


# operations and text


@query("o5_jobs_due", """WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, CASE WHEN last IS NULL THEN 'DUE' WHEN last + INTERVAL 400 DAY < TIMESTAMP '1996-06-30' THEN 'OVERDUE' WHEN last + INTERVAL 200 DAY < TIMESTAMP '1996-06-30' THEN 'DUE' ELSE 'OK' END AS state FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def o5(spark, d):
    last = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    t, plus = F.lit("1996-06-30").cast("timestamp_ntz"), lambda n: F.col("last") + F.expr(f"INTERVAL {n} DAY")
    state = F.when(F.col("last").isNull(), "DUE").when(plus(400) < t, "OVERDUE").when(plus(200) < t, "DUE").otherwise("OK")
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", state.alias("state"))


@query("o7_consecutive_failures", """WITH s AS (SELECT user_id, event_id, event_type <> 'purchase' AS bad, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, sum(bad::INT)::BIGINT AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def o7(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "events").withColumn("g", F.sum((F.col("event_type") == "purchase").cast("int")).over(w))
    return s.groupBy("user_id", "g").agg(F.count_if(F.col("event_type") != "purchase").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("t14_claim_support", """WITH c AS (SELECT conv_id, turn, text AS claim, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence, role FROM conversations), k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]+')) AS b FROM c WHERE role = 'assistant' AND evidence IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END, 6) AS support FROM k""")
def t14(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("claim"), F.lag("text").over(w).alias("evidence")).where("role = 'assistant' AND evidence IS NOT NULL")
    return text.claim_support(c).select("conv_id", "turn", r6(F.col("support"), "support"))


@query("m9_feature_importance", with_views("bars") + " SELECT 'volume' AS feature, round(avg(abs(volume)), 6) AS importance FROM bars UNION ALL SELECT 'range', round(avg(abs(high - low)), 6) FROM bars")
def m9(spark, d):
    each = views.bars(spark, d).select(F.explode(F.create_map(F.lit("volume"), F.col("volume").cast("double"), F.lit("range"), (F.col("high") - F.col("low")).cast("double"))).alias("feature", "v"))
    return each.groupBy("feature").agg(r6(F.avg(F.abs("v")), "importance"))


@query("e7_funding_charges", "SELECT l_suppkey, round(sum(l_quantity * l_extendedprice * 0.0001::DOUBLE * datediff('day', l_shipdate, l_shipdate + INTERVAL 3 DAY)), 4) AS charge FROM lineitem GROUP BY 1")
def e7(spark, d):
    days = F.datediff(F.col("l_shipdate") + F.expr("INTERVAL 3 DAY"), F.col("l_shipdate"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice") * F.lit(0.0001) * days), 4).alias("charge"))
