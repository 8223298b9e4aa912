"""Queries on portfolio risk, model evaluation and execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation, execution, portfolio
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views

_EXP, _RET, _HOLD = with_views("exposures"), with_views("returns"), with_views("holdout")


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("p1_gross_net", _EXP + " SELECT portfolio_id, round(sum(abs(notional)), 2) AS gross, round(sum(notional), 2) AS net FROM exposures GROUP BY 1")
def p1(spark, d):
    return portfolio.gross_and_net(views.exposures(spark, d), "portfolio_id").select("portfolio_id", F.round("gross", 2).alias("gross"), F.round("net", 2).alias("net"))


_GROUPS = _EXP + ", g AS (" + " UNION ALL ".join(f"SELECT portfolio_id, '{c}' AS dimension, {c} AS value, sum(abs(notional)) AS gross, sum(notional) AS net FROM exposures GROUP BY 1, 3" for c in ("sector", "country", "currency")) + ")"


@query("p2_grouped_exposure", _GROUPS + " SELECT portfolio_id, dimension, value, round(gross, 2) AS gross, round(net, 2) AS net FROM g")
def p2(spark, d):
    return portfolio.grouped(views.exposures(spark, d), "portfolio_id", ["sector", "country", "currency"]).withColumns({"gross": F.round("gross", 2), "net": F.round("net", 2)})


@query("p5_concentration", _GROUPS + ", s AS (SELECT *, gross / sum(gross) OVER (PARTITION BY portfolio_id, dimension) AS share FROM g) SELECT portfolio_id, dimension, value, round(share, 6) AS share FROM s WHERE share > 0.2::DOUBLE")
def p5(spark, d):
    g = portfolio.grouped(views.exposures(spark, d), "portfolio_id", ["sector", "country", "currency"])
    return portfolio.concentration(g, "portfolio_id", 0.2).select("portfolio_id", "dimension", "value", r6(F.col("share"), "share"))


@query("p6_stress", _EXP + """, sc AS (SELECT scenario, r_name AS currency, -0.01::DOUBLE * scenario * (r_regionkey + 1) AS shock FROM region CROSS JOIN (VALUES (1), (2), (3)) AS x(scenario)) SELECT portfolio_id, scenario, round(sum(notional * shock), 2) AS pnl FROM exposures JOIN sc USING (currency) GROUP BY 1, 2""")
def p6(spark, d):
    sc = table(spark, d, "region").withColumn("scenario", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("scenario", F.col("r_name").alias("currency"), (F.lit(-0.01) * F.col("scenario") * (F.col("r_regionkey") + 1)).alias("shock"))
    return portfolio.stress(views.exposures(spark, d), sc, "portfolio_id", "currency").select("portfolio_id", "scenario", F.round("pnl", 2).alias("pnl"))


@query("p7_historical_var", _RET + """, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY r, day) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY instrument_id) * 0.05::DOUBLE)) AS k FROM returns)
    SELECT instrument_id, round(greatest(0, max(CASE WHEN rn = k THEN -r END)), 6) AS var, round(greatest(0, avg(CASE WHEN rn <= k THEN -r END)), 6) AS cvar FROM k GROUP BY 1""")
def p7(spark, d):
    return portfolio.var_cvar(views.returns(spark, d), "instrument_id", "r", 0.05).select("instrument_id", r6(F.col("var"), "var"), r6(F.col("cvar"), "cvar"))


@query("p10_inverse_risk", _RET + ", v AS (SELECT instrument_id, year(min(day))::INT AS portfolio, stddev_pop(r) AS v FROM returns GROUP BY 1), w AS (SELECT *, (1 / v) / sum(1 / v) OVER (PARTITION BY portfolio) AS w FROM v) SELECT instrument_id, portfolio, round(w, 6) AS weight, CASE WHEN max(w) OVER (PARTITION BY portfolio) > 0.5::DOUBLE THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM w")
def p10(spark, d):
    v = views.returns(spark, d).groupBy("instrument_id").agg(F.year(F.min("day")).alias("portfolio"), F.stddev_pop("r").alias("volatility"))
    return portfolio.inverse_risk(v, "portfolio", 0.5).select("instrument_id", "portfolio", r6(F.col("weight"), "weight"), "status")


_COV = _RET + ", c AS (SELECT a.instrument_id AS i, b.instrument_id AS j, covar_pop(a.r, b.r) AS cov, count(*) AS n FROM returns a JOIN returns b USING (day) WHERE a.instrument_id <= b.instrument_id GROUP BY 1, 2)"


@query("p11_covariance_pairs", _COV + " SELECT i, j, round(cov, 8) AS cov, n FROM c")
def p11(spark, d):
    return portfolio.covariance_pairs(views.returns(spark, d), "instrument_id", "day", "r").select("i", "j", F.round("cov", 8).alias("cov"), "n")


@query("p12_stressed_covariance", _COV + " SELECT c.i, c.j, round(CASE WHEN c.i = c.j THEN c.cov ELSE c.cov + 0.3::DOUBLE * (sqrt(x.cov * y.cov) - c.cov) END, 8) AS stressed FROM c JOIN c x ON x.i = c.i AND x.j = c.i JOIN c y ON y.i = c.j AND y.j = c.j")
def p12(spark, d):
    pairs = portfolio.covariance_pairs(views.returns(spark, d), "instrument_id", "day", "r")
    return portfolio.stressed_covariance(pairs, 0.3).select("i", "j", F.round("stressed", 8).alias("stressed"))


@query("p24_reservation", """WITH RECURSIVE o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, o_totalprice::DOUBLE AS amount, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
    f AS (SELECT o_custkey, month, o_orderkey, amount, rn, amount <= 200000 AS accepted, CASE WHEN amount <= 200000 THEN amount ELSE 0 END AS total FROM o WHERE rn = 1
    UNION ALL SELECT o.o_custkey, o.month, o.o_orderkey, o.amount, o.rn, f.total + o.amount <= 200000, CASE WHEN f.total + o.amount <= 200000 THEN f.total + o.amount ELSE f.total END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.month = f.month AND o.rn = f.rn + 1)
    SELECT o_custkey, month, o_orderkey, amount, accepted FROM f""")
def p24(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    out = portfolio.reserve(o, ["o_custkey", "month"], ["o_orderdate", "o_orderkey"], "o_totalprice", 200_000.0)
    return out.select("o_custkey", "month", "o_orderkey", "amount", "accepted")


@query("m1_threshold_metrics", _HOLD + """, s AS (SELECT model_id, sum((candidate >= 0.5)::INT * outcome) AS tp, sum((candidate >= 0.5)::INT) AS said, sum(outcome) AS y FROM holdout GROUP BY 1), m AS (SELECT model_id, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN y > 0 THEN tp / y ELSE 0 END AS r FROM s)
    SELECT model_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def m1(spark, d):
    return evaluation.threshold_metrics(views.holdout(spark, d), "candidate", 0.5).select("model_id", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query("m3_losses", _HOLD + " SELECT model_id, round(avg(pow(candidate - outcome, 2)), 6) AS brier, round(avg(-ln(CASE WHEN outcome = 1 THEN greatest(candidate, 1e-18) ELSE greatest(1 - candidate, 1e-18) END)), 6) AS log_loss, count(*) AS n FROM holdout GROUP BY 1")
def m3(spark, d):
    return evaluation.losses(views.holdout(spark, d), "candidate").select("model_id", r6(F.col("brier"), "brier"), r6(F.col("log_loss"), "log_loss"), "n")


@query("m5_roc_auc", _HOLD + " SELECT a.model_id, round(avg(CASE WHEN a.candidate > b.candidate THEN 1.0 WHEN a.candidate = b.candidate THEN 0.5 WHEN b.candidate IS NOT NULL THEN 0 END), 6) AS roc_auc FROM holdout a LEFT JOIN holdout b ON a.model_id = b.model_id AND a.outcome = 1 AND b.outcome = 0 GROUP BY 1")
def m5(spark, d):
    return evaluation.roc_auc(views.holdout(spark, d), "candidate").select("model_id", r6(F.col("roc_auc"), "roc_auc"))


@query("m6_pr_auc", _HOLD + """, s AS (SELECT model_id, candidate, sum(outcome) AS pos, count(*) AS n FROM holdout GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY model_id ORDER BY candidate DESC) AS tp, sum(n) OVER (PARTITION BY model_id ORDER BY candidate DESC) AS said, sum(pos) OVER (PARTITION BY model_id) AS all_pos FROM s)
    SELECT model_id, round(sum(pos / all_pos * tp / said), 6) AS pr_auc FROM c GROUP BY 1""")
def m6(spark, d):
    return evaluation.pr_auc(views.holdout(spark, d), "candidate").select("model_id", r6(F.col("pr_auc"), "pr_auc"))


@query("m7_information_coefficient", _HOLD + " SELECT model_id, round(CASE WHEN min(candidate) = max(candidate) OR min(outcome) = max(outcome) THEN 0 ELSE corr(candidate, outcome) END, 6) AS ic FROM holdout GROUP BY 1")
def m7(spark, d):
    return evaluation.information_coefficient(views.holdout(spark, d), "candidate").select("model_id", r6(F.col("ic"), "ic"))


_BINS = _HOLD + """, b AS (SELECT model_id, least(floor(candidate * 8), 7)::INT AS bin, count(*) AS n, avg(candidate) AS mean_p, avg(outcome) AS rate FROM holdout GROUP BY 1, 2), e AS (SELECT DISTINCT model_id, unnest(range(8))::INT AS bin FROM holdout), f AS (SELECT e.model_id, e.bin, coalesce(n, 0) AS n, mean_p, rate FROM e LEFT JOIN b USING (model_id, bin))"""


@query("m8_calibration", _BINS + " SELECT model_id, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM f")
def m8(spark, d):
    return evaluation.calibration(views.holdout(spark, d), "candidate", 8).select("model_id", "bin", "n", r6(F.col("mean_p"), "mean_p"), r6(F.col("rate"), "rate"))


@query("m8_calibration_error", _BINS + " SELECT model_id, round(sum(coalesce(n * abs(mean_p - rate), 0)) / sum(n), 6) AS ece FROM f GROUP BY 1")
def m8e(spark, d):
    return evaluation.calibration_error(evaluation.calibration(views.holdout(spark, d), "candidate", 8)).select("model_id", r6(F.col("ece"), "ece"))


@query("m10_half_stability", _HOLD + """, h AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY observation_id) <= floor(count(*) OVER (PARTITION BY model_id) / 2) AS first FROM holdout)
    SELECT model_id, round(abs(avg(CASE WHEN first THEN pow(candidate - outcome, 2) END) - avg(CASE WHEN NOT first THEN pow(candidate - outcome, 2) END)), 6) AS instability FROM h GROUP BY 1""")
def m10(spark, d):
    return evaluation.half_stability(views.holdout(spark, d), "candidate").select("model_id", r6(F.col("instability"), "instability"))


# execution: orders are order keys, fills their lines

_FILLS = """WITH f AS (SELECT l_orderkey AS order_id, l_quantity AS quantity, 100 + (l_extendedprice % 20) AS price FROM lineitem WHERE l_linenumber <> 2), o AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS quantity, max(100 + (l_extendedprice % 20)) AS decision_price,
    CASE WHEN l_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM lineitem GROUP BY 1), r AS (SELECT order_id, sum(quantity) AS filled, sum(quantity * price) / sum(quantity) AS vwap, count(*) AS fills FROM f GROUP BY 1), x AS (SELECT o.*, coalesce(filled, 0) AS filled, vwap, fills FROM o LEFT JOIN r USING (order_id))"""


def _rolled(spark, d):
    li = table(spark, d, "lineitem").withColumn("price", F.lit(100) + F.col("l_extendedprice") % 20)
    fills = li.where("l_linenumber <> 2").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), "price")
    side = F.when(F.col("l_orderkey") % 2 == 0, "BUY").otherwise("SELL")
    orders = li.groupBy(F.col("l_orderkey").alias("order_id"), side.alias("side")).agg(F.sum("l_quantity").alias("quantity"), F.max("price").alias("decision_price"))
    return execution.order_roll_up(fills, orders)


@query("e1_order_roll_up", _FILLS + " SELECT order_id, filled, round(vwap, 6) AS vwap, CASE WHEN filled = 0 THEN 'OPEN' WHEN filled < quantity THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status FROM x")
def e1(spark, d):
    return _rolled(spark, d).select("order_id", "filled", r6(F.col("vwap"), "vwap"), "status")


@query("e2_execution_quality", _FILLS + """, s AS (SELECT *, (CASE side WHEN 'BUY' THEN 1 ELSE -1 END) * (vwap - decision_price) / decision_price AS slip FROM x)
    SELECT order_id, round(filled / quantity, 6) AS fill_ratio, round(slip, 6) AS slippage, round(slip * filled * decision_price, 4) AS shortfall, coalesce(slip > 0.05::DOUBLE, false) AS breach FROM s""")
def e2(spark, d):
    q = execution.quality(_rolled(spark, d), 0.05)
    return q.select("order_id", r6(F.col("fill_ratio"), "fill_ratio"), r6(F.col("slippage"), "slippage"), F.round("shortfall", 4).alias("shortfall"), "breach")


@query("e5_positions", """WITH RECURSIVE x AS (SELECT l_suppkey AS account_id, l_partkey AS instrument_id, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::DOUBLE AS x, (100 + l_extendedprice % 20)::DOUBLE AS p,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag) AS rn FROM lineitem),
    f AS (SELECT account_id, instrument_id, rn, x AS q, CASE WHEN x = 0 THEN 0 ELSE p END AS c, -x * p AS cash FROM x WHERE rn = 1
    UNION ALL SELECT f.account_id, f.instrument_id, x.rn, f.q + x.x, CASE WHEN f.q + x.x = 0 THEN 0 WHEN f.q * x.x >= 0 THEN (f.c * f.q + x.p * x.x) / (f.q + x.x) WHEN f.q * (f.q + x.x) > 0 THEN f.c ELSE x.p END, f.cash - x.x * x.p
        FROM f JOIN x ON x.account_id = f.account_id AND x.instrument_id = f.instrument_id AND x.rn = f.rn + 1)
    SELECT account_id, instrument_id, round(arg_max(q, rn), 6) AS quantity, round(arg_max(c, rn), 6) AS average_cost, round(arg_max(cash, rn), 6) AS cash FROM f GROUP BY 1, 2""")
def e5(spark, d):
    li = table(spark, d, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"]
    fills = li.select(F.col("l_suppkey").alias("account_id"), F.col("l_partkey").alias("instrument_id"), *order, signed.alias("signed"), (F.lit(100) + F.col("l_extendedprice") % 20).alias("price"))
    p = execution.positions(fills, ["account_id", "instrument_id"], order)
    return p.select("account_id", "instrument_id", r6(F.col("quantity"), "quantity"), r6(F.col("average_cost"), "average_cost"), r6(F.col("cash"), "cash"))


@query("e8_reconcile_positions", """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_suppkey % 7 > 0 OR l_linenumber > 1 GROUP BY 1)
    SELECT l_suppkey, coalesce(a.q, 0) AS ours, coalesce(b.q, 0) AS theirs, coalesce(a.q, 0) - coalesce(b.q, 0) AS difference FROM a FULL JOIN b USING (l_suppkey) WHERE abs(coalesce(a.q, 0) - coalesce(b.q, 0)) > 0.01""")
def e8(spark, d):
    li = table(spark, d, "lineitem")
    total = lambda x: x.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return execution.reconcile_positions(total(li), total(li.where("l_suppkey % 7 > 0 OR l_linenumber > 1")), ["l_suppkey"], "q", 0.01)
