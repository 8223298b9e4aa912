"""Queries on controls: findings, life cycles, capacity, scorecards, regimes, limits and pre-trade checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import features as f
from tidemark.operators import backtest, controls, validation
from tidemark.operators.controls import reasons
from tidemark.plans.market import _FEAT, RUN_SQL, SIGNALS_SQL, W, _frame, _run, r6
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views


def why(named: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in named.items()) + ")"


# findings


@query("q8_corporate_action_mismatch", "SELECT l_orderkey, l_linenumber, l_partkey, 'CORPORATE_ACTION_MISMATCH' AS finding FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def q8(spark, d):
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").where(bad).select("l_orderkey", "l_linenumber", "l_partkey", F.lit("CORPORATE_ACTION_MISMATCH").alias("finding"))


@query("q9_session_mismatch", "SELECT event_id, user_id, hour(ts)::INT AS hour FROM events WHERE hour(ts) NOT BETWEEN 9 AND 16 OR isodow(ts) > 5")
def q9(spark, d):
    shut = ~F.hour("ts").between(9, 16) | (F.weekday("ts") > 4)
    return table(spark, d, "events").where(shut).select("event_id", "user_id", F.hour("ts").alias("hour"))


@query("q14_active_blocks", """WITH a AS (SELECT event_id AS assessment_id, ts AS evaluated_at, CASE event_id % 3 WHEN 0 THEN 'instrument' WHEN 1 THEN 'strategy' ELSE 'global' END AS scope_type,
    CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id % 7 ELSE 0 END AS scope_value, value < 60 AS blocking FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
    k AS (SELECT *, row_number() OVER (PARTITION BY scope_type, scope_value ORDER BY evaluated_at DESC, assessment_id DESC) AS rn FROM a), b AS (SELECT * FROM k WHERE rn = 1 AND blocking)
    SELECT c_custkey AS request_id, count(*) AS blocks FROM customer JOIN b ON (scope_type = 'instrument' AND scope_value = c_custkey % 150) OR (scope_type = 'strategy' AND scope_value = c_nationkey % 7) OR (scope_type = 'global' AND scope_value = 0) GROUP BY 1""")
def q14(spark, d):
    kind = F.col("event_id") % 3
    a = table(spark, d, "events").select(
        F.col("event_id").alias("assessment_id"), F.col("ts").alias("evaluated_at"), F.when(kind == 0, "instrument").when(kind == 1, "strategy").otherwise("global").alias("scope_type"),
        F.when(kind == 0, F.col("user_id")).when(kind == 1, F.col("user_id") % 7).otherwise(0).alias("scope_value"), (F.col("value") < 60).alias("blocking"),
    )
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 150).alias("i"), (F.col("c_nationkey") % 7).alias("s"), F.lit(0).alias("g"))
    return controls.active_blocks(a, asked, {"instrument": "i", "strategy": "s", "global": "g"}, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("q19_provenance_check", "SELECT source, count(*) AS documents FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM documents WHERE doc_id % 10 = 0 AND lang = 'en' AND source IS NOT NULL) GROUP BY 1")
def q19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    permitted = docs.where("doc_id % 10 = 0 AND lang = 'en'").select("source").distinct()
    return docs.join(permitted, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


_ACTION = {"ratio_required": "kind = 'SPLIT' AND ratio IS NULL", "amount_required": "kind = 'DIVIDEND' AND amount IS NULL", "successor_required": "kind = 'SYMBOL_CHANGE' AND successor IS NULL", "effective_before_announced": "lead_days < 0"}


@query("q20_validate_corporate_actions", f"""WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'DIVIDEND' WHEN 2 THEN 'SYMBOL_CHANGE' ELSE 'DELISTING' END AS kind, CASE WHEN l_quantity > 10 THEN l_quantity / 10 END AS ratio,
    CASE WHEN l_discount > 0.02 THEN l_discount END AS amount, CASE WHEN l_partkey % 5 > 0 THEN l_partkey END AS successor, l_quantity - 3 AS lead_days FROM lineitem), v AS (SELECT kind, {why(_ACTION)} AS reasons FROM a) SELECT kind, reasons, count(*) AS actions FROM v GROUP BY 1, 2""")
def q20(spark, d):
    n = F.col("l_linenumber") % 4
    a = table(spark, d, "lineitem").select(
        F.when(n == 0, "SPLIT").when(n == 1, "DIVIDEND").when(n == 2, "SYMBOL_CHANGE").otherwise("DELISTING").alias("kind"), F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 10).alias("ratio"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("amount"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey")).alias("successor"), (F.col("l_quantity") - 3).alias("lead_days"),
    )
    return a.groupBy("kind", reasons(_ACTION).alias("reasons")).agg(F.count(F.lit(1)).alias("actions"))


# signals


@query("g7_breakout_exposure", f"{_FEAT}, v AS (SELECT instrument_id, day, CASE WHEN count(*) {_frame(10)} = 10 THEN close / max(close) {_frame(10)} - 1 END AS x FROM b) SELECT instrument_id, day, CASE WHEN x >= 0 THEN 0.8::DOUBLE WHEN x < 0 THEN 0::DOUBLE END AS exposure FROM v")
def g7(spark, d):
    x = F.col("x")
    return f.with_basics(views.bars(spark, d)).select("instrument_id", "day", f.breakout(10).alias("x")).select("instrument_id", "day", F.when(x >= 0, 0.8).when(x < 0, 0.0).alias("exposure"))


@query("g10_series_eligibility", f"{_FEAT}, v AS (SELECT instrument_id, year(day)::INT AS y, close / lag(close, 10) OVER {W}) - 1 AS m FROM b) SELECT instrument_id, y, count(*) AS rows, sum((m IS NULL)::INT)::BIGINT AS unavailable, bool_and(m IS NOT NULL) AS eligible FROM v GROUP BY 1, 2")
def g10(spark, d):
    v = f.with_basics(views.bars(spark, d)).select("instrument_id", F.year("day").alias("y"), f.change(10).alias("m"))
    ready = F.col("m").isNotNull()
    return v.groupBy("instrument_id", "y").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ready).alias("unavailable"), F.bool_and(ready).alias("eligible"))


#: The stages of a signal's validation, in order.
_STAGES = ("data", "strategy", "regime", "liquidity", "portfolio", "risk", "broker", "execution", "user_policy")
_FAILS = {s: f"(o_orderkey * {k + 3}) % 11 = 0" for k, s in enumerate(_STAGES)}


@query("g11_stage_validation", f"SELECT o_orderkey AS signal_id, {why(_FAILS)} AS failed, CASE WHEN {_FAILS['data']} THEN 'BLOCKED_BY_DATA' WHEN {why(_FAILS)} <> '' THEN 'BLOCKED_BY_RISK' ELSE 'VALIDATED' END AS status FROM orders")
def g11(spark, d):
    o = table(spark, d, "orders").withColumn("failed", reasons(_FAILS))
    status = F.when(F.array_contains(F.split("failed", ","), "data"), "BLOCKED_BY_DATA").when(F.col("failed") != "", "BLOCKED_BY_RISK").otherwise("VALIDATED")
    return o.select(F.col("o_orderkey").alias("signal_id"), "failed", status.alias("status"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'CANDIDATE' WHEN 'view' THEN 'VALIDATED' WHEN 'click' THEN 'WAITING_FOR_ENTRY' WHEN 'purchase' THEN 'ACTIVE' ELSE 'EXPIRED' END"
_LOG_SQL = f"WITH l AS (SELECT user_id, event_id, ts, {_STATUS} AS status FROM events)"
_MOVES_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in controls.SIGNAL_MOVES.items() for b in bs)


def _life(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(_STATUS).alias("status"))


@query("g12_lifecycle_violations", f"{_LOG_SQL}, b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS came_from FROM l) SELECT user_id, event_id, came_from, status FROM b WHERE came_from IS NOT NULL AND (came_from, status) NOT IN ({_MOVES_SQL})")
def g12(spark, d):
    return controls.transition_violations(_life(spark, d), "user_id", ["ts", "event_id"], "status", controls.SIGNAL_MOVES).select("user_id", "event_id", "came_from", "status")


@query("g13_expire_due", f"{_LOG_SQL} SELECT user_id, status, ts AS since FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1 AND status IN ('VALIDATED', 'WAITING_FOR_ENTRY', 'ACTIVE') AND ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-30'")
def g13(spark, d):
    last = _life(spark, d).groupBy("user_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.status", F.col("x.ts").alias("since"))
    return last.where(F.col("status").isin("VALIDATED", "WAITING_FOR_ENTRY", "ACTIVE") & (F.col("since") + F.expr("INTERVAL 6 HOURS") <= F.lit("2024-01-30").cast("timestamp_ntz")))


_ORDER_MOVES = {"N": ("A", "R"), "A": ("R", "A")}


@query("g14_order_status_audit", "WITH b AS (SELECT l_orderkey, l_returnflag AS status, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS came_from FROM lineitem) SELECT came_from, status, count(*) AS n FROM b WHERE came_from IS NOT NULL AND (came_from, status) NOT IN (('N', 'A'), ('N', 'R'), ('A', 'R'), ('A', 'A')) GROUP BY 1, 2")
def g14(spark, d):
    log = table(spark, d, "lineitem").withColumn("status", F.col("l_returnflag"))
    bad = controls.transition_violations(log, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "status", _ORDER_MOVES)
    return bad.groupBy("came_from", "status").agg(F.count(F.lit(1)).alias("n"))


# validation and scorecards

_KEYS = ["strategy", "instrument_id"]


@query("v3_walk_forward_run", SIGNALS_SQL + """, z AS (SELECT instrument_id, count(*) AS n FROM bars GROUP BY 1), s AS (SELECT instrument_id, unnest(range(0, ((n - 255) // 100 + 1)::BIGINT))::INT AS split FROM z WHERE n >= 255),
    p AS (SELECT *, row_number() OVER (PARTITION BY strategy, instrument_id ORDER BY day) - 1 AS place FROM sig), j AS (SELECT p.*, split FROM p JOIN s USING (instrument_id) WHERE place BETWEEN split * 100 + 204 AND split * 100 + 254),
    h AS (SELECT *, lag(signal) OVER w AS position, close / lag(close) OVER w - 1 AS move FROM j WINDOW w AS (PARTITION BY strategy, instrument_id, split ORDER BY day)),
    t AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY strategy, instrument_id, split ORDER BY day), 0)) AS turnover FROM h)
    SELECT strategy, instrument_id, split, count(*) AS periods, round(product(1 + position * move - turnover * 0.001::DOUBLE) - 1, 6) AS held_out, sum(turnover)::BIGINT AS turnover FROM t WHERE move IS NOT NULL GROUP BY 1, 2, 3""")
def v3(spark, d):
    from tidemark.operators import signals

    b = views.bars(spark, d)
    splits = validation.walk_forward_splits(b.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n")), "instrument_id", 200, 50, 100, 5)
    placed = signals.baseline_signals(b).withColumn("place", F.row_number().over(backtest.series()) - 1)
    inside = placed.join(splits.select("instrument_id", "split", "test_start", "test_end"), "instrument_id").where("place >= test_start - 1 AND place < test_end")
    run = backtest.vector_backtest(inside, keys=(*_KEYS, "split"))
    return run.groupBy(*_KEYS, "split").agg(F.count(F.lit(1)).alias("periods"), r6(F.exp(F.sum(F.log1p("net"))) - 1, "held_out"), F.sum("turnover").cast("long").alias("turnover"))


@query("v6_capacity", RUN_SQL + """, v AS (SELECT instrument_id, avg(volume) * avg(close) AS adv FROM bars GROUP BY 1), tt AS (SELECT strategy, instrument_id, max(turnover) AS most, avg(turnover) AS mean FROM run GROUP BY 1, 2), g AS (SELECT tt.*, adv, c::DOUBLE AS capital, c * most / adv AS participation FROM tt JOIN v USING (instrument_id) CROSS JOIN (VALUES (100.0), (1000.0), (10000.0)) AS x(c)),
    e AS (SELECT *, 0.0002::DOUBLE + 0.001::DOUBLE * sqrt(participation) AS extra FROM g) SELECT strategy, instrument_id, capital, round(capital * any_value(mean), 4) AS average_order, round(any_value(participation), 6) AS participation, round(any_value(CASE WHEN participation <= 0.1::DOUBLE THEN 1 ELSE 0.1::DOUBLE / participation END), 6) AS fill_share,
    round(any_value(adv * 0.1::DOUBLE / greatest(most, 1e-8)), 4) AS usable_capital, round(sum(ln(1 + net - turnover * extra)), 6) AS log_growth FROM e JOIN run USING (strategy, instrument_id) GROUP BY 1, 2, 3""")
def v6(spark, d):
    adv = views.bars(spark, d).groupBy("instrument_id").agg((F.avg("volume") * F.avg("close")).alias("adv"))
    run = _run(spark, d).select(*_KEYS, "turnover", "net").join(adv, "instrument_id")
    out = controls.capacity(run, _KEYS, [100.0, 1000.0, 10000.0], "adv", 0.1, 0.0002, 0.001)
    return out.select(*_KEYS, "capital", F.round(F.col("capital") * F.col("mean"), 4).alias("average_order"), r6(F.col("participation"), "participation"), r6(F.col("fill_share"), "fill_share"), F.round("usable", 4).alias("usable_capital"), r6(F.col("log_growth"), "log_growth"))


@query("v13_parameter_stability", """WITH g AS (SELECT c_mktsegment AS strategy, c_nationkey AS p1, (c_custkey % 4)::INT AS p2, avg(c_acctbal) AS r FROM customer GROUP BY 1, 2, 3), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY r DESC, p1, p2) AS rn FROM g) WHERE rn = 1),
    j AS (SELECT g.strategy, s.p1, s.p2, (g.p1 <> s.p1)::INT + (g.p2 <> s.p2)::INT AS apart, g.r, s.r AS best FROM g JOIN s USING (strategy)) SELECT strategy, any_value(p1) AS p1, any_value(p2) AS p2, sum((apart = 1)::INT)::BIGINT AS neighbours, sum((r >= best * 0.9)::INT)::BIGINT AS plateau,
    round(sum((apart = 1 AND r >= best * 0.75)::INT) / sum((apart = 1)::INT), 6) AS score FROM j GROUP BY 1""")
def v13(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("strategy"), F.col("c_nationkey").alias("p1"), (F.col("c_custkey") % 4).cast("int").alias("p2")).agg(F.avg("c_acctbal").alias("r"))
    best = g.groupBy("strategy").agg(F.max_by(F.struct("p1", "p2", "r"), F.struct("r", -F.col("p1"), -F.col("p2"))).alias("s"))
    j = g.join(best, "strategy").withColumn("apart", (F.col("p1") != F.col("s.p1")).cast("int") + (F.col("p2") != F.col("s.p2")).cast("int"))
    near = F.col("apart") == 1
    good = F.count_if(near & (F.col("r") >= F.col("s.r") * 0.75))
    return j.groupBy("strategy", F.col("s.p1").alias("p1"), F.col("s.p2").alias("p2")).agg(F.count_if(near).alias("neighbours"), F.count_if(F.col("r") >= F.col("s.r") * 0.9).alias("plateau"), r6(good / F.count_if(near), "score"))


_PROMOTE = {"insufficient_held_out_periods": "n < 1400", "held_out_return_below_threshold": "g < 0", "turnover_limit": "t > 600", "sharpe_below_threshold": "s IS NULL OR s < 0.5"}


@query("v19_promotion_decision", RUN_SQL + f", m AS (SELECT strategy, instrument_id, count(*) AS n, sum(ln(1 + net)) AS g, sum(turnover) AS t, CASE WHEN max(net) > min(net) THEN avg(net) / stddev_pop(net) * sqrt(252) END AS s FROM run GROUP BY 1, 2) SELECT strategy, instrument_id, {why(_PROMOTE)} AS reasons, CASE WHEN {why(_PROMOTE)} = '' THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS status FROM m")
def v19(spark, d):
    m = _run(spark, d).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("net")).alias("g"), F.sum("turnover").alias("t"), backtest.sharpe().alias("s"))
    return m.withColumn("reasons", reasons(_PROMOTE)).select(*_KEYS, "reasons", F.when(F.col("reasons") == "", "REVIEW_REQUIRED").otherwise("BLOCKED").alias("status"))


_CARD = """, u AS (SELECT *, sum((drawdown <= 1e-12)::INT) OVER (PARTITION BY strategy, instrument_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM curve), l AS (SELECT strategy, instrument_id, max(n) AS longest FROM (SELECT strategy, instrument_id, island, sum((drawdown > 1e-12)::INT)::BIGINT AS n FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2),
    a AS (SELECT strategy, instrument_id, count(*) AS n, sum(ln(1 + net)) AS g, sqrt(avg(pow(least(net, 0), 2))) AS dd, avg(net) AS mean, median(net) AS med, max(drawdown) AS mdd, sum((net > 0)::INT)::BIGINT AS wins, sum((net < 0)::INT)::BIGINT AS losses, avg(CASE WHEN net > 0 THEN net END) AS win, avg(CASE WHEN net < 0 THEN net END) AS loss, avg(position) AS exposure, sum(turnover) AS turnover FROM curve GROUP BY 1, 2)"""


def _card(spark, d):
    up = Window.partitionBy(*_KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = backtest.equity_curve(_run(spark, d)).withColumn("island", F.sum((F.col("drawdown") <= 1e-12).cast("int")).over(up))
    net = F.col("net")
    longest = curve.groupBy(*_KEYS, "island").agg(F.count_if(F.col("drawdown") > 1e-12).alias("n")).groupBy(*_KEYS).agg(F.max("n").alias("longest"))
    a = curve.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log1p("net")).alias("g"), F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), F.lit(2)))).alias("dd"), F.avg(net).alias("mean"), F.percentile("net", 0.5).alias("med"), F.max("drawdown").alias("mdd"),
        F.count_if(net > 0).alias("wins"), F.count_if(net < 0).alias("losses"), F.avg(F.when(net > 0, net)).alias("win"), F.avg(F.when(net < 0, net)).alias("loss"), F.avg("position").alias("exposure"), F.sum("turnover").alias("turnover"),
    )
    return a.join(longest, _KEYS)


@query("b11_complexity_penalty", RUN_SQL + _CARD + " SELECT strategy, instrument_id, round(2 * 2 + turnover * 10 + 100.0::DOUBLE / n, 6) AS penalty FROM a")
def b11(spark, d):
    return _card(spark, d).select(*_KEYS, r6(F.lit(2) * 2 + F.col("turnover") * 10 + F.lit(100.0) / F.col("n"), "penalty"))


# regimes

_REG = with_views("bars") + f""", m AS (SELECT instrument_id, day, close / lag(close, 4) OVER {W}) - 1 AS m, lead(close) OVER {W}) / close - 1 AS nxt FROM bars), s AS (SELECT *, least(0.4::DOUBLE, abs(m) * 10) AS s FROM m WHERE m IS NOT NULL),
    p AS (SELECT instrument_id, day, nxt, CASE WHEN m > 0 THEN 0.3::DOUBLE + s ELSE 0.3 END AS up, CASE WHEN m < 0 THEN 0.3::DOUBLE + s ELSE 0.3 END AS down FROM s), q AS (SELECT *, 1 - up - down AS flat FROM p),
    e AS (SELECT 'rule' AS method, instrument_id, day, nxt, up, down, flat FROM q UNION ALL SELECT 'ensemble', instrument_id, day, nxt, 0.75::DOUBLE * up + 0.25::DOUBLE / 3, 0.75::DOUBLE * down + 0.25::DOUBLE / 3, 0.75::DOUBLE * flat + 0.25::DOUBLE / 3 FROM q)"""


def _regimes(spark, d):
    b = views.bars(spark, d).withColumn("nxt", F.lead("close").over(f.ordered()) / F.col("close") - 1)
    p = validation.simple_regimes(b, 5, ("nxt",)).select("instrument_id", "day", "nxt", F.col("p_up").alias("up"), F.col("p_down").alias("down")).withColumn("flat", 1 - F.col("up") - F.col("down"))
    both = F.array(*(F.struct(F.lit(n).alias("method"), *((F.col(c) * k + (1 - k) / 3).alias(c) for c in ("up", "down", "flat"))) for n, k in (("rule", 1.0), ("ensemble", 0.75))))
    return p.select("instrument_id", "day", "nxt", F.explode(both).alias("x")).select("x.method", "instrument_id", "day", "nxt", "x.up", "x.down", "x.flat")


@query("r7_regime_ensemble", _REG + " SELECT instrument_id, day, round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat FROM e WHERE method = 'ensemble'")
def r7(spark, d):
    return _regimes(spark, d).where("method = 'ensemble'").select("instrument_id", "day", *(r6(F.col(c), c) for c in ("up", "down", "flat")))


_BRIER = "pow(up - CASE WHEN nxt > 0 THEN 1 ELSE 0 END, 2) + pow(down - CASE WHEN nxt < 0 THEN 1 ELSE 0 END, 2) + pow(flat - CASE WHEN nxt = 0 THEN 1 ELSE 0 END, 2)"
_HIT = "CASE WHEN nxt > 0 THEN up > down + 1e-9 AND up > flat + 1e-9 WHEN nxt < 0 THEN down > up + 1e-9 AND down > flat + 1e-9 ELSE flat > up + 1e-9 AND flat > down + 1e-9 END"


@query("r8_method_evaluation", _REG + f" SELECT method, instrument_id, count(*) AS pairs, round(avg({_BRIER}), 6) AS brier, round(avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e WHERE nxt IS NOT NULL GROUP BY 1, 2")
def r8(spark, d):
    e = _regimes(spark, d).where("nxt IS NOT NULL")
    return e.groupBy("method", "instrument_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg(F.expr(_BRIER)), "brier"), r6(F.avg(F.expr(_HIT).cast("double")), "accuracy"))


@query("r3_ensemble_allocation", _REG + """, k(strategy, ku, kd, kf) AS (VALUES ('cross', 2.0::DOUBLE, -1.0::DOUBLE, 0.5::DOUBLE), ('reversion', -1.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE), ('carry', 0.5::DOUBLE, 0.2::DOUBLE, 1.0::DOUBLE)), sc AS (SELECT instrument_id, day, strategy, up * ku + down * kd + flat * kf AS score FROM e CROSS JOIN k WHERE method = 'rule'),
    w AS (SELECT *, CASE WHEN score > 1e-9 THEN score / sum(CASE WHEN score > 1e-9 THEN score END) OVER (PARTITION BY instrument_id, day) END AS weight FROM sc) SELECT instrument_id, day, strategy, round(score, 6) AS score, round(weight, 6) AS weight, CASE WHEN max(weight) OVER (PARTITION BY instrument_id, day) > 0.6::DOUBLE THEN 'REJECTED' ELSE 'ALLOCATED' END AS status FROM w""")
def r3(spark, d):
    kinds = {"cross": (2.0, -1.0, 0.5), "reversion": (-1.0, 2.0, 0.5), "carry": (0.5, 0.2, 1.0)}
    rows = F.array(*(F.struct(F.lit(n).alias("strategy"), (F.col("up") * a + F.col("down") * b + F.col("flat") * c).alias("score")) for n, (a, b, c) in kinds.items()))
    # the few strategies of a decision stay in its row, so the allocation needs no further shuffle
    whole = F.aggregate("rows", F.lit(0.0), lambda t, x: t + F.when(x["score"] > 1e-9, x["score"]).otherwise(0.0))
    scored = _regimes(spark, d).where("method = 'rule'").withColumn("rows", rows).withColumn("whole", whole)
    weighed = scored.withColumn("rows", F.transform("rows", lambda x: F.struct(x["strategy"].alias("strategy"), x["score"].alias("score"), F.when(x["score"] > 1e-9, x["score"] / F.col("whole")).alias("weight"))))
    status = F.when(F.exists("rows", lambda x: x["weight"] > 0.6), "REJECTED").otherwise("ALLOCATED")
    return weighed.select("instrument_id", "day", status.alias("status"), F.explode("rows").alias("x")).select("instrument_id", "day", "x.strategy", r6(F.col("x.score"), "score"), r6(F.col("x.weight"), "weight"), "status")


_R10 = {"regime_run_blocked": "blocked", "preapproved_regime_risk_bound_exceeded": "proposed > 6", "automatic_risk_increase_prohibited": "proposed > present"}
_R10_ACT = "CASE WHEN proposed = 0 THEN 'DISABLE' WHEN proposed < present THEN 'REDUCE' WHEN proposed > present THEN 'INCREASE' ELSE 'MAINTAIN' END"


@query("r10_risk_multiplier", f"WITH c AS (SELECT o_orderkey, o_orderkey % 9 AS proposed, o_custkey % 7 AS present, o_orderstatus = 'F' AS blocked FROM orders) SELECT o_orderkey, {_R10_ACT} AS action, {why(_R10)} AS reasons FROM c")
def r10(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("proposed"), (F.col("o_custkey") % 7).alias("present"), (F.col("o_orderstatus") == "F").alias("blocked"))
    return c.select("o_orderkey", F.expr(_R10_ACT).alias("action"), reasons(_R10).alias("reasons"))


# portfolio limits

_EXP = with_views("exposures")


@query("p3_factor_exposure", _EXP + " SELECT portfolio_id, 'size' AS factor, round(sum(notional * (position_id % 5) / 4.0::DOUBLE), 2) AS exposure FROM exposures GROUP BY 1 UNION ALL SELECT portfolio_id, 'value', round(sum(notional * (position_id % 3) / 2.0::DOUBLE), 2) FROM exposures GROUP BY 1")
def p3(spark, d):
    loads = F.create_map(F.lit("size"), (F.col("position_id") % 5) / F.lit(4.0), F.lit("value"), (F.col("position_id") % 3) / F.lit(2.0))
    e = views.exposures(spark, d).select("portfolio_id", "notional", F.explode(loads).alias("factor", "load"))
    return e.groupBy("portfolio_id", "factor").agg(F.round(F.sum(F.col("notional") * F.col("load")), 2).alias("exposure"))


@query("p4_weighted_exposure", _EXP + " SELECT portfolio_id, round(sum(notional * (position_id % 7) / 6.0::DOUBLE), 2) AS beta_exposure, round(sum(notional * (position_id % 11)), 2) AS duration_exposure FROM exposures GROUP BY 1")
def p4(spark, d):
    n, p = F.col("notional"), F.col("position_id")
    return views.exposures(spark, d).groupBy("portfolio_id").agg(F.round(F.sum(n * (p % 7) / F.lit(6.0)), 2).alias("beta_exposure"), F.round(F.sum(n * (p % 11)), 2).alias("duration_exposure"))


_P9 = {"gross_exposure_limit": "gross > 5000000", "net_exposure_limit": "abs(net) > 100000", "group_exposure_limit": "top_group > 400000", "scenario_loss_limit": "loss < -20000"}


@query("p9_portfolio_decision", _EXP + f", t AS (SELECT portfolio_id, sum(abs(notional)) AS gross, sum(notional) AS net, sum(notional * CASE currency WHEN 'ASIA' THEN -0.2::DOUBLE ELSE -0.05::DOUBLE END) AS loss FROM exposures GROUP BY 1), g AS (SELECT portfolio_id, max(abs(s)) AS top_group FROM (SELECT portfolio_id, sector, sum(notional) AS s FROM exposures GROUP BY 1, 2) GROUP BY 1) SELECT portfolio_id, {why(_P9)} AS reasons, {why(_P9)} = '' AS approved FROM t JOIN g USING (portfolio_id)")
def p9(spark, d):
    shocked = F.col("notional") * F.when(F.col("currency") == "ASIA", -0.2).otherwise(-0.05)
    part = views.exposures(spark, d).groupBy("portfolio_id", "sector").agg(F.sum(F.abs("notional")).alias("a"), F.sum("notional").alias("s"), F.sum(shocked).alias("l"))
    t = part.groupBy("portfolio_id").agg(F.sum("a").alias("gross"), F.sum("s").alias("net"), F.sum("l").alias("loss"), F.max(F.abs("s")).alias("top_group"))
    return t.withColumn("reasons", reasons(_P9)).select("portfolio_id", "reasons", (F.col("reasons") == "").alias("approved"))


def _sleeves(spark, d):
    v = views.returns(spark, d).groupBy("instrument_id").agg(F.stddev_pop("r").alias("v"), F.count(F.lit(1)).alias("n"))
    return v.select("instrument_id", (F.col("n") % 3).alias("portfolio"), (F.pow(F.col("n") % 7 + 1, F.lit(2)) / F.col("v")).alias("score"))


@query("p14_capped_weights", with_views("returns") + """, v AS (SELECT instrument_id, stddev_pop(r) AS v, count(*) AS n FROM returns GROUP BY 1), s AS (SELECT instrument_id, n % 3 AS portfolio, pow(n % 7 + 1, 2) / v AS score FROM v),
    k AS (SELECT *, row_number() OVER w - 1 AS above, sum(score) OVER (PARTITION BY portfolio ORDER BY score DESC, instrument_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s WINDOW w AS (PARTITION BY portfolio ORDER BY score DESC, instrument_id)),
    c AS (SELECT *, coalesce(min(CASE WHEN (1 - above * 0.2::DOUBLE) * score / rest <= 0.2::DOUBLE THEN above END) OVER (PARTITION BY portfolio), count(*) OVER (PARTITION BY portfolio)) AS capped FROM k)
    SELECT portfolio, instrument_id, round(CASE WHEN above < capped THEN least(0.2::DOUBLE, greatest(0, 1 - above * 0.2::DOUBLE)) ELSE greatest(0, 1 - capped * 0.2::DOUBLE) * score / max(CASE WHEN above = capped THEN rest END) OVER (PARTITION BY portfolio) END, 6) AS weight FROM c""")
def p14(spark, d):
    return controls.capped_weights(_sleeves(spark, d), "portfolio", "instrument_id", "score", 0.2).select("portfolio", "instrument_id", r6(F.col("weight"), "weight"))


_P15 = {"regime_reduction": "regime < 1", "capacity_reduction": "capacity < 1", "liquidity_disabled": "liquidity < 0.3", "drawdown_disabled": "drawdown > 0.8", "signal_decay_disabled": "decay < 0.2"}
_P15_COLS = {"regime": "least(1.0E0, (o_orderkey % 8 + 1) / 4.0E0)", "capacity": "(o_custkey % 10 + 1) / 10.0E0", "liquidity": "(o_orderkey % 13) / 12.0E0", "drawdown": "(o_custkey % 17) / 16.0E0", "decay": "(o_orderkey % 19) / 18.0E0"}
_P15_W = "CASE WHEN liquidity < 0.3 OR drawdown > 0.8 OR decay < 0.2 THEN 0 ELSE regime * capacity END"


@query("p15_sleeve_adjustments", f"WITH s AS (SELECT o_orderkey, {', '.join(f'{e} AS {k}' for k, e in _P15_COLS.items())} FROM orders) SELECT o_orderkey, round({_P15_W}, 6) AS multiplier, {why(_P15)} AS reasons FROM s")
def p15(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", *(F.expr(e).alias(k) for k, e in _P15_COLS.items()))
    return s.select("o_orderkey", r6(F.expr(_P15_W).cast("double"), "multiplier"), reasons(_P15).alias("reasons"))


@query("p18_effective_weights", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14, 2)) * CASE WHEN o_orderkey % 4 = 0 THEN 0.0000005 ELSE 0.0000010 END + CAST((o_custkey % 3) * 0.01 + (o_custkey % 5) * 0.002 AS DECIMAL(8, 3)) AS DOUBLE) AS effective FROM orders")
def p18(spark, d):
    # decimals, so that no rounding edge depends on the engine
    scaled = F.col("o_totalprice").cast("decimal(14,2)") * F.when(F.col("o_orderkey") % 4 == 0, F.expr("0.0000005")).otherwise(F.expr("0.0000010"))
    shared = ((F.col("o_custkey") % 3).cast("decimal(2,0)") * F.expr("0.010") + (F.col("o_custkey") % 5).cast("decimal(2,0)") * F.expr("0.002")).cast("decimal(8,3)")
    return table(spark, d, "orders").select("o_orderkey", (scaled + shared).cast("double").alias("effective"))


_TRADE = {"buy": "l_orderkey % 2 = 0", "entry": "100 + l_extendedprice % 20", "stop": "CASE WHEN l_partkey % 23 > 0 THEN 100 + (l_partkey % 21) END"}
_P22 = {"protective_stop_required": "stop IS NULL", "protective_stop_wrong_side": "(buy AND stop >= entry) OR (NOT buy AND stop <= entry)", "stop_distance_limit": "abs(entry - stop) / entry > 0.1", "per_trade_loss_limit": "abs(entry - stop) * l_quantity > 300",
        "per_trade_gap_loss_limit": "abs(entry - stop * CASE WHEN buy THEN 0.98 ELSE 1.02 END) * l_quantity > 300"}
_P22_SQL = f"WITH t AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _TRADE.items())} FROM lineitem)"


@query("p22_per_trade_risk", f"{_P22_SQL}, w AS (SELECT l_linenumber, abs(entry - stop) * l_quantity AS loss, {why(_P22)} AS reasons FROM t) SELECT l_linenumber, reasons, count(*) AS trades, round(sum(loss), 2) AS loss_at_stop FROM w GROUP BY 1, 2")
def p22(spark, d):
    t = table(spark, d, "lineitem").select("*", *(F.expr(e).alias(k) for k, e in _TRADE.items()))
    return t.groupBy("l_linenumber", reasons(_P22).alias("reasons")).agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum(F.abs(F.col("entry") - F.col("stop")) * F.col("l_quantity")), 2).alias("loss_at_stop"))


_P26 = {"invalid_trading_session": "l_linestatus = 'O' AND l_returnflag = 'R'", "lot_size_violation": "CAST(l_quantity AS BIGINT) % 5 <> 0", "tick_size_violation": "CAST(l_quantity AS BIGINT) % 5 = 0 AND CAST(l_extendedprice AS DECIMAL(18, 2)) % 0.05 <> 0", "venue_order_notional_limit": "l_extendedprice > 50000"}


@query("p26_venue_constraints", f"SELECT {why(_P26)} AS reasons, count(*) AS orders FROM lineitem GROUP BY 1")
def p26(spark, d):
    return table(spark, d, "lineitem").groupBy(reasons(_P26).alias("reasons")).agg(F.count(F.lit(1)).alias("orders"))


@query("p16_target_volatility", with_views("returns") + ", v AS (SELECT instrument_id, year(day)::INT AS y, stddev_pop(r) * sqrt(252) AS v FROM returns GROUP BY 1, 2) SELECT instrument_id, y, round(v, 6) AS volatility, round(CASE WHEN v > 0 THEN least(1, 0.5::DOUBLE / v) ELSE 1 END, 6) AS scale FROM v")
def p16(spark, d):
    v = views.returns(spark, d).groupBy("instrument_id", F.year("day").alias("y")).agg((F.stddev_pop("r") * F.sqrt(F.lit(252))).alias("v"))
    return v.select("instrument_id", "y", r6(F.col("v"), "volatility"), r6(F.when(F.col("v") > 0, F.least(F.lit(1.0), 0.5 / F.col("v"))).otherwise(1.0), "scale"))
