"""Queries on scorecards, latency and stress, whose SQL spells the measures out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scorecard, signals
from tidemark.plans.market import RUN_SQL, SIGNALS_SQL, S, _run, r6
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import SQL

_K = ["strategy", "instrument_id"]


def _streak(condition: str, name: str) -> str:
    return f"""{name} AS (SELECT strategy, instrument_id, max(n) AS {name}_n FROM (SELECT strategy, instrument_id, g, count(*) AS n FROM (SELECT strategy, instrument_id, {condition} AS c, row_number() OVER {S}) - row_number() OVER (PARTITION BY strategy, instrument_id, {condition} ORDER BY day) AS g FROM cv) WHERE c GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


_METRICS = RUN_SQL + f""", cv AS (SELECT *, CASE WHEN drawdown > 1e-12 THEN -drawdown ELSE 0 END AS down FROM curve),
rk AS (SELECT *, row_number() OVER (PARTITION BY strategy, instrument_id ORDER BY net, day) AS worst, row_number() OVER (PARTITION BY strategy, instrument_id ORDER BY net DESC, day DESC) AS best, greatest(1, floor(count(*) OVER (PARTITION BY strategy, instrument_id) * 0.05::DOUBLE)) AS k FROM cv),
mt AS (SELECT strategy, instrument_id, count(*) AS periods, sum(ln(1 + net)) AS log_return, avg(net) AS average, stddev_pop(net) AS sd, max(net) AS largest_win, min(net) AS largest_loss, sqrt(avg(pow(least(net, 0), 2))) AS downside_deviation, min(down) AS max_drawdown, sum(down) / (count(*) + 1) AS average_drawdown, sqrt(sum(down * down) / (count(*) + 1)) AS ulcer_index,
    count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, avg(net) FILTER (net > 0) AS win, avg(net) FILTER (net < 0) AS loss, coalesce(sum(net) FILTER (net > 0), 0) AS gained, sum(net) FILTER (net < 0) AS lost, median(net) AS median, sum(turnover) AS turnover, avg(position) AS exposure,
    max(net) FILTER (worst = k) AS value_at_risk, avg(net) FILTER (worst <= k) AS conditional_var, avg(net) FILTER (best <= k) AS upper FROM rk GROUP BY 1, 2),
{_streak('down < 0', 'sunk')}, {_streak('net > 0', 'won')}, {_streak('net < 0', 'fell')},
ms AS (SELECT mt.*, coalesce(sunk_n, 0) AS max_drawdown_duration, coalesce(won_n, 0) AS longest_wins, coalesce(fell_n, 0) AS longest_losses, CASE WHEN periods >= 252 THEN exp(log_return * 252 / periods) - 1 END AS cagr, sd * sqrt(252) AS annualized_volatility, CASE WHEN largest_win <> largest_loss THEN average / sd * sqrt(252) END AS sharpe,
    CASE WHEN downside_deviation > 0 THEN average / downside_deviation * sqrt(252) END AS sortino, CASE WHEN periods >= 252 AND max_drawdown < 0 THEN (exp(log_return * 252 / periods) - 1) / -max_drawdown END AS calmar, wins / periods AS hit_rate, CASE WHEN losses > 0 THEN wins / losses END AS win_loss_ratio, win / -loss AS payoff_ratio,
    CASE WHEN losses > 0 THEN gained / -lost END AS profit_factor, CASE WHEN conditional_var <> 0 THEN upper / abs(conditional_var) END AS tail_ratio FROM mt LEFT JOIN sunk USING (strategy, instrument_id) LEFT JOIN won USING (strategy, instrument_id) LEFT JOIN fell USING (strategy, instrument_id))"""

_B7 = ("log_return", "cagr", "annualized_volatility", "sharpe", "sortino", "calmar", "max_drawdown", "downside_deviation", "hit_rate", "win_loss_ratio", "payoff_ratio", "profit_factor", "average", "median")
_B8 = ("average_drawdown", "ulcer_index", "value_at_risk", "conditional_var", "tail_ratio", "largest_win", "largest_loss")


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("b7_scorecard_metrics", _METRICS + f" SELECT strategy, instrument_id, periods, max_drawdown_duration, {_rounded(_B7)} FROM ms")
def b7(spark, d):
    m = scorecard.held_out_metrics(_run(spark, d))
    return m.select(*_K, "periods", "max_drawdown_duration", *(r6(F.col(c), c) for c in _B7))


@query("b8_held_out_metrics", _METRICS + f" SELECT strategy, instrument_id, max_drawdown_duration, longest_wins, longest_losses, turnover::BIGINT AS turnover, {_rounded(_B8)} FROM ms")
def b8(spark, d):
    m = scorecard.held_out_metrics(_run(spark, d))
    return m.select(*_K, "max_drawdown_duration", "longest_wins", "longest_losses", "turnover", *(r6(F.col(c), c) for c in _B8))


@query("b10_activity_metrics", RUN_SQL + f""", h AS (SELECT strategy, instrument_id, day, row_number() OVER {S}) - row_number() OVER (PARTITION BY strategy, instrument_id, position ORDER BY day) AS g, position FROM run), i AS (SELECT strategy, instrument_id, g, count(*) AS n FROM h WHERE position = 1 GROUP BY 1, 2, 3),
p0 AS (SELECT strategy, instrument_id, avg(n) AS held FROM i GROUP BY 1, 2), t0 AS (SELECT strategy, instrument_id, sum(turnover)::BIGINT AS turnover, avg(position) AS exposure FROM run GROUP BY 1, 2)
SELECT strategy, instrument_id, turnover, round(exposure, 6) AS exposure, round(held, 6) AS average_holding_period, CASE WHEN held IS NULL THEN 'UNAVAILABLE' ELSE 'MEASURED' END AS average_holding_period_state FROM t0 LEFT JOIN p0 USING (strategy, instrument_id)""")
def b10(spark, d):
    m = scorecard.activity_metrics(_run(spark, d))
    return m.select(*_K, "turnover", r6(F.col("exposure"), "exposure"), r6(F.col("average_holding_period"), "average_holding_period"), "average_holding_period_state")


_PARAMETERS = {"moving_average_cross": 2, "breakout": 1, "mean_reversion": 2, "momentum": 1}
# the standard normal distribution by the same polynomial, for |x| and mirrored
_PHI = "exp(-x * x / 2) / 2.5066282746310002 * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))"


@query("b12_scorecard", _METRICS + f""", {SQL['provider_bars']}, dq AS (SELECT instrument_id, avg(n) / 3 AS quality FROM (SELECT instrument_id, day, count(DISTINCT provider) AS n FROM provider_bars GROUP BY 1, 2) GROUP BY 1),
pc AS (SELECT strategy, instrument_id, sum(ln(1 + position * move - turnover * 0.003::DOUBLE)) AS low FROM run GROUP BY 1, 2),
x AS (SELECT ms.*, low, quality, sharpe / sqrt(252) * sqrt(periods - 1) AS x FROM ms JOIN pc USING (strategy, instrument_id) JOIN dq USING (instrument_id)), tx AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(x)) AS t FROM x),
c AS (SELECT strategy, instrument_id, greatest(0, least(100, (exp(least(700, log_return)) - 1) * 500)) AS out_of_sample_return, CASE WHEN sharpe IS NOT NULL THEN greatest(0, least(100, sharpe * 25 + 50)) END AS out_of_sample_sharpe, greatest(0, 100 + max_drawdown * 500) AS drawdown, CASE WHEN periods > 1 THEN 100 * CASE WHEN x >= 0 THEN 1 - {_PHI} ELSE {_PHI} END END AS statistical_confidence,
    greatest(0, least(100, (exp(least(700, low)) - 1) * 500)) AS cost_robustness, greatest(0, least(100, quality * 100)) AS data_quality, CASE WHEN strategy IN ('breakout', 'momentum') THEN 95.0 ELSE 90.0 END::DOUBLE AS complexity_penalty, least(100, periods / 2) AS sample_size_penalty, greatest(0, 100 - turnover * 10) AS turnover_penalty FROM tx)
SELECT strategy, instrument_id, {_rounded(scorecard.COMPONENTS)}, round((out_of_sample_return + coalesce(out_of_sample_sharpe, 0) + drawdown + coalesce(statistical_confidence, 0) + cost_robustness + data_quality + complexity_penalty + sample_size_penalty + turnover_penalty) / (7 + (out_of_sample_sharpe IS NOT NULL)::INT + (statistical_confidence IS NOT NULL)::INT), 6) AS score FROM c""")
def b12(spark, d):
    """Data quality is the share of providers that print on an instrument's days; pessimistic costs are three times the usual ones."""
    run = _run(spark, d)
    low = run.withColumn("net", F.col("net") - F.col("turnover") * 0.002).groupBy(*_K).agg(F.sum(F.log1p("net")).alias("pessimistic_log_return"))
    days = views.provider_bars(spark, d).groupBy("instrument_id", "day").agg(F.count_distinct("provider").alias("n")).groupBy("instrument_id").agg((F.avg("n") / 3).alias("data_quality_score"))
    named = F.create_map(*(x for n, k in _PARAMETERS.items() for x in (F.lit(n), F.lit(k))))
    m = scorecard.held_out_metrics(run).join(low, _K).join(days, "instrument_id").withColumn("parameters", named[F.col("strategy")])
    return scorecard.component_scores(m).select(*_K, *(r6(F.col(c), c) for c in (*scorecard.COMPONENTS, "score")))


def _rerun(case: str, key: str, values: str, signal: str, close: str, rate: str) -> str:
    """Backtests of ``SIGNALS_SQL`` once for each value, with other signals, closes or costs."""
    w = f"(PARTITION BY strategy, instrument_id, {key} ORDER BY day"
    return f""", {case}0 AS (SELECT strategy, instrument_id, day, {key}, {rate} AS rate, {close} AS close, {signal} AS signal, prompt FROM (SELECT *, signal AS prompt, day = max(day) OVER (PARTITION BY strategy, instrument_id) AS is_last FROM sig) CROSS JOIN (VALUES {values}) AS v({key}, a, b)),
{case}1 AS (SELECT *, lag(signal) OVER {w}) AS position, close / lag(close) OVER {w}) - 1 AS move FROM {case}0), {case}2 AS (SELECT *, abs(position - coalesce(lag(position) OVER {w}), 0)) AS turnover FROM {case}1), {case}3 AS (SELECT *, position * move - turnover * rate AS net FROM {case}2 WHERE move IS NOT NULL),
{case}4 AS (SELECT *, product(1 + net) OVER {w} ROWS UNBOUNDED PRECEDING) AS equity FROM {case}3), {case}5 AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER {w} ROWS UNBOUNDED PRECEDING)) AS dd FROM {case}4),
{case} AS (SELECT strategy, instrument_id, {key}, sum(ln(1 + net)) AS lr, CASE WHEN max(net) > min(net) THEN avg(net) / stddev_pop(net) * sqrt(252) END AS sharpe, max(dd) AS dd FROM {case}5 GROUP BY 1, 2, 3)"""


_LEVELS = ((0.0, 0), (1.0, 1), (24.0, 1), (36.0, 2), (120.0, 5))


@query("v8_latency_sensitivity", SIGNALS_SQL + _rerun("late", "latency", ", ".join(f"({h}::DOUBLE, {b}, 0)" for h, b in _LEVELS), "coalesce(lag(signal, a) OVER (PARTITION BY strategy, instrument_id, latency ORDER BY day), 0)", "close", "0.001::DOUBLE") + """,
n AS (SELECT strategy, instrument_id, latency, count(*) FILTER (signal <> prompt) AS changed FROM late0 GROUP BY 1, 2, 3)
SELECT l.strategy, l.instrument_id, l.latency, CASE l.latency WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 24 THEN 1 WHEN 36 THEN 2 ELSE 5 END AS bars, changed, round(b.lr - l.lr, 6) AS log_degradation, round(b.sharpe - l.sharpe, 6) AS sharpe_decay, round(l.dd - b.dd, 6) AS drawdown_change, exp(least(700, b.lr)) - exp(least(700, l.lr)) <= 0.05 AS passed
FROM late l JOIN late b ON b.strategy = l.strategy AND b.instrument_id = l.instrument_id AND b.latency = 0 JOIN n ON n.strategy = l.strategy AND n.instrument_id = l.instrument_id AND n.latency = l.latency""")
def v8(spark, d):
    out = scorecard.latency_sensitivity(signals.baseline_signals(views.bars(spark, d)), [h for h, _ in _LEVELS], 24.0, 0.05)
    return out.select(*_K, "latency", "bars", "changed", *(r6(F.col(c), c) for c in ("log_degradation", "sharpe_decay", "drawdown_change")), "passed")


_SCENARIOS = (("calm", 0.0, 1.0), ("fall", -0.3, 2.0), ("slide", -0.1, 3.0), ("spike", 0.1, 5.0))


@query("v12_stress", SIGNALS_SQL + _rerun("st", "scenario", ", ".join(f"('{n}', {s}::DOUBLE, {m}::DOUBLE)" for n, s, m in _SCENARIOS), "signal", "CASE WHEN is_last THEN close * (1 + a) ELSE close END", "0.001::DOUBLE * b") + " SELECT strategy, instrument_id, scenario, round(lr, 6) AS log_return, round(dd, 6) AS drawdown, exp(least(700, lr)) - 1 >= -0.2 AS passed FROM st")
def v12(spark, d):
    out = scorecard.stress_runs(signals.baseline_signals(views.bars(spark, d)), list(_SCENARIOS), -0.2)
    return out.select(*_K, "scenario", r6(F.col("log_return"), "log_return"), r6(F.col("drawdown"), "drawdown"), "passed")
