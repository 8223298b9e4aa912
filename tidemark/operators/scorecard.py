"""Scorecards of backtests: held-out metrics, component scores, latency and stress reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.backtest import KEYS, PERIODS, equity_curve, longest_streak, vector_backtest
from tidemark.operators.validation import normal_cdf

#: Drawdowns up to this are rounding.
FLAT = 1e-12


def _ratio(a, b):
    return F.when(b != 0, a / b)


def held_out_metrics(run: DataFrame, confidence: float = 0.05, keys=KEYS) -> DataFrame:
    """One row a series (``net``, ``turnover``): returns, risk, tails, trades, drawdowns and streaks.

    A measure without a meaning is null: annual figures under ``PERIODS`` periods, ratios without
    losses, gains or variation. Drawdowns are at most 0; their mean and the ulcer index count the
    start of the curve too. The tails are the ``max(1, int(n * confidence))`` worst and best periods.
    ``log_return`` is the logarithm of final equity, as equity may span many orders of magnitude.
    """
    keys = list(keys)
    net, n = F.col("net"), F.count(F.lit(1))
    curve = equity_curve(run, keys).withColumn("down", F.when(F.col("drawdown") > FLAT, -F.col("drawdown")).otherwise(0.0))
    whole = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), (F.count(F.lit(1)).over(whole) * confidence).cast("int"))
    curve = curve.withColumns({"worst": F.row_number().over(whole.orderBy("net", "day")), "best": F.row_number().over(whole.orderBy(F.desc("net"), F.desc("day"))), "k": k})
    gain, loss = F.when(net > 0, net), F.when(net < 0, net)
    by = curve.groupBy(*keys).agg(
        n.alias("periods"), F.sum(F.log1p("net")).alias("log_return"), F.avg("net").alias("average"), F.stddev_pop("net").alias("_sd"), F.max("net").alias("largest_win"), F.min("net").alias("largest_loss"),
        F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), F.lit(2)))).alias("downside_deviation"), F.min("down").alias("max_drawdown"), (F.sum("down") / (n + 1)).alias("average_drawdown"), F.sqrt(F.sum(F.pow("down", F.lit(2))) / (n + 1)).alias("ulcer_index"),
        F.count_if(net > 0).alias("_wins"), F.count_if(net < 0).alias("_losses"), F.sum(gain).alias("_gain"), F.sum(loss).alias("_loss"), F.percentile("net", 0.5).alias("median"), F.sum("turnover").alias("turnover"), F.avg("position").alias("exposure"),
        F.max(F.when(F.col("worst") == F.col("k"), net)).alias("value_at_risk"), F.avg(F.when(F.col("worst") <= F.col("k"), net)).alias("conditional_var"), F.avg(F.when(F.col("best") <= F.col("k"), net)).alias("_upper"),
    )
    for name, condition in (("max_drawdown_duration", F.col("down") < 0), ("longest_wins", net > 0), ("longest_losses", net < 0)):
        by = by.join(longest_streak(curve, condition, name, keys), keys, "left").fillna(0, [name])
    year = F.sqrt(F.lit(PERIODS))
    annual = F.when(F.col("periods") >= PERIODS, F.exp(F.col("log_return") * PERIODS / F.col("periods")) - 1)
    flat = F.col("largest_win") == F.col("largest_loss")
    return by.withColumns({
        "cagr": annual, "annualized_volatility": F.col("_sd") * year, "sharpe": F.when(~flat, F.col("average") / F.col("_sd") * year), "sortino": _ratio(F.col("average"), F.col("downside_deviation")) * year,
        "calmar": _ratio(annual, F.abs("max_drawdown")), "hit_rate": F.col("_wins") / F.col("periods"), "win_loss_ratio": _ratio(F.col("_wins"), F.col("_losses")),
        "payoff_ratio": F.when(F.col("_wins") > 0, _ratio(F.col("_gain") / F.col("_wins"), F.abs(F.col("_loss") / F.col("_losses")))), "profit_factor": F.when(F.col("_losses") > 0, F.coalesce("_gain", F.lit(0.0)) / F.abs("_loss")),
        "tail_ratio": _ratio(F.col("_upper"), F.abs("conditional_var")),
    }).drop("_sd", "_wins", "_losses", "_gain", "_loss", "_upper")


def activity_metrics(run: DataFrame, keys=KEYS) -> DataFrame:
    """``keys, turnover, exposure, average_holding_period`` and the ``state`` of each: what has no measure is UNAVAILABLE, never 0.

    A holding period is a stretch of periods with a position; a series that never holds has none.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    held = F.col("position") != 0
    entry = held & ~F.coalesce(F.lag("position").over(w) != 0, F.lit(False))
    by = run.withColumns({"_held": held.cast("int"), "_entry": entry.cast("int")}).groupBy(*keys).agg(
        F.sum("turnover").alias("turnover"), F.avg(F.abs("position")).alias("exposure"), (F.sum("_held") / F.nullif(F.sum("_entry"), F.lit(0))).alias("average_holding_period")
    )
    measured = lambda c: F.when(F.col(c).isNull(), "UNAVAILABLE").otherwise("MEASURED").alias(f"{c}_state")
    return by.select(*keys, "turnover", "exposure", "average_holding_period", *map(measured, ("turnover", "exposure", "average_holding_period")))


#: Components of a score, each from 0 to 100, in order.
COMPONENTS = ("out_of_sample_return", "out_of_sample_sharpe", "drawdown", "statistical_confidence", "cost_robustness", "data_quality", "complexity_penalty", "sample_size_penalty", "turnover_penalty")


def component_scores(metrics: DataFrame) -> DataFrame:
    """``metrics`` with the nine components and ``score``, the mean of those there are; evidence that is absent is null, never favourable.

    ``metrics`` also has pessimistic_log_return, data_quality_score (0 to 1) and parameters.
    """
    # least and greatest pass nulls over, so absent evidence is kept apart
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))
    total = lambda c: F.when(F.col(c).isNotNull(), F.exp(F.least(F.col(c), F.lit(700.0))) - 1)
    confidence = normal_cdf(F.col("sharpe") / F.sqrt(F.lit(PERIODS)) * F.sqrt(F.col("periods") - 1)) * 100
    values = (
        clamp(total("log_return") * 500), clamp(F.col("sharpe") * 25 + 50), F.greatest(F.lit(0.0), 100 + F.col("max_drawdown") * 500), F.when(F.col("periods") > 1, confidence), clamp(total("pessimistic_log_return") * 500),
        clamp(F.col("data_quality_score") * 100), F.greatest(F.lit(0.0), F.lit(100.0) - F.col("parameters") * 5), F.least(F.lit(100.0), F.col("periods") / 2), F.greatest(F.lit(0.0), 100 - F.col("turnover") * 10),
    )
    scored = metrics.withColumns(dict(zip(COMPONENTS, values, strict=True)))
    held = F.array_compact(F.array(*COMPONENTS))
    return scored.withColumn("score", F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def _totals(run: DataFrame, keys: list[str]) -> DataFrame:
    curve = equity_curve(run, keys)
    flat = F.max("net") == F.min("net")
    return curve.groupBy(*keys).agg(F.sum(F.log1p("net")).alias("log_return"), F.when(~flat, F.avg("net") / F.stddev_pop("net") * F.sqrt(F.lit(PERIODS))).alias("sharpe"), F.max("drawdown").alias("drawdown"))


def latency_sensitivity(signals: DataFrame, hours: list[float], frequency_hours: float, most_degradation: float, rate: float = 0.0005, spread: float = 0.0005) -> DataFrame:
    """Backtests with signals late by ``ceil(latency / frequency)`` whole bars, against the backtest without delay.

    One row a series and latency: bars, signals that differ, degradation of the logarithm of final
    equity, of the Sharpe ratio and of the drawdown, and whether the total return falls by at most
    ``most_degradation``. Before a late signal arrives there is none. No level is finer than a bar.
    """
    levels = sorted({(h, -int(-h // frequency_hours)) for h in hours})
    w = Window.partitionBy(*KEYS).orderBy("day")
    shifted = signals.withColumns({f"_late{k}": F.coalesce(F.lag("signal", b).over(w), F.lit(0)) for k, (_, b) in enumerate(levels)})
    late = shifted.select(*KEYS, "day", "close", "signal", F.explode(F.array(*(F.struct(F.lit(float(h)).alias("latency"), F.col(f"_late{k}").alias("late"), F.lit(b).alias("bars")) for k, (h, b) in enumerate(levels)))).alias("x"))
    late = late.select(*KEYS, "day", "close", F.col("signal").alias("prompt"), "x.*")
    changed = late.groupBy(*KEYS, "latency", "bars").agg(F.count_if(F.col("prompt") != F.col("late")).alias("changed"))
    keys = [*KEYS, "latency"]
    after = _totals(vector_backtest(late.select(*keys, "day", "close", F.col("late").alias("signal")), 0.0, rate, spread, keys=tuple(keys)), keys)
    base = _totals(vector_backtest(signals, 0.0, rate, spread), list(KEYS)).select(*KEYS, *(F.col(c).alias(f"_{c}") for c in ("log_return", "sharpe", "drawdown")))
    out = changed.join(after, keys).join(base, list(KEYS))
    total = lambda c: F.exp(F.least(F.col(c), F.lit(700.0)))
    return out.select(
        *keys, "bars", "changed", (F.col("_log_return") - F.col("log_return")).alias("log_degradation"), (F.col("_sharpe") - F.col("sharpe")).alias("sharpe_decay"), (F.col("drawdown") - F.col("_drawdown")).alias("drawdown_change"),
        (total("_log_return") - total("log_return") <= most_degradation).alias("passed"),
    )


def stress_runs(signals: DataFrame, scenarios: list[tuple[str, float, float]], least_return: float, rate: float = 0.0005, spread: float = 0.0005) -> DataFrame:
    """Backtests with the last close shocked and costs multiplied: one row a series and scenario (name, shock, multiplier of at least 1)."""
    if any(m < 1 for _, _, m in scenarios):
        raise ValueError("costs under stress are at least the usual ones")
    last = F.col("day") == F.max("day").over(Window.partitionBy(*KEYS))
    each = signals.withColumn("x", F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("shock"), F.lit(float(m)).alias("multiplier")) for n, s, m in scenarios))))
    each = each.withColumn("close", F.when(last, F.col("close") * (1 + F.col("x.shock"))).otherwise(F.col("close"))).select(*KEYS, "day", "close", "signal", "x.scenario", "x.multiplier")
    keys = [*KEYS, "scenario"]
    run = vector_backtest(each, 0.0, 0.0, 0.0, keys=tuple(keys)).withColumn("net", F.col("net") - F.col("turnover") * (rate + spread) * F.col("multiplier"))
    out = _totals(run, keys)
    return out.select(*keys, "log_return", "drawdown", (F.exp(F.least(F.col("log_return"), F.lit(700.0))) - 1 >= least_return).alias("passed"))
