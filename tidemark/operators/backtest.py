"""Vectorised backtests and performance reports for every (strategy, instrument)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("strategy", "instrument_id")
PERIODS = 252


def series(keys=KEYS) -> Window:
    return Window.partitionBy(*keys).orderBy("day")


def cost(turnover: Column, fixed: float, rate: float, spread: float) -> Column:
    return F.when(turnover != 0, fixed).otherwise(0.0) + turnover * (rate + spread)


def vector_backtest(signals: DataFrame, fixed: float = 0.0, rate: float = 0.0005, spread: float = 0.0005, keys=KEYS) -> DataFrame:
    """Adds ``position, turnover, net``: a signal is held in the next period, from a start at 0."""
    w = series(keys)
    held = signals.withColumn("position", F.lag("signal").over(w)).withColumn("move", F.col("close") / F.lag("close").over(w) - 1)
    held = held.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    return held.where("move IS NOT NULL").withColumn("net", F.col("position") * F.col("move") - cost(F.col("turnover"), fixed, rate, spread))


def equity_curve(run: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``equity, peak, drawdown``; the peak counts the start at 1. The log form suits long series."""
    w = series(keys).rowsBetween(Window.unboundedPreceding, 0)
    grown = run.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))
    grown = grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return grown.withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def sharpe(net: str = "net") -> Column:
    flat = F.max(net) == F.min(net)
    return F.when(~flat, F.avg(net) / F.stddev_pop(net) * F.sqrt(F.lit(PERIODS)))


def performance_report(curve: DataFrame, keys=KEYS) -> DataFrame:
    """One row a series: periods, log growth and returns, volatility, Sharpe, drawdown, hit rate, profit factor, turnover.

    ``log_growth`` keeps its digits where a series has lost nearly all and ``total_return`` is next to -1.
    """
    gain, loss = F.sum(F.greatest("net", F.lit(0.0))), -F.sum(F.least("net", F.lit(0.0)))
    logs = F.sum(F.log1p("net"))
    growth = F.exp(logs)
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), logs.alias("log_growth"), (growth - 1).alias("total_return"), (F.pow(growth, PERIODS / F.count(F.lit(1))) - 1).alias("annualised_return"),
        (F.stddev_pop("net") * F.sqrt(F.lit(PERIODS))).alias("volatility"), sharpe().alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.when(loss > 0, gain / loss).alias("profit_factor"), F.sum("turnover").alias("turnover"),
    )


def longest_streak(run: DataFrame, condition: Column, name: str, keys=KEYS) -> DataFrame:
    """The longest run of consecutive periods that meet a condition (gaps and islands)."""
    w = series(keys)
    marked = run.withColumn("__c", condition).withColumn("__all", F.row_number().over(w))
    own = Window.partitionBy(*keys, "__c").orderBy("day")
    island = marked.withColumn("__i", F.col("__all") - F.row_number().over(own)).where("__c")
    return island.groupBy(*keys, "__i").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias(name))


def tail_risk(run: DataFrame, confidence: float, keys=KEYS) -> DataFrame:
    """VaR and CVaR from the k worst periods, k = int(n * confidence); k under 1 is UNAVAILABLE."""
    ranked = run.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("net", "day"))).withColumn("__k", (F.count(F.lit(1)).over(Window.partitionBy(*keys)) * confidence).cast("int"))
    worst = ranked.groupBy(*keys).agg(F.max("__k").alias("k"), F.max(F.when(F.col("__rn") == F.col("__k"), F.col("net"))).alias("value_at_risk"), F.avg(F.when(F.col("__rn") <= F.col("__k"), F.col("net"))).alias("conditional_var"))
    return worst.withColumn("state", F.when(F.col("k") < 1, "UNAVAILABLE").otherwise("MEASURED"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str], tolerance: float) -> DataFrame:
    """Names of the measures that differ by more than the tolerance (relative above 1), by key of either side."""
    other = b.select(*keys, *(F.col(m).alias(f"__{m}") for m in measures))
    joined = a.join(other, keys, "full_outer")
    differ = F.array_compact(F.array(*(F.when(F.coalesce(F.abs(F.col(m) - F.col(f"__{m}")) > tolerance * F.greatest(F.lit(1.0), F.abs(m)), F.lit(True)), F.lit(m)) for m in measures)))
    return joined.select(*keys, F.array_join(differ, ",").alias("differences"), (F.size(differ) == 0).alias("reconciled"))


def independent_equity(signals: DataFrame, fixed: float = 0.0, rate: float = 0.0005, spread: float = 0.0005, keys=KEYS) -> DataFrame:
    """Final equity and turnover by another plan: an ordered array for each series, folded."""
    w = series(keys)
    steps = signals.withColumn("before", F.lag("close").over(w)).withColumn("s1", F.lag("signal").over(w)).withColumn("s2", F.coalesce(F.lag("signal", 2).over(w), F.lit(0))).where("before IS NOT NULL")
    turn = F.abs(F.col("s1") - F.col("s2"))
    factor = 1 + F.col("s1") * (F.col("close") - F.col("before")) / F.col("before") - cost(turn, fixed, rate, spread)
    return steps.groupBy(*keys).agg(F.product(factor).alias("equity"), F.sum(turn).cast("double").alias("turnover"))
