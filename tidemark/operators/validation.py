"""Statistical validation: splits, quantiles, multiple testing, resampling, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def walk_forward_splits(lengths: DataFrame, key: str, train: int, test: int, step: int, purge: int = 0) -> DataFrame:
    """``key, split, train_start, train_end, test_start, test_end`` for series of n periods; ends exclusive."""
    last = F.floor((F.col("n") - train - purge - test) / step).cast("int")
    each = lengths.where(F.col("n") >= train + purge + test).withColumn("split", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("split") * step
    return each.select(key, "split", start.alias("train_start"), (start + train).alias("train_end"), (start + train + purge).alias("test_start"), (start + train + purge + test).alias("test_end"))


def in_splits(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows (with ``place`` from 0) of each split's test range; the split index is exploded on the small side."""
    each = splits.withColumn("place", F.explode(F.sequence("test_start", F.col("test_end") - 1))).select(key, "split", "place")
    return rows.join(each, [key, "place"])


def lower_quantiles(rows: DataFrame, key: str, value: str, named: dict[str, float]) -> DataFrame:
    """sorted[int(p (n - 1))] of a key's values, for each named p; rows are ranked, no group becomes an array."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, value, F.row_number().over(w.orderBy(value)).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("place") == F.floor(F.lit(p) * (F.col("n") - 1)) + 1, F.col(value)))
    return ranked.groupBy(key).agg(*(at(p).alias(name) for name, p in named.items()))


def benjamini_hochberg(tests: DataFrame, family: str, name: str, p: str, alpha: float) -> DataFrame:
    """Each test with its rank, the family's threshold and whether it is a discovery."""
    w = Window.partitionBy(family)
    ranked = tests.withColumn("rank", F.row_number().over(w.orderBy(p, name))).withColumn("m", F.count(F.lit(1)).over(w))
    cut = F.max(F.when(F.col(p) <= alpha * F.col("rank") / F.col("m"), F.col(p))).over(w)
    return ranked.withColumn("threshold", cut).withColumn("discovery", F.coalesce(F.col(p) <= F.col("threshold"), F.lit(False))).drop("m")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by an absolute-error 7.5e-8 polynomial, in built-in functions."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def probabilistic_sharpe(sharpe: Column, benchmark: float, n: Column) -> Column:
    return normal_cdf((sharpe - benchmark) * F.sqrt(n - 1))


def simple_regimes(bars: DataFrame, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Regime probabilities from the return over n - 1 steps; confidence at most 0.40. Columns in ``keep`` stay."""
    w = Window.partitionBy("instrument_id").orderBy("day")
    move = bars.withColumn("lookback_return", F.col("close") / F.lag("close", n - 1).over(w) - 1)
    strength = F.least(F.lit(0.4), F.abs("lookback_return") * 10)
    up = F.when(F.col("lookback_return") > 0, 0.3 + strength).otherwise(0.3)
    down = F.when(F.col("lookback_return") < 0, 0.3 + strength).otherwise(0.3)
    return move.where("lookback_return IS NOT NULL").select("instrument_id", "day", *keep, "lookback_return", up.alias("p_up"), down.alias("p_down"), (1 - up - down).alias("p_range"))
