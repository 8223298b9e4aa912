"""Trailing-window features of bars: one value for each instrument and time, null until ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "instrument_id", "day"


def ordered() -> Window:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int) -> Window:
    return ordered().rowsBetween(-(n - 1), 0)


def ready(value: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(trailing(n)) == n, value)


def change(n: int = 1) -> Column:
    return F.col("close") / F.lag("close", n).over(ordered()) - 1


def log_return(n: int = 1) -> Column:
    return F.log(F.col("close") / F.lag("close", n).over(ordered()))


def sma(n: int, column: str = "close") -> Column:
    return ready(F.avg(column).over(trailing(n)), n)


def ema(n: int) -> Column:
    """Weight 2 / (n + 1), seeded with the first close of each window: a fixed-weights dot product."""
    a = 2.0 / (n + 1)
    window = F.collect_list("close").over(trailing(n))
    return ready(F.aggregate(F.slice(window, 2, n), window[0].cast("double"), lambda acc, x: acc + a * (x - acc)), n)


def distance(n: int) -> Column:
    return F.col("close") / sma(n) - 1


def breakout(n: int) -> Column:
    """Last close over the window's highest, itself included, less 1."""
    return ready(F.col("close") / F.max("close").over(trailing(n)) - 1, n)


def slope(n: int) -> Column:
    """Least-squares slope of close on 0..n-1, from sums over the frame."""
    place = F.row_number().over(ordered())
    w = trailing(n)
    lead = F.sum(F.col("close") * F.col("__place")).over(w) - (place - n) * F.sum("close").over(w)  # sum of close * (1..n)
    return ready((lead - (n + 1) / 2 * F.sum("close").over(w)) / (n * (n * n - 1) / 12.0), n)


def with_basics(bars: DataFrame) -> DataFrame:
    """``bars`` with the one-step return ``r`` and the place ``__place`` that others are built on."""
    return bars.withColumn("r", change()).withColumn("__place", F.row_number().over(ordered()).cast("double"))


def volatility(n: int) -> Column:
    """Population deviation of the last n returns; needs n + 1 closes."""
    return F.when(F.count("r").over(trailing(n)) == n, F.stddev_pop("r").over(trailing(n)))


def downside(n: int) -> Column:
    return F.when(F.count("r").over(trailing(n)) == n, F.stddev_pop(F.least("r", F.lit(0.0))).over(trailing(n)))


def range_volatility(n: int) -> Column:
    return ready(F.avg((F.col("high") - F.col("low")) / F.col("close")).over(trailing(n)), n)


def risk_adjusted_momentum(n: int) -> Column:
    return F.when(volatility(n) > 1e-15, change(n) / volatility(n))


def dollar_volume() -> Column:
    return F.col("close") * F.col("volume")


def adv(n: int) -> Column:
    return ready(F.avg(F.col("close") * F.col("volume")).over(trailing(n)), n)


def amihud(n: int) -> Column:
    """Mean absolute return over money traded; not available where any trade value is 0."""
    money = F.col("close") * F.col("volume")
    clean = F.min(money).over(trailing(n)) > 0
    return F.when((F.count("r").over(trailing(n)) == n) & clean, F.avg(F.abs("r") / money).over(trailing(n)))
