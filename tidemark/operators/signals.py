"""Baseline signals (0 or 1) and exposures for all instruments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import features as f


def cross(fast: int, slow: int) -> Column:
    return F.coalesce((f.sma(fast) > f.sma(slow)).cast("int"), F.lit(0))


def breakout(n: int) -> Column:
    """Close above the highest of the n closes before it."""
    before = f.ordered().rowsBetween(-n, -1)
    return F.when(F.count("close").over(before) == n, (F.col("close") > F.max("close").over(before)).cast("int")).otherwise(0)


def mean_reversion(n: int, entry: float) -> Column:
    return F.coalesce(((F.col("close") - f.sma(n)) / f.sma(n) <= -entry).cast("int"), F.lit(0))


def momentum(n: int) -> Column:
    return F.coalesce((F.col("close") > F.lag("close", n).over(f.ordered())).cast("int"), F.lit(0))


FAMILIES = {
    "moving_average_cross": lambda: cross(3, 8),
    "breakout": lambda: breakout(5),
    "mean_reversion": lambda: mean_reversion(5, 0.02),
    "momentum": lambda: momentum(4),
}


def baseline_signals(bars: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """``strategy, instrument_id, day, close, signal`` of every family, in long form from one window pass."""
    wide = bars.select("instrument_id", "day", "close", *(FAMILIES[n]().alias(n) for n in families))
    return wide.unpivot(["instrument_id", "day", "close"], list(families), "strategy", "signal")


def register_signal(name: str, fn) -> None:
    """Add a family: ``fn()`` gives a Column over bars."""
    FAMILIES[name] = fn


def momentum_exposure(value: Column, threshold: float, most: float) -> Column:
    return F.when(value.isNull(), None).when(value > threshold, most).otherwise(0.0)


def clamped_exposure(value: Column, most: float) -> Column:
    return F.least(F.greatest(value * most, F.lit(0.0)), F.lit(most))


def volatility_scaled(value: Column, vol: Column, target: float, most: float) -> tuple[Column, Column]:
    """Exposure and AVAILABLE or UNAVAILABLE: no momentum is 0, no volatility is unavailable."""
    status = F.when(value.isNull() | vol.isNull() | (vol <= 0), "UNAVAILABLE").otherwise("AVAILABLE")
    exposure = F.when(value <= 0, 0.0).otherwise(F.least(F.lit(most), target / vol))
    return F.when(status == "AVAILABLE", exposure), status
