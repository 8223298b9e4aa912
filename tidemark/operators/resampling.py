"""Resampled paths: bootstrap and trade-order permutations with the order of draws kept.

Draw i of resample r is an integer function of (seed, r, i) that any engine can repeat, so results
depend on neither partitions nor libraries. A series travels once for each block of resamples, as an
array of its values in order; each block's paths are worked out side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
RESAMPLES, BLOCK = 1000, 50
#: Cells of draws that are worked out at a time.
CELLS = 1 << 20
#: Equity at or below which a path is ruined.
RUIN = 0.5
PERIODS = 252
PATHS = "resample int, total_return double, sharpe double, max_drawdown double, lowest double"


def mixed(seed: int, resample: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whole numbers below ``PRIME``; no product passes 63 bits."""
    x = (place * 48271 + resample * 69621 + seed) % PRIME
    x = (x * x + place) % PRIME
    x = (x * 16807 + resample) % PRIME
    return (x * x + resample) % PRIME


def mixed_sql(seed: int) -> str:
    """``mixed`` as the last of SQL steps over ``grid`` with columns i (place) and r (resample): ``drawn`` with h."""
    return f"""a AS (SELECT *, (i * 48271 + r * 69621 + {seed}) % {PRIME} AS x0 FROM grid), b AS (SELECT *, (x0 * x0 + i) % {PRIME} AS x1 FROM a),
    c AS (SELECT *, (x1 * 16807 + r) % {PRIME} AS x2 FROM b), drawn AS (SELECT *, (x2 * x2 + r) % {PRIME} AS h FROM c)"""


def path_measures(steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Total return, Sharpe ratio (NaN where all steps are alike), drawdown and lowest equity of each row's path from 1."""
    equity = np.cumprod(1 + steps, axis=1)
    peak = np.maximum(1.0, np.maximum.accumulate(equity, axis=1))
    drawdown = np.maximum(0.0, (1 - equity / peak).max(axis=1))
    lowest = np.minimum(1.0, equity.min(axis=1))
    flat = steps.max(axis=1) == steps.min(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sharpe = np.where(flat, np.nan, steps.mean(axis=1) / steps.std(axis=1) * np.sqrt(PERIODS))
    return equity[:, -1] - 1, sharpe, drawdown, lowest


def _paths(returns: DataFrame, key: list[str], order: list[str], value: str, resamples: int, seed: int, permute: bool) -> DataFrame:
    series = returns.where(F.col(value).isNotNull()).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))), lambda x: x["_v"]).alias("_series"))
    blocks = series.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(BLOCK)))).repartition(*key, "_from")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                row = row._asdict()
                values = np.asarray(row["series"], np.float64)
                n, last = len(values), min(resamples, row["start"] + BLOCK)
                width = max(1, CELLS // n)
                for first in range(row["start"], last, width):
                    r = np.arange(first, min(last, first + width))
                    draws = mixed(seed, r[:, None].astype(np.int64), np.arange(n, dtype=np.int64)[None, :])
                    steps = values[np.argsort(draws, axis=1, kind="stable") if permute else draws % n]
                    total, sharpe, drawdown, lowest = path_measures(steps)
                    out = pd.DataFrame({k: [row[f"key{j}"]] * len(r) for j, k in enumerate(key)})
                    yield out.assign(resample=r, total_return=total, sharpe=sharpe, max_drawdown=drawdown, lowest=lowest)

    kinds = ", ".join(f"{k} {returns.schema[k].dataType.simpleString()}" for k in key)
    named = blocks.select(*(F.col(k).alias(f"key{j}") for j, k in enumerate(key)), F.col("_series").alias("series"), F.col("_from").alias("start"))
    return named.mapInPandas(run, f"{kinds}, {PATHS}").withColumn("sharpe", F.nanvl("sharpe", F.lit(None).cast("double")))


def bootstrap_paths(returns: DataFrame, key: list[str], order: list[str], value: str, resamples: int = RESAMPLES, seed: int = 7) -> DataFrame:
    """``key, resample, total_return, sharpe, max_drawdown, lowest``: as many draws as periods, with replacement, in the order drawn.

    Null returns are left out; a series without any has no paths. A path without variation has a
    null Sharpe ratio. A task holds one series and a bounded block of draws.
    """
    return _paths(returns, key, order, value, resamples, seed, permute=False)


def permuted_paths(trades: DataFrame, key: list[str], order: list[str], value: str, simulations: int = RESAMPLES, seed: int = 11) -> DataFrame:
    """As ``bootstrap_paths``, with every trade once, in a random order: drawdown and lowest equity vary, the total does not."""
    return _paths(trades, key, order, value, simulations, seed, permute=True)


def lower_quantile(values: str, p: float):
    """sorted[int(p (n - 1))] of a column within a group; nulls are left out. Groups are of resamples, whose number is a parameter."""
    held = F.array_sort(F.collect_list(values))
    return F.get(held, F.floor(F.lit(p) * (F.size(held) - 1)).cast("int"))


def bootstrap_evidence(paths: DataFrame, key: list[str]) -> DataFrame:
    """Distribution of returns, Sharpe ratios and drawdowns, and the share of losing resamples."""
    named = {"return": "total_return", "sharpe": "sharpe", "drawdown": "max_drawdown"}
    return paths.groupBy(*key).agg(
        F.count(F.lit(1)).alias("resamples"), F.avg((F.col("total_return") < 0).cast("double")).alias("p_negative"),
        *(lower_quantile(c, p).alias(f"p{round(p * 100):02d}_{n}") for n, c in named.items() for p in (0.05, 0.5, 0.95)),
    )


def permutation_evidence(paths: DataFrame, key: list[str], ruin: float = RUIN) -> DataFrame:
    """Terminal equity, drawdown and how likely a path falls to the ruin threshold."""
    equity = paths.withColumn("terminal", 1 + F.col("total_return"))
    return equity.groupBy(*key).agg(
        F.count(F.lit(1)).alias("simulations"), F.avg((F.col("lowest") <= ruin).cast("double")).alias("p_ruin"),
        *(lower_quantile("terminal", p).alias(f"p{round(p * 100):02d}_terminal") for p in (0.01, 0.05)), *(lower_quantile("max_drawdown", p).alias(f"p{round(p * 100):02d}_drawdown") for p in (0.05, 0.5, 0.95)),
    )
