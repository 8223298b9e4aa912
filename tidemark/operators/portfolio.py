"""Portfolio risk: exposures, concentration, stress, tail losses and weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import ordered_fold
from tidemark.sources.staging import staged


def gross_and_net(exposures: DataFrame, key: str) -> DataFrame:
    return exposures.groupBy(key).agg(F.sum(F.abs("notional")).alias("gross"), F.sum("notional").alias("net"))


def grouped(exposures: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """``key, dimension, value, gross, net`` along each dimension; blanks are left out."""
    long = exposures.select(key, "notional", *dimensions).unpivot([key, "notional"], dimensions, "dimension", "value").where("value IS NOT NULL AND trim(value) <> ''")
    return long.groupBy(key, "dimension", "value").agg(F.sum(F.abs("notional")).alias("gross"), F.sum("notional").alias("net"))


def concentration(groups: DataFrame, key: str, limit: float) -> DataFrame:
    """Groups whose gross share of their portfolio and dimension is over the limit."""
    w = Window.partitionBy(key, "dimension")
    return groups.withColumn("share", F.col("gross") / F.sum("gross").over(w)).where(F.col("share") > limit)


def stress(exposures: DataFrame, scenarios: DataFrame, key: str, group: str) -> DataFrame:
    """Profit and loss by portfolio and scenario: the shock of a row's group, else none.

    Exposures are summed by group before they meet the scenarios.
    """
    by = exposures.groupBy(key, group).agg(F.sum("notional").alias("net"))
    return by.join(scenarios, group).groupBy(key, "scenario").agg(F.sum(F.col("net") * F.col("shock")).alias("pnl"))


def var_cvar(returns: DataFrame, key: str, value: str, confidence: float) -> DataFrame:
    """Losses at the k-th worst and over the k worst, k = max(1, ceil(n * confidence)), at least 0."""
    w = Window.partitionBy(key)
    ranked = returns.withColumn("__rn", F.row_number().over(w.orderBy(value, "day"))).withColumn("__k", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * F.lit(confidence)).cast("int")))
    var = F.max(F.when(F.col("__rn") == F.col("__k"), -F.col(value)))
    cvar = F.avg(F.when(F.col("__rn") <= F.col("__k"), -F.col(value)))
    return ranked.groupBy(key).agg(F.greatest(F.lit(0.0), var).alias("var"), F.greatest(F.lit(0.0), cvar).alias("cvar"))


def inverse_risk(volatilities: DataFrame, portfolio: str, most: float) -> DataFrame:
    """Weights in proportion to 1 / volatility; a portfolio with a weight over the limit is rejected."""
    w = Window.partitionBy(portfolio)
    weighted = volatilities.withColumn("weight", (1 / F.col("volatility")) / F.sum(1 / F.col("volatility")).over(w))
    return weighted.withColumn("status", F.when(F.max("weight").over(w) > most, "REJECTED").otherwise("ACCEPTED"))


#: Series of a block, so that a pair of blocks meets once a time instead of each pair of series.
SERIES, SALTS = 64, 4


def _blocks(returns: DataFrame, key: str, time: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``key, place`` of the series, in order, and ``time, block, held``: a block's values at a time, at most ``SERIES`` of them."""
    places = staged(returns.select(key).distinct().withColumn("place", F.row_number().over(Window.orderBy(key)) - 1), "series")  # one row a series
    at = returns.where(F.col(value).isNotNull()).join(places, key).select(F.col(time).alias("t"), (F.col("place") / SERIES).cast("int").alias("block"), F.struct((F.col("place") % SERIES).cast("int").alias("s"), F.col(value).cast("double").alias("v")).alias("x"))
    return places, at.groupBy("t", "block").agg(F.collect_list("x").alias("held"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over common times for each pair of blocks, from rows in order of the pairs."""
    now, n, sums = None, 0, None

    def given() -> pa.RecordBatch:
        i, j = np.nonzero(sums[0])
        i, j = i[keep := (now[0] < now[1]) | (i <= j)], j[keep]
        return pa.RecordBatch.from_arrays([pa.array(now[0] * SERIES + i), pa.array(now[1] * SERIES + j), *(pa.array(m[i, j]) for m in sums)], ["i", "j", "n", "x", "y", "xy"])

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("left"), batch.column("right")
        at = 0
        while at < len(a):
            end = at
            while end < len(a) and (a[end], b[end]) == (a[at], b[at]):
                end += 1
            if now != (a[at], b[at]):
                if now is not None:
                    yield given()
                now, sums = (a[at], b[at]), [np.zeros((SERIES, SERIES)) for _ in range(4)]
            (x, mx), (y, my) = (_matrix(c.slice(at, end - at)) for c in (left, right))
            for total, part in zip(sums, (mx.T @ my, x.T @ my, mx.T @ y, x.T @ y), strict=True):
                total += part
            at = end
    if now is not None:
        yield given()


def _matrix(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence by (row, series) of a column of lists of (s, v)."""
    flat = held.flatten()
    row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
    place = flat.field("s").to_numpy()
    x, m = np.zeros((len(held), SERIES)), np.zeros((len(held), SERIES))
    x[row, place], m[row, place] = flat.field("v").to_numpy(), 1.0
    return x, m


def covariance_pairs(returns: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``i, j, cov, n``: population covariance of each pair of series over their common times; pairs once, i <= j.

    Series are dealt into blocks, pairs of blocks meet once a time, and a task adds up one pair's
    matrix product at a time, so what is joined and shuffled is T (N / SERIES)^2 rows, not T N^2. A
    series has one value a time; nulls are left out; pairs without a common time have no row.
    """
    places, blocks = _blocks(returns, key, time, value)
    blocks = staged(blocks, "blocks")
    a, b = (blocks.select("t", F.col("block").alias(n), F.col("held").alias(h)) for n, h in (("a", "left"), ("b", "right")))
    met = a.join(b, "t").where("a <= b").withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)))
    parts = met.repartition("a", "b", "salt").sortWithinPartitions("a", "b").select("a", "b", "left", "right").mapInArrow(_products, "i long, j long, n double, x double, y double, xy double")
    sums = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy")))
    named = sums.join(places.select(F.col("place").cast("long").alias("i"), F.col(key).alias("ki")), "i").join(places.select(F.col("place").cast("long").alias("j"), F.col(key).alias("kj")), "j")
    cov = F.col("xy") / F.col("n") - F.col("x") * F.col("y") / F.col("n") / F.col("n")
    return named.select(F.col("ki").alias("i"), F.col("kj").alias("j"), cov.alias("cov"), F.col("n").cast("long").alias("n"))


def stressed_covariance(pairs: DataFrame, toward: float) -> DataFrame:
    """Correlations moved toward 1: rho' = rho + s (1 - rho), off the diagonal."""
    var = pairs.where("i = j").select(F.col("i").alias("k"), F.col("cov").alias("v"))
    both = pairs.join(var.select(F.col("k").alias("i"), F.col("v").alias("vi")), "i").join(var.select(F.col("k").alias("j"), F.col("v").alias("vj")), "j")
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(F.col("cov") + toward * (scale - F.col("cov"))).alias("stressed"))


def reserve(orders: DataFrame, keys: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """Greedy reservation in order: rows that fit under the limit of their key, with the total so far.

    A later smaller order may still fit, so a running sum is not enough. It is an ordered fold that
    holds one total; orders of a null amount never fit.
    """
    rows = orders.select(*keys, *order, F.col(amount).cast("double").alias("amount"))
    names = rows.columns

    def step(total: list, row: dict):
        fits = row["amount"] is not None and total[0] + row["amount"] <= limit
        total[0] += row["amount"] if fits else 0.0
        yield (*(row[n] for n in names), fits)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ordered_fold(rows, keys, order, lambda: [0.0], step, f"{kinds}, accepted boolean")
