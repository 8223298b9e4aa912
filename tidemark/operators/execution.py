"""Execution analytics and position accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import carried, in_ranges, ordered_fold


def order_roll_up(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Filled quantity, volume-weighted price and status of each order; unfilled ones appear too."""
    by = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), (F.sum(F.col("quantity") * F.col("price")) / F.sum("quantity")).alias("vwap"), F.count(F.lit(1)).alias("fills"))
    joined = orders.join(by, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    status = F.when(F.col("filled") == 0, "OPEN").when(F.col("filled") < F.col("quantity"), "PARTIALLY_FILLED").otherwise("FILLED")
    return joined.withColumn("status", status)


def quality(rolled: DataFrame, limit: float) -> DataFrame:
    """Fill ratio, slippage against the decision price in the order's direction, shortfall and breach."""
    side = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    slip = side * (F.col("vwap") - F.col("decision_price")) / F.col("decision_price")
    out = rolled.withColumn("fill_ratio", F.col("filled") / F.col("quantity")).withColumn("slippage", slip)
    return out.withColumn("shortfall", F.col("slippage") * F.col("filled") * F.col("decision_price")).withColumn("breach", F.coalesce(F.col("slippage") > limit, F.lit(False)))


#: Hash bins of keys, and fills in a bin up to which its keys are folded as arrays; keys of fuller ones go by ranges.
BINS, BIN_FILLS = 1 << 16, 50_000


def positions(fills: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, bin_fills: int = BIN_FILLS) -> DataFrame:
    """``keys, quantity, average_cost, cash`` from ordered fills (signed, price).

    Adding to a position averages the cost; reducing keeps it; crossing zero takes the fill's price,
    and a flat position has cost 0. Fills without a price or quantity are left out. Fills are counted
    by hash bins of their keys. In bins of up to ``bin_fills`` no key has more fills than that, so
    each key's are folded as one array; keys of fuller bins are folded by ranges. Both do the same.
    """
    flat = fills.select(*keys, *order, F.col("signed").cast("double").alias("_q"), F.col("price").cast("double").alias("_p")).where("_q IS NOT NULL AND _p IS NOT NULL")
    flat = flat.withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(BINS)).cast("int"))
    full = [r["_bin"] for r in flat.groupBy("_bin").count().where(F.col("count") > bin_fills).select("_bin").collect()]  # at most BINS numbers
    if not full:
        return _folded(flat.drop("_bin"), keys, order)
    bins = F.broadcast(flat.sparkSession.createDataFrame([(b,) for b in full], "_bin int"))
    few, many = (flat.join(bins, "_bin", how).drop("_bin") for how in ("left_anti", "left_semi"))
    return _folded(few, keys, order).unionByName(_by_ranges(many, keys, order, ranges))


def _folded(flat: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Positions of keys that each have a bounded number of fills."""
    fills = F.array_sort(F.collect_list(F.struct(*order, "_q", "_p")))

    def fill(s, f):
        q, c, x, p = s["quantity"] + f["_q"], s["average_cost"], f["_q"], f["_p"]
        cost = F.when(q == 0, 0.0).when(s["quantity"] * x >= 0, (c * s["quantity"] + p * x) / q).when(s["quantity"] * q > 0, c).otherwise(p)
        return F.struct(q.alias("quantity"), cost.alias("average_cost"), (s["cash"] - x * p).alias("cash"))

    flat_book = F.struct(*(F.lit(0.0).alias(n) for n in ("quantity", "average_cost", "cash")))
    return flat.groupBy(*keys).agg(fills.alias("_f")).select(*keys, F.aggregate("_f", flat_book, fill).alias("_s")).select(*keys, "_s.*")


def _by_ranges(flat: DataFrame, keys: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """Positions of keys with any number of fills.

    The quantity before a range of fills is a running sum, and what a range does to the cost is
    ``a * cost + b``, so ranges of a hot key are folded side by side and then chained, one row for
    each.
    """
    dealt = carried(in_ranges(flat, keys, order, ranges), keys, ["_q"])

    def fill(s: dict, row: dict):
        held = s.setdefault("q", row["before__q"])
        q, x, p = held + row["_q"], row["_q"], row["_p"]
        if q == 0:
            s["a"], s["b"] = 0.0, 0.0
        elif held * x >= 0:
            s["a"], s["b"] = s["a"] * held / q, (s["b"] * held + p * x) / q
        elif held * q < 0:
            s["a"], s["b"] = 0.0, p
        s["q"] = q
        s["cash"] -= x * p
        return ()

    def chain(s: dict, row: dict):
        s["cost"] = row["_a"] * s["cost"] + row["_b"]
        s["q"], s["cash"] = row["_q"], s["cash"] + row["_cash"]
        return ()

    kinds = ", ".join(f"{k} {flat.schema[k].dataType.simpleString()}" for k in keys)
    parts = ordered_fold(dealt, ["piece", *keys], order, lambda: {"a": 1.0, "b": 0.0, "cash": 0.0}, fill, f"piece int, {kinds}, _q double, _a double, _b double, _cash double", lambda key, s: [(*key, s["q"], s["a"], s["b"], s["cash"])])
    return ordered_fold(parts, keys, ["piece"], lambda: {"q": 0.0, "cost": 0.0, "cash": 0.0}, chain, f"{kinds}, quantity double, average_cost double, cash double", lambda key, s: [(*key, s["q"], s["cost"], s["cash"])])


def reconcile_positions(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys of either side whose values differ by more than the tolerance; a missing one is 0."""
    joined = ours.select(*keys, F.col(value).alias("ours")).join(theirs.select(*keys, F.col(value).alias("theirs")), keys, "full_outer")
    filled = joined.fillna(0, ["ours", "theirs"]).withColumn("difference", F.col("ours") - F.col("theirs"))
    return filled.where(F.abs("difference") > tolerance)


def sequence_gaps(events: DataFrame, source: str, sequence: str) -> DataFrame:
    """Places where a source's sequence jumps or repeats."""
    w = Window.partitionBy(source).orderBy(sequence)
    step = events.withColumn("before", F.lag(sequence).over(w)).withColumn("step", F.col(sequence) - F.col("before")).where("step <> 1")
    return step.select(source, "before", F.col(sequence).alias("after"), F.when(F.col("step") == 0, "DUPLICATE").otherwise("GAP").alias("kind"))
