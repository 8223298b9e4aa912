"""Total-return-adjusted closes, and the check that they agree with raw closes plus corporate-action cash."""

from __future__ import annotations

import decimal
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import ordered_fold

TOLERANCE = 1e-8
#: Digits of the event run; its exponents have no bound that a run could reach, as many splits leave the range of a double.
EXACT = {"prec": 34, "Emax": decimal.MAX_EMAX, "Emin": decimal.MIN_EMIN, "traps": [decimal.DivisionByZero, decimal.InvalidOperation]}


def _log2_sum(a: Column, b: Column) -> Column:
    """``log2(2^a + 2^b)``, also where no double holds the powers; ``b`` may be null, which adds nothing."""
    top = F.greatest(a, b)
    return top + F.log2(F.pow(F.lit(2.0), a - top) + F.coalesce(F.pow(F.lit(2.0), b - top), F.lit(0.0)))


def placed_actions(actions: DataFrame, bars: DataFrame, key: list[str]) -> DataFrame:
    """``key, day, split, cash, log_split, log_cash``: what one share becomes, and what it is paid, at the first bar on or after its actions.

    The logs are to base 2 and hold where split or cash is beyond a double; no cash has a log of null.
    Actions of one bar apply in order of (effective_at, provider, source_identifier, revision): a
    dividend is paid on the shares that earlier splits have made. Actions after the last bar have no
    row. Both sides are stacked in one order, so no pair is formed.
    """
    stacked = bars.select(*key, "day", F.lit(1).alias("side"), F.lit(None).cast("struct<t:timestamp_ntz,p:string,s:string,r:int>").alias("o"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("amount")).unionByName(
        actions.select(
            *key, F.to_date("effective_at").alias("day"), F.lit(0).alias("side"), F.struct(F.col("effective_at").cast("timestamp_ntz").alias("t"), F.col("provider").alias("p"), F.col("source_identifier").cast("string").alias("s"), F.col("revision").cast("int").alias("r")).alias("o"),
            F.coalesce(F.when(F.col("action_type") == "SPLIT", F.log2(F.col("ratio").cast("double"))), F.lit(0.0)).alias("ratio"), F.when(F.col("action_type") == "CASH_DIVIDEND", F.col("amount").cast("double")).otherwise(0.0).alias("amount"),
        )
    )
    # from the latest on: a frame that ends with the partition would be read anew for every row
    later = Window.partitionBy(*key).orderBy(F.desc("day"), F.desc("side"), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    at = stacked.withColumn("bar", F.last(F.when(F.col("side") == 1, F.col("day")), ignorenulls=True).over(later)).where("side = 0 AND bar IS NOT NULL")
    earlier = Window.partitionBy(*key, "bar").orderBy("day", "o").rowsBetween(Window.unboundedPreceding, -1)
    paid = at.withColumn("paid", F.log2("amount") + F.coalesce(F.sum("ratio").over(earlier), F.lit(0.0)))
    paid = paid.withColumn("top", F.first("paid").over(Window.partitionBy(*key, "bar").orderBy(F.desc("paid")).rowsBetween(Window.unboundedPreceding, 0)))  # a bar's greatest
    logs = paid.groupBy(*key, F.col("bar").alias("day")).agg(F.sum("ratio").alias("log_split"), (F.max("top") + F.log2(F.sum(F.pow(F.lit(2.0), F.col("paid") - F.col("top"))))).alias("log_cash"))
    return logs.select(*key, "day", F.pow(F.lit(2.0), "log_split").alias("split"), F.coalesce(F.pow(F.lit(2.0), "log_cash"), F.lit(0.0)).alias("cash"), "log_split", "log_cash")


def action_issues(actions: DataFrame, bars: DataFrame, key: list[str]) -> DataFrame:
    """``key, issues``: why a run may not use its actions, in fixed order; only runs with an issue."""
    span = bars.groupBy(*key).agg(F.max("day").alias("last"))
    a = actions.join(span, key, "left")
    repeated = Window.partitionBy(*key, "provider", "source_identifier", "revision")
    a = a.withColumn("same", F.count(F.lit(1)).over(repeated))
    named = {
        "invalid_corporate_action": (F.col("same") > 1) | ((F.col("action_type") == "SPLIT") & ~F.coalesce(F.col("ratio") > 0, F.lit(False))) | ((F.col("action_type") == "CASH_DIVIDEND") & ~F.coalesce(F.col("amount") >= 0, F.lit(False))),
        "unsupported_corporate_action": ~F.coalesce(F.col("action_type").isin("SPLIT", "CASH_DIVIDEND"), F.lit(False)),
        "corporate_action_not_point_in_time_available": ~F.coalesce((F.col("announced_at") <= F.col("effective_at")) & (F.col("ingested_at") <= F.col("effective_at")), F.lit(False)),
        "corporate_action_after_last_bar": F.coalesce(F.to_date("effective_at") > F.col("last"), F.lit(True)),
    }
    by = a.groupBy(*key).agg(*(F.bool_or(c).alias(n) for n, c in named.items()))
    return by.select(*key, F.array_compact(F.array(*(F.when(F.col(n), n) for n in named))).alias("issues")).where(F.size("issues") > 0)


def adjusted_closes(bars: DataFrame, actions: DataFrame, key: list[str]) -> DataFrame:
    """``bars`` with ``split, cash, log_split, log_cash, adjusted, log_adjusted``: closes times the factors of all later bars, multiplied back from the latest.

    A bar's factor is ``close / (split * close + cash)``, what a share bought before it is worth at
    it turned round, so adjusted closes move as the holding does. The last bar's is its close. Many
    actions take ``adjusted`` to 0 or infinity; ``log_adjusted``, to base 2, goes on.
    """
    joined = bars.join(placed_actions(actions, bars, key), [*key, "day"], "left").fillna({"split": 1.0, "cash": 0.0, "log_split": 0.0})
    close = F.log2(F.col("close").cast("double"))
    factor = -_log2_sum(F.col("log_split"), F.col("log_cash") - close)
    later = Window.partitionBy(*key).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("back", F.coalesce(F.sum(factor).over(later), F.lit(0.0))).withColumns({"adjusted": F.col("close") * F.pow(F.lit(2.0), "back"), "log_adjusted": close + F.col("back")}).drop("back")


def vector_run(bars: DataFrame, key: list[str]) -> DataFrame:
    """``key, log_equity, expected``: signals held in the next period on adjusted closes, without costs, from 1.

    Returns are differences of ``log_adjusted`` and growth is a sum of logs (natural in the result),
    so that no product leaves the range of a double. ``expected`` is the last position.
    """
    w = Window.partitionBy(*key).orderBy("day")
    held = bars.select(*key, "day", F.lag("signal").over(w).cast("double").alias("position"), (F.col("log_adjusted") - F.lag("log_adjusted").over(w)).alias("move"))
    p, move = F.col("position"), F.col("move")
    grown = F.when(p == 1, move).when(p == 0, 0.0).otherwise(_log2_sum(F.log2(1 - p), F.log2(p) + move))
    return held.where("move IS NOT NULL").groupBy(*key).agg((F.sum(grown) * math.log(2)).alias("log_equity"), F.max_by("position", "day").alias("expected"))


def event_run(bars: DataFrame, key: list[str]) -> DataFrame:
    """``key, log_equity, exposure, fills, illiquid``: raw closes, shares and cash, bar by bar from a cash of 1.

    At each bar actions change shares and cash, then the signal's part of the equity is bought or
    sold at the close; the last bar is not traded. ``bars`` has log_split, log_cash, close, signal,
    volume and ``is_last``. One run is an ordered fold that holds shares and cash, as decimals of 34
    digits with any exponent; the log of the equity is natural, null where nothing or less is left.
    """
    context = decimal.Context(**EXACT)

    def power(log: float) -> decimal.Decimal:
        whole = math.floor(log)
        return decimal.Decimal(2) ** whole * decimal.Decimal(2 ** (log - whole))

    def step(s: dict, row: dict):
        with decimal.localcontext(context):
            if row["log_cash"] is not None:
                s["cash"] += s["shares"] * power(row["log_cash"])
            if row["log_split"]:
                s["shares"] *= power(row["log_split"])
            s["close"] = close = decimal.Decimal(row["close"])
            if not row["is_last"]:
                signal = decimal.Decimal(row["signal"])
                # as exact as the state: what is wholly in shares or cash already is not traded
                delta = signal * s["cash"] / close - (1 - signal) * s["shares"]
                if delta:
                    s["fills"] += 1
                    s["illiquid"] |= row["volume"] is None or abs(delta) > decimal.Decimal(row["volume"])
                    equity = s["cash"] + s["shares"] * close
                    s["cash"], s["shares"] = (1 - signal) * equity, signal * equity / close
        return ()

    def finish(at: tuple, s: dict):
        with decimal.localcontext(context):
            equity = s["cash"] + s["shares"] * s["close"]
            yield (*at, float(equity.ln()) if equity > 0 else None, float(s["shares"] * s["close"] / equity) if equity else 0.0, s["fills"], s["illiquid"])

    kinds = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in key)
    rows = bars.select(*key, "day", *(F.col(c).cast("double").alias(c) for c in ("log_split", "log_cash", "close", "signal", "volume")), "is_last")
    start = lambda: {"cash": decimal.Decimal(1), "shares": decimal.Decimal(0), "close": decimal.Decimal(0), "fills": 0, "illiquid": False}
    return ordered_fold(rows, key, ["day"], start, step, f"{kinds}, log_equity double, exposure double, fills int, illiquid boolean", finish)


def adjusted_parity(bars: DataFrame, actions: DataFrame, key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``key, status, reasons, vector_equity, event_equity, exposure, vector_log, event_log``: adjusted closes in the vectorised backtest against raw closes with cash.

    ``bars``: key, day, close, volume, signal in [0, 1]. REJECTED runs have issues of their inputs
    and no figures; the others are RECONCILED, or DIFFERENT with the measures that differ by more
    than the tolerance (relative above 1). Days are unique within a run; a run needs two bars. Equity
    is compared by its natural logs, which have figures where a double has 0 or infinity.
    """
    last = Window.partitionBy(*key)
    marked = adjusted_closes(bars, actions, key).withColumns({"is_last": F.col("day") == F.max("day").over(last), "n": F.count(F.lit(1)).over(last)})
    marked = marked.withColumn("bounded", F.bool_and(F.coalesce(F.col("signal").between(0, 1), F.lit(False))).over(last))
    followed = marked.where("n > 1").withColumn("signal", F.coalesce("signal", F.lit(0)))  # a run without a signal somewhere is out of bounds
    vector = vector_run(followed, key).withColumnRenamed("log_equity", "vector_log")
    event = event_run(followed, key).withColumnRenamed("log_equity", "event_log")
    inputs = marked.groupBy(*key).agg(F.first("n").alias("n"), F.first("bounded").alias("bounded"))
    out = inputs.join(action_issues(actions, bars, key), key, "left").join(vector, key, "left").join(event, key, "left")
    bad = F.array_compact(F.concat(F.array(F.when(F.col("n") < 2, "too_few_bars"), F.when(~F.col("bounded"), "signals_out_of_bounds")), F.coalesce("issues", F.array().cast("array<string>")), F.array(F.when(F.coalesce("illiquid", F.lit(False)), "insufficient_close_liquidity"))))
    apart = F.abs(F.expm1(F.col("vector_log") - F.col("event_log"))) > tolerance * F.greatest(F.lit(1.0), F.exp(-F.col("event_log")))
    differ = F.array_compact(F.array(F.when(apart, "final_equity_mismatch"), F.when(F.abs(F.col("exposure") - F.col("expected")) > tolerance * F.greatest(F.lit(1.0), F.abs("expected")), "final_exposure_mismatch")))
    status = F.when(F.size("bad") > 0, "REJECTED").when(F.size("differ") > 0, "DIFFERENT").otherwise("RECONCILED")
    out = out.withColumns({"bad": bad, "differ": differ})
    figure = lambda c, n: F.when(F.size("bad") == 0, c).alias(n)
    return out.select(*key, status.alias("status"), F.when(F.size("bad") > 0, F.col("bad")).otherwise(F.col("differ")).alias("reasons"), figure(F.exp("vector_log"), "vector_equity"), figure(F.exp("event_log"), "event_equity"), figure(F.col("exposure"), "exposure"), figure(F.col("vector_log"), "vector_log"), figure(F.col("event_log"), "event_log"))
