"""Queries on resampled paths and on adjusted closes against raw closes with cash."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import adjusted, resampling
from tidemark.plans.registry import query
from tidemark.sources.staging import staged
from tidemark.sources import views
from tidemark.sources.views import with_views


def r6(c, name):
    return F.round(c, 6).alias(name)


_MONTHLY = with_views("returns") + ", monthly AS (SELECT instrument_id, CAST(date_trunc('month', day) AS DATE) AS month, exp(sum(ln(1 + r))) - 1 AS r FROM returns GROUP BY 1, 2), placed AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY month) - 1 AS place, count(*) OVER (PARTITION BY instrument_id) AS n FROM monthly)"


def _monthly(spark, d):
    return views.returns(spark, d).groupBy("instrument_id", F.trunc("day", "month").alias("month")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("r"))


def _path_sql(seed: int, pick: str) -> str:
    """Every draw in its place, then what its path does; ``pick`` gives ``way`` (instrument_id, r, i, v)."""
    return f"""{_MONTHLY}, grid AS (SELECT instrument_id, n, place AS i, g.r AS r, placed.r AS own FROM placed, range(0, {resampling.RESAMPLES}) AS g(r)), {resampling.mixed_sql(seed)}, way AS ({pick}),
    eq AS (SELECT *, product(1 + v) OVER w AS e FROM way WINDOW w AS (PARTITION BY instrument_id, r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    pk AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY instrument_id, r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM eq),
    path AS (SELECT instrument_id, r, arg_max(e, i) - 1 AS total, greatest(0, max(1 - e / peak)) AS dd, least(1, min(e)) AS lowest, CASE WHEN max(v) > min(v) THEN avg(v) / stddev_pop(v) * sqrt(252) END AS sharpe FROM pk GROUP BY 1, 2)"""


def _at(c: str, p: float) -> str:
    return f"round((list_sort(list({c}) FILTER ({c} IS NOT NULL)))[floor({p}::DOUBLE * (count({c}) - 1))::BIGINT + 1], 6)"


_NAMED = {"return": "total", "sharpe": "sharpe", "drawdown": "dd"}


@query("v9_bootstrap", _path_sql(7, "SELECT w.instrument_id, w.r, w.i, p.r AS v FROM drawn w JOIN placed p ON p.instrument_id = w.instrument_id AND p.place = w.h % w.n") + f" SELECT instrument_id, count(*) AS resamples, round(avg((total < 0)::INT), 6) AS p_negative, {', '.join(f'{_at(c, p)} AS p{round(p * 100):02d}_{n}' for n, c in _NAMED.items() for p in (0.05, 0.5, 0.95))} FROM path GROUP BY 1")
def v9(spark, d):
    paths = resampling.bootstrap_paths(_monthly(spark, d), ["instrument_id"], ["month"], "r")
    out = resampling.bootstrap_evidence(paths, ["instrument_id"])
    return out.select("instrument_id", "resamples", *(r6(F.col(c), c) for c in out.columns[2:]))


@query("v10_trade_order_permutations", _path_sql(11, "SELECT instrument_id, r, row_number() OVER (PARTITION BY instrument_id, r ORDER BY h, i) AS i, own AS v FROM drawn") + f" SELECT instrument_id, count(*) AS simulations, round(avg((lowest <= 0.5)::INT), 6) AS p_ruin, {', '.join(f'{_at(c, p)} AS p{round(p * 100):02d}_{n}' for n, c, ps in (('terminal', 'total + 1', (0.01, 0.05)), ('drawdown', 'dd', (0.05, 0.5, 0.95))) for p in ps)} FROM path GROUP BY 1")
def v10(spark, d):
    paths = resampling.permuted_paths(_monthly(spark, d), ["instrument_id"], ["month"], "r")
    out = resampling.permutation_evidence(paths, ["instrument_id"])
    return out.select("instrument_id", "simulations", *(r6(F.col(c), c) for c in out.columns[2:]))


@query("b18_adjusted_parity", with_views("bars") + """, b AS (SELECT instrument_id, year(day)::INT AS y, day, close, volume, coalesce(close > lag(close) OVER w, false)::INT AS signal FROM bars WINDOW w AS (PARTITION BY instrument_id, year(day) ORDER BY day)),
acts AS (SELECT instrument_id, year(l.day)::INT AS y, l.day, provider, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_extendedprice || '-' || l_quantity AS s, CASE l_linenumber WHEN 7 THEN 'SPLIT' WHEN 6 THEN 'CASH_DIVIDEND' ELSE 'SPIN_OFF' END AS kind,
    CASE WHEN l_linenumber = 7 THEN CASE WHEN l_quantity > 25 THEN 2.0 ELSE 0.5 END ELSE 1.0 END AS ratio, CASE WHEN l_linenumber = 6 THEN l_quantity / 10 ELSE 0 END AS amount, l_orderkey % 300 = 0 AS late FROM trades l WHERE l_linenumber IN (6, 7) OR (l_linenumber = 5 AND l_orderkey % 400 = 0)),
paid AS (SELECT *, amount * coalesce(product(ratio) OVER (PARTITION BY instrument_id, y, day ORDER BY provider, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cash FROM acts),
at AS (SELECT instrument_id, y, day, product(ratio) AS split, sum(cash) AS cash FROM paid GROUP BY ALL),
bad AS (SELECT instrument_id, y, concat_ws(',', CASE WHEN bool_or(n > 1) THEN 'invalid_corporate_action' END, CASE WHEN bool_or(kind = 'SPIN_OFF') THEN 'unsupported_corporate_action' END, CASE WHEN bool_or(late) THEN 'corporate_action_not_point_in_time_available' END) AS why
    FROM (SELECT *, count(*) OVER (PARTITION BY instrument_id, y, provider, s) AS n FROM acts) GROUP BY 1, 2),
m AS (SELECT b.*, coalesce(split, 1) AS split, coalesce(cash, 0) AS cash, lag(close) OVER w AS before, lag(signal) OVER w AS held, row_number() OVER (PARTITION BY b.instrument_id, b.y ORDER BY day DESC) AS back FROM b LEFT JOIN at_ USING (instrument_id, y, day) WINDOW w AS (PARTITION BY b.instrument_id, b.y ORDER BY day)),
adj AS (SELECT *, close * coalesce(product(close / (split * close + cash)) OVER (PARTITION BY instrument_id, y ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS adjusted FROM m),
step AS (SELECT *, held * (adjusted / lag(adjusted) OVER (PARTITION BY instrument_id, y ORDER BY day) - 1) AS net, 1 + held * ((split * close + cash) / before - 1) AS grow FROM adj),
own AS (SELECT *, signal * product(coalesce(grow, 1)) OVER (PARTITION BY instrument_id, y ORDER BY day) / close AS shares FROM step),
thin AS (SELECT instrument_id, y, bool_or(back > 1 AND abs(shares - coalesce(earlier * split, 0)) > volume) AS thin FROM (SELECT *, lag(shares) OVER (PARTITION BY instrument_id, y ORDER BY day) AS earlier FROM own) GROUP BY 1, 2),
run AS (SELECT instrument_id, y, count(*) AS n, product(1 + net) AS v, product(grow) AS e, max(CASE WHEN back = 1 THEN held * split * close / before / grow END) AS exposure, max(CASE WHEN back = 1 THEN held END) AS expected FROM step GROUP BY 1, 2),
said AS (SELECT instrument_id, y, v, e, exposure, concat_ws(',', CASE WHEN n < 2 THEN 'too_few_bars' END, nullif(why, ''), CASE WHEN n > 1 AND thin THEN 'insufficient_close_liquidity' END) AS bad, concat_ws(',', CASE WHEN abs(v - e) > 1e-8 * greatest(1, abs(e)) THEN 'final_equity_mismatch' END, CASE WHEN abs(exposure - expected) > 1e-8 THEN 'final_exposure_mismatch' END) AS differ FROM run JOIN thin USING (instrument_id, y) LEFT JOIN bad USING (instrument_id, y))
SELECT instrument_id, y, CASE WHEN bad <> '' THEN 'REJECTED' WHEN differ <> '' THEN 'DIFFERENT' ELSE 'RECONCILED' END AS status, CASE WHEN bad <> '' THEN bad ELSE differ END AS reasons, CASE WHEN bad = '' THEN round(ln(v), 6) END AS vector_log, CASE WHEN bad = '' THEN round(ln(e), 6) END AS event_log, CASE WHEN bad = '' THEN round(exposure, 6) END AS exposure FROM said""".replace("at AS (SELECT instrument_id, y, day, product", "at_ AS (SELECT instrument_id, y, day, product"))
def b18(spark, d):
    """Each instrument's years as runs: held after a day that closed higher."""
    w = Window.partitionBy("instrument_id", "y").orderBy("day")
    bars = views.bars(spark, d).withColumn("y", F.year("day"))
    bars = bars.select("instrument_id", "y", "day", "close", "volume", F.coalesce((F.col("close") > F.lag("close").over(w)).cast("int"), F.lit(0)).alias("signal"))
    bars = staged(bars, "bars")  # a row an instrument and day, read by each of the steps
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    t = views.raw_bars(spark, d).where((line >= 6) | ((line == 5) & (order % 400 == 0)))
    actions = t.select(
        "instrument_id", F.year("day").alias("y"), F.when(line == 7, "SPLIT").when(line == 6, "CASH_DIVIDEND").otherwise("SPIN_OFF").alias("action_type"), F.col("day").cast("timestamp_ntz").alias("effective_at"), F.date_sub("day", 3).cast("timestamp_ntz").alias("announced_at"),
        F.date_add("day", F.when(order % 300 == 0, 2).otherwise(-1)).cast("timestamp_ntz").alias("ingested_at"), "provider", F.concat_ws("-", order, line, "l_suppkey", "l_extendedprice", "l_quantity").alias("source_identifier"), F.lit(0).alias("revision"),
        F.when(F.col("l_quantity") > 25, 2.0).otherwise(0.5).alias("ratio"), (F.col("l_quantity") / 10).alias("amount"),
    )
    out = adjusted.adjusted_parity(bars, actions, ["instrument_id", "y"])
    return out.select("instrument_id", "y", "status", F.array_join("reasons", ",").alias("reasons"), r6(F.col("vector_log"), "vector_log"), r6(F.col("event_log"), "event_log"), r6(F.col("exposure"), "exposure"))
