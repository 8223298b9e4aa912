"""Golden values worked out by hand, prefix invariance, readers."""

import json
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import features, identity
from tidemark.operators import asof, backtest, execution, portfolio
from tidemark.sources import readers


def series(spark, closes, signal):
    rows = [("s", "i", k, float(c), s) for k, (c, s) in enumerate(zip(closes, signal, strict=True))]
    return spark.createDataFrame(rows, "strategy string, instrument_id string, day int, close double, signal int")


def test_signal_is_held_in_the_next_period(spark):
    run = backtest.vector_backtest(series(spark, [100, 110, 121], [1, 0, 0]), rate=0.0, spread=0.0)
    report = backtest.performance_report(backtest.equity_curve(run)).first()
    assert report.total_return == pytest.approx(0.1) and report.turnover == 2 and report.periods == 2


def test_log_growth_of_a_series_that_lost_nearly_all(spark):
    run = backtest.vector_backtest(series(spark, [2.0**-k for k in range(61)], [1] * 61), rate=0.0, spread=0.0)
    report = backtest.performance_report(backtest.equity_curve(run)).first()
    assert report.log_growth == pytest.approx(60 * math.log(0.5), rel=1e-12)


def test_costs_reduce_returns(spark):
    bars = series(spark, [100, 110, 90, 121], [1, 0, 1, 0])
    total = lambda r: backtest.performance_report(backtest.equity_curve(backtest.vector_backtest(bars, rate=r))).first().total_return
    assert total(0.01) < total(0.0)


def test_tail_loss_and_gross_net(spark):
    r = spark.createDataFrame([("a", k, v) for k, v in enumerate([-0.05, -0.03, 0.01, 0.02])], "k string, day int, r double")
    row = portfolio.var_cvar(r, "k", "r", 0.5).first()
    assert (row["var"], row["cvar"]) == (pytest.approx(0.03), pytest.approx(0.04))
    e = spark.createDataFrame([("p", 600.0), ("p", -100.0)], "k string, notional double")
    assert tuple(portfolio.gross_and_net(e, "k").first()) == ("p", 700.0, 500.0)


def test_reservation_lets_a_later_small_order_fit(spark):
    o = spark.createDataFrame([("a", k, v) for k, v in enumerate([60.0, 50.0, 30.0, 20.0])], "a string, k int, v double")
    assert [r.accepted for r in portfolio.reserve(o, ["a"], ["k"], "v", 100.0).orderBy("k").collect()] == [True, False, True, False]


def test_positions_flip(spark):
    fills = [("a", "i", 1, 1, 10.0, 100.0), ("a", "i", 2, 2, 10.0, 110.0), ("a", "i", 3, 3, -5.0, 120.0), ("a", "i", 4, 4, -20.0, 90.0)]
    row = execution.positions(spark.createDataFrame(fills, "account_id string, instrument_id string, occurred_at int, fill_id int, signed double, price double"), ["account_id", "instrument_id"], ["occurred_at", "fill_id"]).first()
    assert (row.quantity, row.average_cost, row.cash) == (-5.0, 90.0, -1000 - 1100 + 600 + 1800)


def test_as_of_join_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x", 1), ("a", 5, "y", 2), ("a", 5, "z", 3), ("a", 6, "w", 4)], "k string, t int, v string, seq int")
    got = asof.as_of_join(left, right, "k", "t", "t", ["v"], "seq")
    assert {(r.id, r.v) for r in got.collect()} == {(1, "z"), (2, None), (3, None)}


def test_features_do_not_see_the_future(spark):
    bars = spark.range(60).select(F.lit("i").alias("instrument_id"), F.col("id").alias("day"), (100 + F.sin("id") * 9).alias("close"), F.lit(110.0).alias("high"), F.lit(90.0).alias("low"), F.lit(5.0).alias("volume"))
    makes = [features.change(5), features.sma(7), features.ema(5), features.breakout(6), features.slope(8), features.volatility(9), features.downside(9), features.amihud(5)]
    run = lambda b: features.with_basics(b).select("day", *(F.round(m, 9).alias(f"f{k}") for k, m in enumerate(makes)))
    assert run(bars.where("day < 40")).exceptAll(run(bars).where("day < 40")).count() == 0


def test_digest_ignores_order_and_partitions(spark):
    rows = spark.range(1000).select("id", F.lit(1).alias("g"))
    rows = rows.withColumn("h", identity.row_hash(rows))
    one = identity.set_digest(rows.repartition(1), ["g"], "h").first()
    assert identity.set_digest(rows.orderBy(F.desc("id")).repartition(7), ["g"], "h").first() == one and one["rows"] == 1000
    assert identity.set_digest(rows.where("id > 0"), ["g"], "h").first().digest != one.digest


def test_readers(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/bars.csv", "w") as f:
        f.write("date,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n2024-07-02,1,2,1,0,10\n2024-07-03,1,2,1,3,10\n")
    bars = readers.read_daily_bars_csv(spark, f"{folder}/bars.csv", "America/New_York", "16:00:00", "2024-01-01", "2024-12-31")
    assert sorted(str(r.event_at) for r in bars.collect()) == ["2024-01-02 21:00:00", "2024-07-03 20:00:00"]
    with open(f"{folder}/page.json", "w") as f:
        obs = [{"observation_id": "1", "account_id": "a", "period_start": "2024-01-01T00:00:00Z", "period_end": "2024-01-02T00:00:00Z", "return_fraction": 0.1}, {"observation_id": "2", "account_id": "a", "return_fraction": -2.0}]
        f.write(json.dumps({"observations": obs, "next_cursor": "x"}))
    assert sorted((r.observation_id, r.valid) for r in readers.read_return_pages(spark, f"{folder}/page.json").collect()) == [("1", True), ("2", False)]
    with open(f"{folder}/facts.json", "w") as f:
        units = {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 5.0, "filed": "2024-02-01", "form": "10-K", "accn": "1"}]}
        f.write(json.dumps({"entityName": "E", "facts": {"gaap": {"Revenue": {"label": "r", "units": units}, "Other": {"label": "o", "units": units}}}}))
    wanted = spark.createDataFrame([("Revenue",)], "concept string")
    row = readers.read_company_facts(spark, f"{folder}/facts.json", wanted).collect()
    assert len(row) == 1 and str(row[0].available_at) == "2024-02-02" and row[0].value == 5.0
