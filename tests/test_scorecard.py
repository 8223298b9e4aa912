"""Held-out metrics and scores of short, flat and one-sided series; latency and stress reruns by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scorecard


def runs(spark, series):
    rows = [(k, "i", t, v, 1, 0) for k, vs in series.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "strategy string, instrument_id string, day int, net double, position int, turnover int")


def test_metrics_of_odd_series(spark):
    m = {r.strategy: r for r in scorecard.held_out_metrics(runs(spark, {"one": [0.1], "flat": [0.0] * 4, "up": [0.1, 0.2], "mixed": [0.1, -0.5, 0.2, -0.1, -0.1]})).collect()}
    assert (m["one"].sharpe, m["one"].win_loss_ratio, m["one"].max_drawdown, m["one"].max_drawdown_duration, m["one"].cagr) == (None, None, 0.0, 0, None)
    assert (m["flat"].sharpe, m["flat"].sortino, m["flat"].hit_rate, m["flat"].profit_factor, m["flat"].tail_ratio) == (None, None, 0.0, None, None)
    assert m["up"].sortino is None and m["up"].longest_wins == 2 and m["up"].payoff_ratio is None
    x = m["mixed"]
    curve = [1.0, 1.1, 0.55, 0.66, 0.594, 0.5346]
    downs = [e / max(curve[: k + 1]) - 1 for k, e in enumerate(curve)]
    assert (x.max_drawdown, x.average_drawdown, x.ulcer_index) == (pytest.approx(min(downs)), pytest.approx(sum(downs) / 6), pytest.approx(math.sqrt(sum(d * d for d in downs) / 6)))
    assert (x.max_drawdown_duration, x.longest_losses, x.longest_wins, x.value_at_risk, x.conditional_var, x.largest_win) == (4, 2, 1, -0.5, -0.5, 0.2)
    assert (x.payoff_ratio, x.profit_factor, x.win_loss_ratio, x.median) == (pytest.approx(0.15 / (0.7 / 3)), pytest.approx(0.3 / 0.7), pytest.approx(2 / 3), -0.1)


def test_absent_evidence_scores_nothing(spark):
    m = scorecard.held_out_metrics(runs(spark, {"flat": [0.0] * 4})).withColumns({"pessimistic_log_return": F.lit(None).cast("double"), "data_quality_score": F.lit(None).cast("double"), "parameters": F.lit(30)})
    r = scorecard.component_scores(m).first()
    assert (r.out_of_sample_sharpe, r.statistical_confidence, r.cost_robustness, r.data_quality, r.complexity_penalty) == (None,) * 4 + (0.0,)
    assert r.score == pytest.approx((0 + 100 + 0 + 2 + 100) / 5)


def test_latency_and_stress(spark):
    rows = [("s", "i", t, c, g) for t, (c, g) in enumerate([(100.0, 1), (110.0, 0), (99.0, 1), (120.0, 1)])]
    signals = spark.createDataFrame(rows, "strategy string, instrument_id string, day int, close double, signal int")
    late = {r.latency: r for r in scorecard.latency_sensitivity(signals, [0.0, 30.0], 24.0, 0.05, 0.0, 0.0).collect()}
    assert (late[0.0].bars, late[0.0].changed, late[0.0].log_degradation, late[0.0].passed) == (0, 0, 0.0, True)
    prompt, delayed = math.log(1.1 * 120 / 99), math.log(120 / 99)  # two bars late: held from the third bar on
    assert (late[30.0].bars, late[30.0].changed) == (2, 2) and late[30.0].log_degradation == pytest.approx(prompt - delayed) and not late[30.0].passed
    got = {r.scenario: r for r in scorecard.stress_runs(signals, [("calm", 0.0, 1.0), ("fall", -0.5, 2.0)], 0.0, 0.01, 0.0).collect()}
    assert got["calm"].log_return == pytest.approx(math.log((1.1 - 0.01) * (1 - 0.01) * (120 / 99 - 0.01))) and got["calm"].passed
    assert got["fall"].log_return == pytest.approx(math.log((1.1 - 0.02) * (1 - 0.02) * (60 / 99 - 0.02))) and not got["fall"].passed
    with pytest.raises(ValueError):
        scorecard.stress_runs(signals, [("cheap", 0.0, 0.5)], 0.0)


def test_activity(spark):
    rows = [("a", "i", t, p, 0) for t, p in enumerate([1, 1, 0, 1, 1, 1, 0])] + [("none", "i", t, 0, 0) for t in range(3)]
    m = {r.strategy: r for r in scorecard.activity_metrics(spark.createDataFrame(rows, "strategy string, instrument_id string, day int, position int, turnover int")).collect()}
    assert (m["a"].average_holding_period, m["a"].exposure, m["a"].average_holding_period_state) == (2.5, pytest.approx(5 / 7), "MEASURED")
    assert (m["none"].average_holding_period, m["none"].average_holding_period_state, m["none"].exposure) == (None, "UNAVAILABLE", 0.0)
