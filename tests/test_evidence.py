"""Evidence pages, market hours, regime rules and materialisation on cases worked out by hand, nulls and empty tables."""

import json
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.sources import readers


def test_evidence_pages(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    good = {"metric": "debt", "value": "1.5", "unit": "USD", "observed_at": "2024-01-01T00:00:00+00:00", "available_at": "2024-01-02T00:00:00Z", "source_identifier": "a", "source_url": "https://x/1"}
    facts = [good, good | {"instrument_id": "B"}, good | {"source_url": "http://x"}, good | {"observed_at": "2024-01-01T00:00:00"}, good | {"value": "n/a"}, good | {"revision": 3}]
    with open(f"{folder}/page.json", "w") as f:
        f.write(json.dumps({"facts": facts, "next_cursor": None}) + "\n" + json.dumps({"facts": []}))
    got = readers.read_evidence_pages(spark, f"{folder}/page.json", "A", "p").collect()
    assert sorted((r.issue or "", r.revision) for r in got) == [("", 0), ("", 3), ("instrument_mismatch", 0), ("invalid_fact", 0), ("source_url_requires_https", 0), ("time_without_zone", 0)]
    assert {r.instrument_id for r in got} == {"A", "B"}


def hours(spark, moments):
    calendars = spark.sql("SELECT 1 AS calendar_id, 'X' AS market, 'America/New_York' AS zone, DATE '2020-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_until, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS ingested_at")
    sessions = spark.sql("SELECT 1 AS calendar_id, w AS weekday, 1320 AS opens_at, 300 AS closes_at, 1 AS close_day_offset, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS ingested_at FROM (SELECT explode(array(0, 1, 2, 3, 4)) AS w)")
    days = "VALUES (1, DATE '2024-01-16', 'HOLIDAY', CAST(NULL AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00'), (1, DATE '2024-01-17', 'EARLY_CLOSE', 1380, TIMESTAMP_NTZ '2024-01-17 12:00:00')"
    exceptions = spark.sql(f"SELECT * FROM {days} AS t(calendar_id, session_date, kind, closes_at, ingested_at)")
    df = spark.createDataFrame(moments, "id int, venue string, at string, known string").select("id", "venue", F.col("at").cast("timestamp_ntz").alias("observed_at"), F.col("known").cast("timestamp_ntz").alias("known_at"))
    return {r.id: (r.is_open, r.issue) for r in evidence.market_open(df, "id", calendars, sessions, exceptions).collect()}


def test_market_open(spark):
    late = "2024-02-01 00:00:00"
    got = hours(spark, [
        (1, "X", "2024-01-16 08:00:00", late),  # 03:00 on Tuesday: Monday's session still runs
        (2, "X", "2024-01-17 04:00:00", late),  # 23:00 on Tuesday, a holiday
        (3, "X", "2024-01-18 04:30:00", late),  # 23:30 on Wednesday, closed early at 23:00
        (4, "X", "2024-01-18 04:30:00", "2024-01-17 00:00:00"),  # before that was known
        (5, "Y", "2024-01-18 04:30:00", late), (6, None, "2024-01-18 04:30:00", late), (7, "X", None, late),
        (8, "X", "2024-01-18 03:00:00", late), (8, "X", "2024-01-18 03:00:00", late),
    ])
    missing = (None, "calendar_not_found")
    assert got == {1: (True, None), 2: (False, None), 3: (False, None), 4: (True, None), 5: missing, 6: missing, 7: missing, 8: (True, None)}
    assert hours(spark, []) == {}


def test_regime_rules(spark):
    names = ["trend", "volatility", "liquidity", "inflation", "policy", "credit", "currency", "commodity", "correlation"]
    rows = [("a", 1, 0.025, 0.04, 5e5, -0.1, 0.0, 0.2, 0.9, 0.1, 0.1), ("a", 2, None, 0.02, 1e6, None, 0.0, 0.2, 0.9, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "k string, t int, " + ", ".join(f"{n} double" for n in names))
    rules = evidence.regime_rules(df, ["k"], "t")
    got = {(r.t, r.dimension): r.weights for r in rules.collect()}
    assert got[1, "TREND"] == pytest.approx([0.5, 0, 0.5]) and got[2, "TREND"] is None
    assert got[1, "VOLATILITY_LEVEL"] == pytest.approx([2, 1]) and got[1, "VOLATILITY_DIRECTION"] is None
    assert got[2, "VOLATILITY_DIRECTION"] == [0.1, 1] and got[2, "LIQUIDITY_DIRECTION"] == [0.1, 1]
    assert got[1, "RISK_APPETITE"] == pytest.approx([0.5, 1.5])
    assert got[1, "MACRO_CYCLE"] == [0.1, 0.1, 0.7, 0.1] and got[2, "MACRO_CYCLE"] is None
    assert got[1, "STRESS"] == pytest.approx([1, 0.2, 0.9, 0.1, 0.1, 0.4])
    assert {(r.t, r.dimension): r.state for r in evidence.likeliest_state(rules).collect()}[1, "TREND"] == 1
    assert evidence.regime_rules(df.limit(0), ["k"], "t").count() == 0


def test_materialized_features(spark):
    bars = spark.createDataFrame([("a", n, float(c), k, f"s{n}") for n, (c, k) in enumerate([(1, 1), (3, 1), (9, 1), (1, 9), (-1, 1)])], "k string, t int, close double, known_at int, source string")
    got = evidence.materialize_features(bars, "k", "t", 2, F.avg("close").over(Window.partitionBy("k").orderBy("t").rowsBetween(-1, 0)), 0.0, 5.0, F.lit(5)).orderBy("t").collect()
    assert [r.status for r in got] == ["insufficient_or_invalid_bar_history", "VALIDATED", "feature_value_outside_expected_range", "feature_input_not_available_as_of_decision", "feature_input_not_available_as_of_decision"]
    assert [r.value for r in got] == [None, 2.0, None, None, None] and len({r.data_version for r in got}) == 5


def test_cost_value(spark):
    rows = [(10.0, 20.0, True, True, False), (10.0, 20.0, True, True, True), (10.0, 5.0, True, False, True), (0.0, 5.0, True, False, True), (10.0, 20.0, None, False, False), (None, 1.0, True, False, False)]
    df = spark.createDataFrame([(n, *r, 1.5) for n, r in enumerate(rows)], "n int, cost double, benefit double, enabled boolean, ai boolean, plain_alternative boolean, least_ratio double")
    got = [r.outcome for r in evidence.cost_value(df).orderBy("n").collect()]
    assert got == ["JUSTIFIED_FOR_REVIEW", "NOT_JUSTIFIED_REVIEW_REQUIRED", "NOT_JUSTIFIED_REVIEW_REQUIRED", "JUSTIFIED_FOR_REVIEW", "BLOCKED_POLICY_DISABLED", "INVALID"]
