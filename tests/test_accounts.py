"""Marks to returns, calendars, the feature catalogue, readers' unions and sealed data sets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalogue, identity
from tidemark.operators import accounts
from tidemark.sources import readers


def test_nav_to_returns(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", t(1), t(1), 100.0, "r1"), ("a", t(3), t(2), 110.0, "r2"), ("a", t(3), t(4), 99.0, "r3"), ("a", t(5), t(9), 0.0, "r4"), ("a", t(6), t(6), 50.0, "r5"), ("b", t(1), t(1), 5.0, "x"), ("c", t(1), t(1), 5.0, "y"), ("c", t(2), t(2), 6.0, "y")]
    got = accounts.nav_to_returns(spark.createDataFrame(rows, "account_id string, observed_at timestamp, ingested_at timestamp, equity double, source_reference string"), "p").orderBy("account_id", "period_end", "ingested_at").collect()
    assert [(r.account_id, r.source_reference, r.issue) for r in got] == [("a", "r1->r2", None), ("a", "r2->r3", "non_increasing_account_performance_time"), ("a", "r3->r4", "invalid_account_equity"), ("a", "r4->r5", "invalid_account_equity"), ("c", "y->y", "duplicate_account_performance_snapshot")]
    assert got[0].return_fraction == pytest.approx(0.1) and got[0].ingested_at == t(3) and got[2].ingested_at == t(9) and got[1].return_fraction is None


def test_trading_sessions(spark):
    at = lambda *x: dt.datetime(2024, *x, tzinfo=dt.timezone.utc)
    sessions = spark.createDataFrame([("NY", d, 570, 960, "America/New_York") for d in range(5)] + [("TK", 0, 540, 900, "Asia/Tokyo")], "venue string, weekday int, opens_at int, closes_at int, zone string")
    holidays = spark.createDataFrame([("NY", dt.date(2024, 7, 4)), ("NY", dt.date(2024, 7, 4))], "venue string, holiday date")
    cases = [(1, "NY", at(7, 1, 13, 29), False), (2, "NY", at(7, 1, 13, 30), True), (3, "NY", at(1, 8, 13, 30), False), (4, "NY", at(1, 8, 14, 30), True), (5, "NY", at(7, 1, 20, 0), False), (6, "NY", at(7, 4, 15, 0), False), (7, "NY", at(7, 6, 15, 0), False), (8, "TK", at(6, 30, 23, 59), False), (9, "TK", at(7, 1, 0, 0), True), (10, "LN", at(7, 1, 12, 0), False)]
    moments = spark.createDataFrame([c[:3] for c in cases], "id int, venue string, observed_at timestamp")
    assert {r.id: r.is_open for r in accounts.trading_sessions(moments, "id", sessions, holidays).collect()} == {c[0]: c[3] for c in cases}


def test_catalogue(spark):
    known = catalogue.feature_catalogue(spark)
    assert known.groupBy("source").count().orderBy("source").collect() == [("FUNDAMENTALS", 6), ("MACRO", 5), ("OHLCV", 17)]
    more = known.where("name = 'sma'").withColumn("version", F.lit("2.0.0"))
    assert catalogue.feature_catalogue(spark, more).count() == 29
    with pytest.raises(ValueError, match="duplicate"):
        catalogue.feature_catalogue(spark, known.where("name = 'sma'"))
    with pytest.raises(ValueError, match="lookback"):
        catalogue.feature_catalogue(spark, more.withColumn("lookback", F.lit(-1)))


def test_combine_pages(spark):
    page = lambda k: spark.createDataFrame([(k, f"r{k}")], "id int, body string")
    got = readers.combine_pages([page(1), page(2).select("body", "id"), page(1)])
    assert sorted((r.id, r.body) for r in got.collect()) == [(1, "r1"), (1, "r1"), (2, "r2")]
    for pages in ([], [page(1)] * 3):
        with pytest.raises(ValueError):
            readers.combine_pages(pages, 2)


def test_seal_dataset(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "VALIDATED", t(2), t(1)), (2, "VALIDATED", t(3), t(2))]
    members = spark.createDataFrame(rows, "id int, status string, ingested_at timestamp, event_at timestamp")
    whole = readers.seal_dataset(members, str(tmp_path / "a"), identity.row_hash(members), F.lit(t(5))).first()
    assert (whole["rows"], whole.status, whole.violations, whole.valid_from, whole.valid_until) == (2, "SEALED", 0, t(1), t(2))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    again = readers.seal_dataset(members.repartition(3), str(tmp_path / "b"), identity.row_hash(members), F.lit(t(5))).first()
    assert again.digest == whole.digest
    late = readers.seal_dataset(members, str(tmp_path / "c"), identity.row_hash(members), F.lit(t(2))).first()
    assert (late.status, late.violations) == ("BLOCKED", 1) and not (tmp_path / "c").exists()
