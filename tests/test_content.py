"""Digests, evidence packages, narrative windows and incremental ingestion."""

import datetime as dt
import hashlib
import json
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import identity
from tidemark.operators import narratives, promotion
from tidemark.sources import ingest


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, 1.5, None, 'a"b', dt.datetime(2024, 1, 2, 3, 4, 5, 60), True, [2.0, None], (1, 0.25))], "z long, y double, x string, w string, t timestamp_ntz, b boolean, l array<double>, s struct<q:int,p:double>")
    text = df.select(identity.canonical_json(df)).first()[0]
    assert text == '{"b":true,"l":["2",null],"s":{"p":"0.25","q":1},"t":"2024-01-02 03:04:05.000060","w":"a\\"b","x":null,"y":"1.5","z":1}'
    assert df.select(identity.row_hash(df)).first()[0] == hashlib.sha256(text.encode()).hexdigest()
    assert json.loads(text)["z"] == 1


def test_set_digest_counts_repeats(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    rows = df.withColumn("h", identity.row_hash(df, ["id"]))
    digest = lambda x: {r.g: (r.rows, r.digest) for r in identity.set_digest(x, ["g"], "h").collect()}
    one = digest(rows.repartition(1))
    assert digest(rows.orderBy(F.desc("id")).repartition(9)) == one
    twice = digest(rows.unionByName(rows.where("id = 3")))
    assert twice[0] != one[0] and twice[1] == one[1]
    swapped = digest(rows.where("id <> 3").unionByName(rows.where("id = 6")))  # as many rows, one of them again
    assert swapped[0][0] == one[0][0] and swapped[0] != one[0]
    empty = identity.table_fingerprint(df.where("id < 0")).first()
    assert empty["rows"] == 0 and len(empty.digest) == 64


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("z", 4), ("z", 4)], "v string, k int")
    got = identity.compare_tables(a, b).first()
    assert (got.rows_a, got.rows_b, got.same, got.only_a, got.only_b) == (4, 4, False, 2, 2)
    assert identity.compare_tables(a, a.repartition(3)).first().same
    empty = identity.compare_tables(a.where("k > 9"), b.where("k > 9")).first()
    assert (empty.rows_a, empty.same) == (0, True)
    assert sorted((r.k, r.v, r.side) for r in identity.differing_rows(a, b).collect()) == [(1, "x", "a"), (3, "y", "a"), (4, "z", "b"), (4, "z", "b")]
    with pytest.raises(ValueError):
        identity.compare_tables(a, b.drop("v"))


NOW = dt.datetime(2024, 6, 1)


def package(spark, change=None):
    """One card with a whole package; ``change`` alters the rows before they are made tables."""
    art = [{"evidence_id": k, "kind": kind, "strategy": "s", "dataset": "d", "evaluated_at": NOW - dt.timedelta(days=5), "passed": True, "measures_pass": True, "body": f"b{k}"} for k, kind in enumerate(promotion.REQUIRED)]
    card = {"card_id": 1, "package_id": 1, "strategy": "s", "dataset": "d", "features": "f", "cost_model": "c", "probabilistic_sharpe": 0.99, "engines_agree": True, "held_out_periods": 100, "held_out_return": 0.1}
    schema = "evidence_id int, kind string, strategy string, dataset string, evaluated_at timestamp, passed boolean, measures_pass boolean, body string"
    stored = spark.createDataFrame(art, schema)
    stored = stored.withColumn("stored_hash", identity.row_hash(stored, ["body"]))
    links = stored.select(F.lit(1).alias("package_id"), "kind", "evidence_id", F.col("stored_hash").alias("evidence_hash"))
    packages = promotion.package_hashes(links, "package_id").select("package_id", "package_hash").withColumns({c: F.lit(card[c]) for c in ("strategy", "dataset", "features", "cost_model")})
    parts = {"card": card, "links": links, "artifacts": stored, "packages": packages}
    if change:
        change(parts)
    cards = spark.createDataFrame([parts["card"]], "card_id int, package_id int, strategy string, dataset string, features string, cost_model string, probabilistic_sharpe double, engines_agree boolean, held_out_periods int, held_out_return double")
    seen = promotion.evidence_integrity(parts["artifacts"], ["body"], "stored_hash")
    row = promotion.promotion(cards, parts["packages"], parts["links"], seen, F.lit(NOW), 30, 0.95, 60, 0.0).first()
    return row.reasons, row.status


def test_promotion_reasons(spark):
    assert package(spark) == ([], "REVIEW_REQUIRED")
    alter = lambda name, f: lambda parts: parts.update({name: f(parts[name])})
    cases = {
        "package_id": (alter("card", lambda c: c | {"package_id": 7}), ["missing_validation_package"]),
        "binding": (alter("card", lambda c: c | {"features": "g", "cost_model": None}), ["validation_package_feature_mismatch", "validation_package_cost_model_mismatch"]),
        "payload": (alter("artifacts", lambda a: a.withColumn("body", F.when(F.col("kind") == "capacity", "other").otherwise(F.col("body")))), ["capacity_content_hash_mismatch"]),
        "link": (alter("links", lambda x: x.where("kind <> 'stress'")), ["validation_package_content_hash_mismatch", "missing_stress_evidence"]),
        "gone": (alter("artifacts", lambda a: a.where("kind <> 'latency'")), ["missing_latency_evidence"]),
        "old": (alter("artifacts", lambda a: a.withColumn("evaluated_at", F.when(F.col("kind") == "slippage", F.lit(NOW - dt.timedelta(days=40))).when(F.col("kind") == "bootstrap", None).otherwise(F.col("evaluated_at")))), ["slippage_evidence_stale", "invalid_bootstrap_timestamp"]),
        "weak": (alter("artifacts", lambda a: a.withColumn("measures_pass", ~F.col("kind").isin("capacity", "scorecard")).withColumn("passed", F.col("kind") != "scorecard")), ["capacity_liquidity_limit_exceeded", "scorecard_failed"]),
        "type": (alter("artifacts", lambda a: a.withColumn("kind", F.lit("x"))), [f"invalid_{k}_evidence" for k in promotion.TYPED]),
        "card": (alter("card", lambda c: c | {"probabilistic_sharpe": None, "engines_agree": False, "held_out_periods": 3}), ["cross_engine_reconciliation_failed", "invalid_probabilistic_sharpe", "insufficient_held_out_periods"]),
    }
    for name, (change, want) in cases.items():
        assert package(spark, change) == (want, "BLOCKED"), name


def test_evidence_gaps(spark):
    packages = spark.createDataFrame([(1,), (2,)], "p int")
    links = spark.createDataFrame([(1, k, n, "0" * 64 if k != "stress" else "nohash") for n, k in enumerate(promotion.REQUIRED)] + [(2, "latency", None, "0" * 64)], "p int, kind string, evidence_id int, evidence_hash string")
    got = {r.p: r for r in promotion.evidence_gaps(packages, links, "p").collect()}
    assert (got[1].missing, got[1].malformed, got[1].complete) == ([], ["stress"], False)
    assert got[2].missing == list(promotion.REQUIRED)


def test_narrative_figures_half_way_are_rounded_as_in_sql(spark):
    folder = tempfile.mkdtemp(dir="/tmp")
    events = duckdb.connect()
    events.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/events.parquet' WHERE event_type IN ('click', 'signup')) TO '{folder}/events.parquet'")
    events.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()["t10_narrative_windows"](spark, folder).orderBy("topic", "window_start")
    want = events.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['t10_narrative_windows']}) ORDER BY topic, window_start").fetchall()
    assert [tuple(r) for r in df.collect()] == want  # to the last digit


def test_narratives_of_few_posts(spark):
    post = lambda topic, day, author, s, **x: {"topic": topic, "author": author, "published_at": dt.datetime(2024, 1, day, 5), "sentiment": s, "bot": 0.9, "emotion": None, "spam": 0.9, "coordination": 0.9, "influence": 0.0, "discussion_class": "AUTOMATED_SPAM", "language": "en", "geography": None, "flagged": False} | x
    schema = "topic string, author int, published_at timestamp, sentiment double, bot double, emotion double, spam double, coordination double, influence double, discussion_class string, language string, geography string, flagged boolean"
    posts = spark.createDataFrame([post("a", 1, 1, 0.5), post("a", 1, 1, -0.5), post("a", 1, 2, 0.0), post("a", 3, 3, 1.0, flagged=True)], schema)
    day = lambda d: dt.datetime(2024, 1, d)
    health = spark.createDataFrame([("a", day(1), "HEALTHY")], "topic string, window_start timestamp, health string")
    prices = spark.createDataFrame([("a", day(1), 5.0)], "topic string, window_start timestamp, price_return double")
    one, two = narratives.narrative_metrics(posts, "1 day", health, prices).orderBy("window_start").collect()
    assert (one.mention_volume, one.unique_authors, one.sentiment, one.emotion, one.influencer_concentration, one.divergence, one.persistence, one.emerging, one.categories, one.geographies) == (3, 2, 0.0, 0.0, 0.0, 1.0, 0.0, True, "AUTOMATED_SPAM:3", "")
    assert one.disagreement == pytest.approx(1 / 3)
    assert one.reasons == ["COORDINATED_PROMOTION_LIKELY", "NO_PRIOR_BASELINE", "PUMP_AND_DUMP_RISK_HIGH", "SPAM_CONCENTRATION_HIGH"] and one.status == "BLOCKED"
    assert (two.mention_acceleration, two.author_growth, two.sentiment_change, two.persistence) == (pytest.approx(-2 / 3), -0.5, 1.0, 1.0)
    assert "DATA_HEALTH_BLOCKED" in two.reasons and "INSUFFICIENT_OBSERVATIONS" in two.reasons and "UNTRUSTED_CONTENT_SANITIZED" in two.reasons
    assert narratives.narrative_metrics(posts.where("author > 9"), "1 day", health, prices).collect() == []


class Inbox:
    def __init__(self, spark, tmp):
        self.spark, self.box, self.store = spark, str(tmp / "inbox"), str(tmp / "store")
        os.makedirs(self.box)

    def land(self, name, cursor, following, records, at="2024-06-01T00:00:00", **x):
        page = {"source_id": "src", "provider_version": "v1", "retrieved_at": at, "cursor": cursor, "next_cursor": following, "records": [{"id": i, "body": b} for i, b in records]} | x
        with open(f"{self.box}/.{name}", "w") as f:
            f.write(page if isinstance(page, str) else json.dumps(page))
        os.rename(f"{self.box}/.{name}", f"{self.box}/{name}.json")

    def run(self, hours=1, most=5):
        return ingest.ingest_incremental(self.spark, self.box, self.store, "id int, body string", ["id"], "src", "all", dt.timedelta(days=2), NOW + dt.timedelta(hours=hours), most)

    def rows(self, table="rows"):
        return self.spark.read.parquet(f"{self.store}/{table}")

    def ledger(self):
        return [(r.state, r.resume_cursor, r.captured_count, r.error_code) for r in self.rows("ledger").orderBy("run").collect()]


def test_ingest_resumes(spark, tmp_path):
    box = Inbox(spark, tmp_path)
    assert box.run() == "IDLE"
    box.land("p1", None, "c1", [(1, "a"), (2, "b"), (2, "b")])
    box.land("p3", "c2", None, [(4, "d")])
    assert box.run() == "ERROR"  # the page between has not landed
    assert box.ledger() == [("ERROR", "c1", 2, "provider_page_missing")]
    box.land("p2", "c1", "c2", [(3, "c"), (1, "other")])
    assert box.run(2) == "HEALTHY"
    assert sorted((r.id, r.body) for r in box.rows().collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert [(r.id, r.body) for r in box.rows("conflicts").collect()] == [(1, "other")]
    assert box.ledger()[1] == ("HEALTHY", None, 2, None)
    assert box.run(3) == "IDLE" and len(box.ledger()) == 2
    box.land("p4", None, None, [(1, "a"), (5, "e")], at="2024-05-01T00:00:00")
    assert box.run(4) == "STALE" and box.ledger()[2] == ("STALE", None, 1, None)
    latest = ingest.latest_run(spark, f"{box.store}/ledger", "src", "all", NOW + dt.timedelta(hours=2, minutes=30))
    assert latest.state == "HEALTHY" and ingest.latest_run(spark, f"{box.store}/ledger", "src", "none") is None


def test_ingest_errors(spark, tmp_path):
    def state(name, *pages, most=5):
        box = Inbox(spark, tmp_path / name)
        for k, (cursor, following, x) in enumerate(pages):
            box.land(f"q{k}", cursor, following, [(k, "x")], **x)
        return box.run(most=most), box.ledger()[-1]

    loop = state("loop", (None, "a", {}), ("a", "b", {}), ("b", "a", {}))
    assert loop == ("ERROR", ("ERROR", "b", 3, "provider_pagination_cursor_loop"))
    assert state("most", (None, "a", {}), ("a", "b", {}), ("b", None, {}), most=2)[1] == ("ERROR", "b", 2, "provider_pagination_limit_exceeded")
    assert state("version", (None, "a", {}), ("a", None, {"provider_version": " "}))[1] == ("ERROR", "a", 1, "invalid_provider_version")
    assert state("source", (None, None, {"source_id": "else"}))[1] == ("ERROR", None, 0, "page_source_mismatch")
    assert state("time", (None, None, {"retrieved_at": "2030-01-01T00:00:00"}))[1][3] == "invalid_retrieved_at"
    box = Inbox(spark, tmp_path / "broken")
    box.land("ok", None, "a", [(1, "x")])
    with open(f"{box.box}/bad.json", "w") as f:
        f.write('{"source_id": "src", "cursor": "a", "reco')
    assert box.run() == "ERROR" and box.ledger() == [("ERROR", "a", 1, "malformed_provider_page")]


def test_ingest_killed_at_any_place(spark, tmp_path, monkeypatch):
    """A run that dies after each of its writes is started again and adds nothing twice."""
    real = ingest._append_once
    for place in ("pages", "passed", "ledger"):
        box = Inbox(spark, tmp_path / place)
        box.land("p1", None, "c1", [(1, "a"), (2, "b")])
        box.land("p2", "c1", None, [(3, "c"), (1, "z")])

        def dies(rows, path, number, place=place):
            real(rows, path, number)
            if path.endswith(place):
                raise RuntimeError("killed")

        monkeypatch.setattr(ingest, "_append_once", dies)
        with pytest.raises(Exception, match="killed"):
            box.run()
        monkeypatch.setattr(ingest, "_append_once", real)
        assert box.run() == "HEALTHY"
        assert sorted((r.id, r.body) for r in box.rows().collect()) == [(1, "a"), (2, "b"), (3, "c")]
        assert box.rows("conflicts").count() == 1 and box.rows("pages").count() == 2 and box.rows("passed").count() == 2
        assert box.ledger() == [("HEALTHY", None, 3, None)]
