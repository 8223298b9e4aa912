"""Steps whose cost grows with the rows: hot keys in ranges, one exchange where one is enough, no Python for small keys."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import execution, promotion, quality
from tidemark.plans import content
from tidemark.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def book(fills):
    q = c = cash = 0.0
    for x, p in fills:
        new = q + x
        c = 0.0 if new == 0 else (c * q + p * x) / new if q * x >= 0 else c if q * new > 0 else p
        q, cash = new, cash - x * p
    return q, c, cash


def test_positions_of_small_keys_stay_in_the_engine_and_full_bins_go_by_ranges(spark):
    rng = random.Random(5)
    rows = [(k, t, float(rng.choice([-3, -2, -1, 1, 2, 3])), float(rng.randint(90, 110))) for k, n in (("hot", 60), ("b", 3), (None, 2), ("d", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "a string, t int, signed double, price double")
    want = {k: book([r[2:] for r in rows if r[0] == k]) for k in ("hot", "b", None, "d")}
    for most in (1000, 10):
        out = execution.positions(df, ["a"], ["t"], 4, bin_fills=most)
        assert ("MapInArrow" in plan(out)) == (most == 10)
        got = {r.a: (r.quantity, r.average_cost, r.cash) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_arrival_order_of_one_key_lies_in_ranges(spark):
    rng = random.Random(7)
    rows = [(k, n, rng.randint(0, 30), 1.0) for k, n in [("x", n) for n in range(50)] + [(None, n) for n in range(20)] + [("y", 3)]]
    df = spark.createDataFrame(rows, "k string, n int, t int, p double").withColumns({c: F.col("p") for c in ("open", "high", "low", "close", "volume")})
    want, back = {}, set()
    for k, n, t, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < n]
        late = bool(before) and t <= max(before, key=lambda r: r[1])[2]
        want[k, n] = ["duplicate_bar"] * any(r[2] == t for r in before) + ["time_regression"] * late
        if before and t < max(before, key=lambda r: r[1])[2]:
            back.add((k, n, max(before, key=lambda r: r[1])[2]))
    for ranges in (1, 7):
        out = quality.assess_bars(df, "k", "t", ["n"], ranges)
        assert {(r.k, r.n): r.flags for r in out.collect()} == want
        assert {(r.k, r.n, r.previous) for r in quality.regressions(df, "k", "t", ["n"], ranges).collect()} == back


def test_capture_deals_rows_by_key_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    known, none = jobs.capture(rows.where("k = 3 OR v = 'b'"), None, ["k"])
    assert plan(known).count("Exchange") == 1 and none.count() == 0
    fresh, conflicts = jobs.capture(rows, known, ["k"])
    assert [tuple(r) for r in fresh.select("k", "v").collect()] == [(2, "c")]
    assert [tuple(r) for r in conflicts.select("k", "v").collect()] == [(1, "a")]
    told = {(r.k, r.v): r.outcome for r in jobs.judged(rows, known, ["k"]).collect()}
    assert told == {(1, "a"): "CONFLICT", (1, "b"): "KNOWN", (2, "c"): "INSERT", (3, "d"): "KNOWN"}


def test_promotion_moves_only_linked_kinds(spark):
    """Kinds without a link are listed where the card is: nothing is exploded and no null id is joined; an id with two artifacts has the reasons of both."""
    kinds = promotion.REQUIRED
    links = spark.createDataFrame([(1, k, n, "h") for n, k in enumerate(kinds) if k != "stress"] + [(2, "latency", None, "h")], "package_id int, kind string, evidence_id int, evidence_hash string")
    packages = promotion.package_hashes(links, "package_id").select("package_id", "package_hash").withColumns({c: F.lit("s") for c in ("strategy", "dataset", "features", "cost_model")})
    cards = packages.select(F.col("package_id").alias("card_id"), "package_id", "strategy", "dataset", "features", "cost_model", F.lit(0.9).alias("probabilistic_sharpe"), F.lit(True).alias("engines_agree"), F.lit(99).alias("held_out_periods"), F.lit(0.1).alias("held_out_return"))
    arts = [(n, k, "s", "s", 10, True, True, "h", "h") for n, k in enumerate(kinds) if k != "slippage"] + [(kinds.index("latency"), "latency", "x", "s", 10, True, False, "h", "h")]
    artifacts = spark.createDataFrame(arts, "evidence_id int, kind string, strategy string, dataset string, d int, passed boolean, measures_pass boolean, stored_hash string, content_hash string").withColumn("evaluated_at", F.timestamp_seconds(F.col("d") * 86400))
    out = promotion.promotion(cards, packages, links, artifacts, F.timestamp_seconds(F.lit(20 * 86400)), 30, 0.5, 20, 0.0)
    assert "Generate" not in plan(out)
    got = {r.card_id: r.reasons for r in out.collect()}
    assert got[1] == ["missing_slippage_evidence", "latency_strategy_mismatch", "latency_signal_decay_failed", "missing_stress_evidence"]
    assert got[2] == [f"missing_{k}_evidence" for k in kinds]


def test_promotion_deals_links_by_package_once(spark, sf_dir, monkeypatch):
    """Hash, kinds and cards of a package share one exchange of its links; hashes travel as bytes, and lines are dealt before they are hashed."""
    tables, write = {}, content.staged
    monkeypatch.setattr(content, "staged", lambda df, label: tables.setdefault(label, (df, write(df, label)))[1])
    out = content.v21(spark, sf_dir)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan(out))
    assert dealt and not any("package_id" in x and "kind" in x for x in dealt)
    made, links = tables["links"]
    assert links.schema["now"].dataType["h"].dataType.simpleString() == "binary"
    text = made._jdf.queryExecution().optimizedPlan().toString()  # from the last step to the first
    assert 0 < text.index("sha2") < text.index("RepartitionByExpression")
    differs = links.where("was IS NOT NULL")
    assert differs.where("was = now OR NOT sealed").count() == 0 and differs.count() > 0
