"""Point-in-time research reads, split and evidence checks, and record comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.validation import benjamini_hochberg, normal_cdf


def visible(df: DataFrame, t: Column, *times: str) -> DataFrame:
    """Rows of which every given time is known and at or before ``t``."""
    for c in times:
        df = df.where(F.col(c) <= t)
    return df


def latest_visible(df: DataFrame, keys: list[str], t: Column, times: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` among those visible at ``t``, all columns.

    An aggregation, so copies of a key are combined before the shuffle; ``order`` should be unique
    within a key, else any of the last rows may come out.
    """
    rest = [c for c in df.columns if c not in keys]
    best = visible(df, t, *times).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(*keys, "last.*")


def research_rows(observations: DataFrame, datasets: DataFrame, sources: DataFrame, instruments: DataFrame, t: Column, latest_adjusted: bool = False) -> DataFrame:
    """Leakage-safe rows: of sealed datasets, permitted sources and known instruments, validated, and known at ``t``.

    One row for each (source_id, instrument_id, kind, event_at): the latest revision. Rows adjusted
    with later knowledge (``adjustment`` LATEST_ADJUSTED) come in only on request. The three small
    sides are joined without hints, so their sizes decide how.
    """
    rows = visible(observations, t, "effective_at", "known_at").where("status = 'VALIDATED'")
    if not latest_adjusted:
        rows = rows.where("adjustment <> 'LATEST_ADJUSTED'")
    rows = rows.join(visible(datasets, t, "sealed_at").where("sealed").select("dataset_id"), "dataset_id", "left_semi")
    rows = rows.join(sources.where("permitted").select("source_id"), "source_id", "left_semi").join(instruments.select("instrument_id"), "instrument_id", "left_semi")
    return latest_visible(rows, ["source_id", "instrument_id", "kind", "event_at"], t, [], ["revision", "known_at", "value"])


def chronological_splits(lengths: DataFrame, key: str, train: float, validation: float) -> DataFrame:
    """``train_end, validation_end, n`` of series of n periods cut in time order; each part has at least one period."""
    n = F.col("n")
    a = F.greatest(F.lit(1), F.floor(n * train))
    b = F.least(n - 1, F.greatest(a + 1, F.floor(n * (train + validation))))
    return lengths.where(n >= 3).select(key, a.cast("int").alias("train_end"), b.cast("int").alias("validation_end"), n.cast("int").alias("n"))


def multiple_testing(tests: DataFrame, outcomes: DataFrame, family: str, trials: int) -> DataFrame:
    """Evidence for each test: discovery by false-discovery rate, probabilistic and deflated Sharpe, overfitting share.

    ``tests`` has family, name, p, sharpe; ``outcomes`` has family, name, passed (one row for each
    held-out run). ``trials`` variants were tried for each test, and the best of so many null trials
    is expected to reach a Sharpe of sqrt(2 ln trials).
    """
    found = benjamini_hochberg(tests, family, "name", "p", 0.05)
    tried = F.count(F.lit(1)).over(Window.partitionBy(family)) * trials
    runs = outcomes.groupBy(family, "name").agg(F.count(F.lit(1)).alias("runs"), F.avg((~F.col("passed")).cast("double")).alias("overfitting"))
    both = found.withColumn("expected", F.when(tried > 1, F.sqrt(2 * F.log(tried))).otherwise(0.0)).join(runs, [family, "name"])
    scale = F.sqrt(F.greatest(F.lit(2), F.col("runs")) - 1)
    out = both.withColumn("probabilistic", normal_cdf(F.col("sharpe") * scale)).withColumn("deflated", normal_cdf((F.col("sharpe") - F.col("expected")) * scale))
    return out.withColumn("passed", F.col("discovery") & (F.col("overfitting") <= 0.5) & (F.col("deflated") >= 0.5))


def compare_records(left: DataFrame, right: DataFrame, key: str, order: list[str], exact: list[str], near: dict[str, float]) -> DataFrame:
    """Differences of two execution logs, matched by position within ``key``: ``key, position, difference``.

    A record that only one side has is MISSING_LEFT or MISSING_RIGHT; else the first column that
    differs is named, exact ones before those with a tolerance.
    """
    w = Window.partitionBy(key).orderBy(*order)
    a = left.withColumn("position", F.row_number().over(w)).select(key, "position", F.struct(*exact, *near).alias("a"))
    b = right.withColumn("position", F.row_number().over(w)).select(key, "position", F.struct(*exact, *near).alias("b"))
    both = a.join(b, [key, "position"], "full_outer")
    kinds = [(F.col("a").isNull(), "MISSING_LEFT"), (F.col("b").isNull(), "MISSING_RIGHT")]
    kinds += [(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c.upper()) for c in exact]
    kinds += [(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance, c.upper()) for c, tolerance in near.items()]
    difference = F.coalesce(*(F.when(c, F.lit(n)) for c, n in kinds))
    return both.select(key, "position", difference.alias("difference")).where("difference IS NOT NULL")


def reconcile_engines(left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """``keys, measure, left, right`` where two engines' results differ by more than a measure's tolerance; a missing one is 0."""
    names = list(values)
    rows = left.select(*keys, *(F.col(n).cast("double") for n in names)).unpivot(keys, names, "measure", "left").join(
        right.select(*keys, *(F.col(n).cast("double") for n in names)).unpivot(keys, names, "measure", "right"), [*keys, "measure"], "full_outer"
    )
    tolerance = F.create_map(*(x for n, v in values.items() for x in (F.lit(n), F.lit(v))))[F.col("measure")]
    return rows.fillna(0.0, ["left", "right"]).where(F.abs(F.col("left") - F.col("right")) > tolerance)


def projected_exposures(positions: DataFrame, orders: DataFrame, prices: DataFrame, keys: list[str], instrument: str) -> DataFrame:
    """Quantity and notional by key after open orders: positions and signed orders are added up, then priced.

    An instrument without a price has a null notional and is not ``priced``.
    """
    both = positions.select(*keys, instrument, "quantity", F.lit(0.0).alias("ordered")).unionByName(orders.select(*keys, instrument, F.lit(0.0).alias("quantity"), F.col("quantity").alias("ordered")))
    total = both.groupBy(*keys, instrument).agg(F.sum("quantity").alias("held"), F.sum("ordered").alias("ordered"))
    priced = total.join(prices.select(instrument, "price"), instrument, "left").withColumn("projected", F.col("held") + F.col("ordered"))
    return priced.withColumn("notional", F.col("projected") * F.col("price")).withColumn("priced", F.col("price").isNotNull())


def screen(requests: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``requests`` with ``reasons`` (failed checks in the given order) and APPROVE or REJECT; an unknown outcome fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    return requests.withColumn("reasons", F.array_join(failed, ",")).withColumn("decision", F.when(F.size(failed) == 0, "APPROVE").otherwise("REJECT"))


def research_candidates(assessments: DataFrame) -> DataFrame:
    """``assessments`` (status, credibility) with an action that never raises confidence, and its ceiling.

    Withdrawn evidence withdraws, blocked or unknown evidence reduces, any other maintains; only
    what maintains carries its credibility.
    """
    status = F.coalesce("status", F.lit("BLOCKED"))
    action = F.when(status == "WITHDRAWN", "WITHDRAW").when(status == "BLOCKED", "REDUCE").otherwise("MAINTAIN")
    return assessments.withColumn("action", action).withColumn("maximum_confidence", F.when(F.col("action") == "MAINTAIN", F.col("credibility")).otherwise(F.lit(0.0)))


def promotion_eligible(requests: DataFrame, scorecards: DataFrame, links: DataFrame, packages: DataFrame) -> DataFrame:
    """``requests`` with ``eligible``: whether the named scorecard stands, as asked for, on verified evidence.

    A scorecard counts when a linked package has the content hash that the link recorded and is
    VERIFIED, the scorecard waits for review, its data is not blocked, and strategy, dataset and
    cost model are the ones requested. A request for an unknown scorecard is not eligible.
    """
    sound = links.join(packages.where("integrity_status = 'VERIFIED'").select("package_id", "content_hash"), "package_id").where("content_hash = package_content_hash")
    cards = scorecards.where("status = 'REVIEW_REQUIRED' AND health_status <> 'BLOCKED'").join(sound.select("scorecard_id").distinct(), "scorecard_id", "left_semi")
    bound = ["scorecard_id", "strategy_version", "dataset_version", "cost_model_version"]
    found = cards.select(*bound, F.lit(True).alias("found")).distinct()
    return requests.join(found, bound, "left").withColumn("eligible", F.coalesce("found", F.lit(False))).drop("found")


def analysis_status(evidence: DataFrame) -> DataFrame:
    """``evidence`` (quality, valuation, drift, breached, health) with ordered ``reasons`` and READY or BLOCKED.

    A missing measure is unavailable evidence; missing health counts as blocked.
    """
    named = (
        ("company_quality_unavailable", F.col("quality").isNull()), ("valuation_unavailable", F.col("valuation").isNull()), ("thesis_drift_unavailable", F.col("drift").isNull()),
        ("thesis_invalidation_breached", F.coalesce("breached", F.lit(False))), ("data_health_blocked", F.coalesce(F.col("health") != "HEALTHY", F.lit(True))),
    )
    failed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named)))
    return evidence.withColumn("reasons", F.array_join(failed, ",")).withColumn("status", F.when(F.size(failed) == 0, "READY").otherwise("BLOCKED"))
