"""Evidence packages: what is missing, what was changed, and whether a package may be promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import row_hash, set_digest

#: The evidence that a package needs, in order.
REQUIRED = ("data_quality", "oos_walk_forward", "golden_reconciliation", "execution_realism", "capacity", "slippage", "latency", "bootstrap", "monte_carlo", "stress", "parameter_stability", "multiple_testing", "scorecard")
#: Kinds whose stored type must be their name.
TYPED = ("data_quality", "oos_walk_forward", "golden_reconciliation", "execution_realism", "scorecard")
#: What measures that do not pass mean, by kind.
WEAK = {
    "capacity": "capacity_liquidity_limit_exceeded", "slippage": "slippage_sensitivity_exceeds_tolerance", "latency": "latency_signal_decay_failed", "stress": "stress_evidence_weak",
    "parameter_stability": "parameter_stability_narrow_peak", "multiple_testing": "multiple_testing_not_passed",
}


def required_kinds(packages: DataFrame, package: str, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each package and required kind, with its ``place``; ``more`` may add kinds but take none away."""
    kinds = tuple(dict.fromkeys(REQUIRED + more))
    return packages.select(package, F.posexplode(F.array(*map(F.lit, kinds))).alias("place", "kind"))


def evidence_gaps(packages: DataFrame, links: DataFrame, package: str) -> DataFrame:
    """``package, missing, malformed, complete``: required kinds without a link, in order, and kinds whose hash is no SHA-256.

    ``links``: package, kind, evidence_id, evidence_hash. A link without an id counts as none.
    """
    held = links.where("evidence_id IS NOT NULL").groupBy(package, "kind").agg(F.bool_and(F.coalesce(F.col("evidence_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("formed"))
    each = required_kinds(packages, package).join(held, [package, "kind"], "left")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", "kind")))), lambda x: x["kind"])  # noqa: E731  one entry a kind
    out = each.groupBy(package).agg(listed(F.col("formed").isNull()).alias("missing"), listed(~F.col("formed")).alias("malformed"))
    return out.withColumn("complete", (F.size("missing") == 0) & (F.size("malformed") == 0))


def evidence_integrity(artifacts: DataFrame, payload: list[str], stored: str) -> DataFrame:
    """``artifacts`` with ``content_hash``, worked out anew from the payload's columns, and ``intact``: it is the stored one."""
    return artifacts.withColumn("content_hash", row_hash(artifacts, payload)).withColumn("intact", F.coalesce(F.col("content_hash") == F.col(stored), F.lit(False)))


def package_hashes(links: DataFrame, package: str) -> DataFrame:
    """``package, members, package_hash`` over its (kind, evidence_id, evidence_hash), whatever their order."""
    hashed = links.select(package, row_hash(links, ["kind", "evidence_id", "evidence_hash"]).alias("_h"))
    return set_digest(hashed, [package], "_h").select(package, F.col("rows").alias("members"), F.col("digest").alias("package_hash"))


def promotion(cards: DataFrame, packages: DataFrame, links: DataFrame, artifacts: DataFrame, as_of, most_days: int, least_sharpe: float, least_periods: int, least_return: float, more: tuple[str, ...] = ()) -> DataFrame:
    """``card_id, package_id, reasons, status``: REVIEW_REQUIRED without reasons, else BLOCKED; nothing is ever activated.

    ``cards``: card_id, package_id, strategy, dataset, features, cost_model, probabilistic_sharpe,
    engines_agree, held_out_periods, held_out_return. ``packages``: package_id, strategy, dataset,
    features, cost_model, package_hash. ``artifacts``: evidence_id, kind, strategy, dataset,
    evaluated_at, passed, measures_pass, stored_hash, content_hash. Reasons come in fixed order: the
    package's binding and hash, each required kind's, then those of the card. A card whose package is
    unknown has that one reason. Unknown figures of a card are below their thresholds.
    """
    # dealt by package once: its hash, its kinds and its cards need no other shuffle
    links = links.where("package_id IS NOT NULL").select("package_id", "kind", "evidence_id", "evidence_hash").repartition("package_id")
    p = packages.select("package_id", *(F.col(c).alias(f"p_{c}") for c in ("strategy", "dataset", "features", "cost_model", "package_hash")))
    bound = cards.join(p, "package_id", "left").join(package_hashes(links, "package_id").select("package_id", F.col("package_hash").alias("made_hash")), "package_id", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    of_package = F.array_compact(F.array(
        F.when(differs("strategy"), "validation_package_strategy_mismatch"), F.when(differs("dataset"), "validation_package_dataset_mismatch"), F.when(differs("features"), "validation_package_feature_mismatch"),
        F.when(differs("cost_model"), "validation_package_cost_model_mismatch"), F.when(~F.col("p_package_hash").eqNullSafe(F.col("made_hash")), "validation_package_content_hash_mismatch"),
    ))
    of_card = F.array_compact(F.array(
        F.when(~F.coalesce("engines_agree", F.lit(False)), "cross_engine_reconciliation_failed"),
        F.when(~F.coalesce(F.col("probabilistic_sharpe").between(0, 1), F.lit(False)), "invalid_probabilistic_sharpe").when(F.col("probabilistic_sharpe") < least_sharpe, "probabilistic_sharpe_below_threshold"),
        F.when(F.coalesce("held_out_periods", F.lit(0)) < least_periods, "insufficient_held_out_periods").when(~F.coalesce(F.col("held_out_return") >= least_return, F.lit(False)), "held_out_return_below_threshold"),
    ))
    kinds = tuple(dict.fromkeys(REQUIRED + more))
    one = links.groupBy("package_id", "kind").agg(F.min(F.struct("evidence_id", "evidence_hash")).alias("l")).select("package_id", "kind", "l.*")
    a = artifacts.select("evidence_id", *(F.col(c).alias(f"a_{c}") for c in ("kind", "strategy", "dataset", "evaluated_at", "passed", "measures_pass", "stored_hash", "content_hash")))
    asked = bound.where("p_package_hash IS NOT NULL").select("card_id", "package_id", "strategy", "p_dataset")
    # only kinds with a link travel; those without one are told apart when a card's kinds are listed, which leaves out kinds that nobody asked for
    linked = one.where(F.col("evidence_id").isNotNull()).join(asked, "package_id")
    each = linked.join(a, "evidence_id")
    typed = F.col("kind").isin(*TYPED)
    stale = F.col("a_evaluated_at") < as_of - F.expr(f"INTERVAL {most_days} DAY")
    # each reason's name for a kind and when it holds, in order; a link's are one number, so that a card's kinds are sums of bits and no texts travel
    told = (
        ("{}_strategy_mismatch", ~F.col("a_strategy").eqNullSafe(F.col("strategy"))), ("{}_dataset_mismatch", ~F.col("a_dataset").eqNullSafe(F.col("p_dataset"))),
        ("invalid_{}_timestamp", F.col("a_evaluated_at").isNull()), ("{}_evidence_stale", stale), ("invalid_{}_evidence", typed & ~F.col("a_kind").eqNullSafe(F.col("kind"))),
        ("{}_content_hash_mismatch", ~F.col("a_content_hash").eqNullSafe(F.col("a_stored_hash")) | ~F.col("a_stored_hash").eqNullSafe(F.col("evidence_hash"))),
        ("{}_failed", F.col("a_passed") == F.lit(False)), ("weak", ~F.coalesce("a_measures_pass", F.lit(False))),
    )
    bits = F.lit(1 << len(told))  # found
    for place, (_, holds) in enumerate(told):
        bits = bits + F.when(holds, 1 << place).otherwise(0)
    coded = each.select("card_id", "kind", bits.alias("bits"))
    given = coded.groupBy("card_id").agg(*(F.bit_or(F.when(F.col("kind") == n, F.col("bits"))).alias(f"_k{i}") for i, n in enumerate(kinds)))

    def of_kind(i: int, n: str):
        names = [WEAK.get(n) if form == "weak" else form.format(n) for form, _ in told]
        present = F.array_compact(F.array(*(F.when(F.col(f"_k{i}").bitwiseAND(1 << place) > 0, name) for place, name in enumerate(names) if name)))
        return F.when(F.col(f"_k{i}").isNull(), F.array(F.lit(f"missing_{n}_evidence"))).otherwise(present)

    joined = bound.join(given, "card_id", "left").withColumn("of_kinds", F.flatten(F.array(*(of_kind(i, n) for i, n in enumerate(kinds)))))
    reasons = F.when(F.col("p_package_hash").isNull(), F.array(F.lit("missing_validation_package"))).otherwise(F.array_distinct(F.concat(of_package, "of_kinds", of_card)))
    return joined.withColumn("reasons", reasons).select("card_id", "package_id", "reasons", F.when(F.size("reasons") > 0, "BLOCKED").otherwise("REVIEW_REQUIRED").alias("status"))
