"""Market hours, regime rules, feature and fact materialisation, cost-value assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def market_open(moments: DataFrame, key: str, calendars: DataFrame, sessions: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``key, is_open, issue`` for moments (key, venue, observed_at in UTC, known_at).

    Sessions of the local day and of the day before count, as they may end after midnight. Calendars,
    sessions and exceptions count once ingested. Without exactly one calendar ``is_open`` is null.
    """
    known = F.col("ingested_at") <= F.col("known_at")
    day = F.to_date("observed_at")
    m = moments.join(calendars, (moments.venue == calendars.market) & known & (F.col("valid_from") <= day) & (F.col("valid_until").isNull() | (F.col("valid_until") > day)), "left").drop("ingested_at")
    m = m.withColumn("local", F.from_utc_timestamp(F.col("observed_at").cast("timestamp"), F.col("zone")).cast("timestamp_ntz"))
    m = m.withColumn("session_date", F.explode_outer(F.expr("array(date_sub(to_date(local), 1), to_date(local))"))).withColumn("weekday", F.weekday("session_date"))
    e = exceptions.withColumnRenamed("closes_at", "early").withColumnRenamed("ingested_at", "told_at")
    m = m.join(e, ["calendar_id", "session_date"], "left").withColumn("kind", F.when(F.col("told_at") <= F.col("known_at"), F.col("kind")))
    s = sessions.withColumnRenamed("ingested_at", "given_at")
    m = m.join(s, ["calendar_id", "weekday"], "left")
    at = lambda date, minutes: F.expr(f"cast({date} AS timestamp_ntz) + make_dt_interval(0, 0, {minutes}, 0)")
    closed = F.when(F.col("kind") == "EARLY_CLOSE", at("session_date", "early")).otherwise(at("date_add(session_date, close_day_offset)", "closes_at"))
    inside = (F.col("given_at") <= F.col("known_at")) & (F.coalesce("kind", F.lit("")) != "HOLIDAY") & (at("session_date", "opens_at") <= F.col("local")) & (F.col("local") < closed)
    got = m.groupBy(key).agg(F.count_distinct("calendar_id").alias("n"), F.bool_or(F.coalesce(inside, F.lit(False))).alias("open"))
    return got.select(key, F.when(F.col("n") == 1, F.col("open")).alias("is_open"), F.when(F.col("n") == 0, "calendar_not_found").when(F.col("n") > 1, "ambiguous_calendar").alias("issue"))


def aligned_features(features: DataFrame, keys: list[str], roles: dict[str, int]) -> DataFrame:
    """One column a role: the last value of its feature known and computed by ``event_at``, null unless validated."""
    seen = features.where("known_at <= event_at AND computed_at <= event_at")
    order = F.struct("known_at", "computed_at", "value")
    last = lambda f: F.max_by(F.when(F.col("status") == "VALIDATED", F.col("value")), F.when(F.col("feature_id") == f, order))
    return seen.groupBy(*keys, "event_at").agg(*(last(f).alias(role) for role, f in roles.items()))


def _clamp(x: Column, low: float = -1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), x))


def regime_rules(roles: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys, at, dimension, weights``: unnormalised weights of the states of eight dimensions, null where a role is."""
    w, c, one = Window.partitionBy(*keys).orderBy(at), F.col, F.lit(1.0)
    trend, stretch = _clamp(c("trend") / 0.05), _clamp(c("volatility") / 0.04, 0.0)
    level = lambda x: F.array(F.greatest(x, F.lit(0.01)), one)
    either = lambda first: F.array(F.when(first, one).otherwise(0.1), F.when(first, 0.1).otherwise(one))
    before = {x: F.lag(x).over(w) for x in ("volatility", "liquidity")}
    growth = F.coalesce((c("trend") >= 0) & (c("policy") <= 0), F.lit(False))
    cycle = F.when(c("inflation") >= 0, F.when(growth, 0).otherwise(1)).otherwise(F.when(growth, 2).otherwise(3))
    strains = [F.abs(c(x)) for x in ("credit", "currency", "commodity", "correlation")]
    crisis = sum((F.greatest(x - 0.5, F.lit(0.0)) for x in strains), F.lit(0.0))
    rules = {
        "TREND": (["trend"], F.array(F.greatest(trend, F.lit(0.0)), F.greatest(-trend, F.lit(0.0)), one - F.abs(trend))),
        "VOLATILITY_LEVEL": (["volatility"], level(c("volatility") / 0.02)),
        "VOLATILITY_DIRECTION": (["volatility", "volatility_before"], either(c("volatility") >= c("volatility_before"))),
        "LIQUIDITY_LEVEL": (["liquidity"], level(c("liquidity") / 1000000.0)),
        "LIQUIDITY_DIRECTION": (["liquidity", "liquidity_before"], either(c("liquidity") < c("liquidity_before"))),
        "RISK_APPETITE": (["trend", "volatility"], F.array(F.greatest(F.lit(0.01), one + trend - stretch), F.greatest(F.lit(0.01), one - trend + stretch))),
        "MACRO_CYCLE": (["inflation", "policy"], F.array(*(F.when(cycle == k, 0.7).otherwise(0.1) for k in range(4)))),
        "STRESS": (["credit", "currency", "commodity", "correlation"], F.array(one, *strains, crisis)),
    }
    rows = [F.struct(F.lit(name).alias("dimension"), F.when(sum((c(n).isNull().cast("int") for n in needs), F.lit(0)) == 0, weights).alias("weights")) for name, (needs, weights) in rules.items()]
    known = roles.select("*", *(x.alias(f"{n}_before") for n, x in before.items()))
    return known.select(*keys, at, F.explode(F.array(*rows)).alias("x")).select(*keys, at, "x.*")


def likeliest_state(rules: DataFrame) -> DataFrame:
    """With the first of the states of most weight, counted from 1, and its share."""
    most, total = F.array_max("weights"), F.expr("aggregate(weights, 0D, (a, x) -> a + x)")
    return rules.select("*", F.when(F.col("weights").isNotNull(), F.array_position("weights", most).cast("int")).alias("state"), F.when(total > 0, most / total).alias("probability")).drop("weights")


def regime_run_status(roles: DataFrame, key: str, required: list[str], health: DataFrame, measured: DataFrame) -> DataFrame:
    """``key, reasons, status`` of a run over all moments of a key, given health (key, health) and the keys measured out of sample."""
    gap = F.bool_or(F.greatest(*(F.col(r).isNull() for r in required)) if len(required) > 1 else F.col(required[0]).isNull())
    runs = roles.groupBy(key).agg(gap.alias("gap")).join(health, key, "left").join(measured.select(key).distinct().withColumn("measured", F.lit(True)), key, "left")
    reasons = F.concat_ws(",", F.when(F.col("gap"), "required_regime_feature_unavailable"), F.when(F.col("health") == "BLOCKED", "data_health_blocked"), F.when(F.col("measured").isNull(), "oos_regime_validation_unavailable"))
    return runs.select(key, reasons.alias("reasons"), F.when(reasons == "", "REVIEW_REQUIRED").otherwise("BLOCKED").alias("status"))


def materialize_features(bars: DataFrame, key: str, at: str, n: int, value: Column, least: float, most: float, decision: Column) -> DataFrame:
    """A feature over the last ``n`` bars of each row, with its sources' digest and whether it may be used.

    ``bars`` hold close, known_at and source; ``value`` is an expression over a window of n rows.
    """
    w = Window.partitionBy(key).orderBy(at).rowsBetween(1 - n, 0)
    held = bars.select(key, at, value.alias("value"), F.count(F.lit(1)).over(w).alias("inputs"), F.max("known_at").over(w).alias("last_known"), F.min("close").over(w).alias("lowest"), F.sha2(F.concat_ws(",", F.collect_list("source").over(w)), 256).alias("data_version"))
    status = (
        F.when(F.col("inputs") < n, "insufficient_or_invalid_bar_history").when(F.col("last_known") > decision, "feature_input_not_available_as_of_decision")
        .when(F.col("lowest") <= 0, "invalid_feature_bars").when((F.col("value") < least) | (F.col("value") > most), "feature_value_outside_expected_range").otherwise("VALIDATED")
    )
    return held.select(key, at, F.when(status == "VALIDATED", F.col("value")).alias("value"), "inputs", "data_version", status.alias("status"))


def facts_from_fundamentals(fundamentals: DataFrame, names: list[str], t: Column) -> DataFrame:
    """Facts filed, effective and ingested by ``t``, each with a reference to its source and an id made from that."""
    seen = fundamentals.where(F.col("fact_name").isin(names) & (F.col("filed_at") <= t) & (F.col("effective_at") <= t) & (F.col("ingested_at") <= t))
    reference = F.concat_ws(":", F.lit("fundamental"), "provider", "source_identifier", "revision")
    return seen.select("instrument_id", "fact_name", "value", "period_end", "effective_at", "ingested_at", "revision", reference.alias("source_reference"), F.sha2(F.concat_ws("|", "instrument_id", reference, F.col("period_end").cast("string")), 256).alias("fact_id"))


def cost_value(candidates: DataFrame) -> DataFrame:
    """With ``ratio, outcome, reason`` for candidates (cost, benefit, enabled, least_ratio, ai, plain_alternative); unusable amounts are invalid."""
    usable = F.coalesce((F.col("cost") >= 0) & (F.col("benefit") >= 0), F.lit(False))
    ratio = F.when(usable & (F.col("cost") > 0), F.col("benefit") / F.col("cost"))
    reason = (
        F.when(~usable, "invalid_cost_value_assessment_input").when(~F.coalesce("enabled", F.lit(False)), "cost_budget_policy_disabled")
        .when(F.col("ai") & F.col("plain_alternative"), "deterministic_code_preferred_over_ai_inference").when(ratio < F.col("least_ratio"), "minimum_value_to_cost_ratio_not_met")
    )
    outcome = F.when(~usable, "INVALID").when(reason == "cost_budget_policy_disabled", "BLOCKED_POLICY_DISABLED").when(reason.isNotNull(), "NOT_JUSTIFIED_REVIEW_REQUIRED").otherwise("JUSTIFIED_FOR_REVIEW")
    return candidates.select("*", ratio.alias("ratio"), outcome.alias("outcome"), reason.alias("reason"))
