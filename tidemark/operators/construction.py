"""Portfolio construction: risk without pairs, and the largest scale that keeps every limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.controls import capped_weights
from tidemark.operators.ranges import running_sums
from tidemark.sources.staging import staged


def component_risk(returns: DataFrame, portfolio: str, sleeve: str, time: str, value: str, weight: str, uncertainty: float = 0.0) -> DataFrame:
    """``portfolio, sleeve, volatility, marginal, component`` over all times of the portfolio.

    With p the portfolio's own return, the sum of its weighted sleeves at a time, the covariance of a
    sleeve with the portfolio is its covariance with p, so no pair of sleeves is formed: one row for
    each (sleeve, time) meets one row for each time. A sleeve without a print at a time did not move.
    Correlations may be moved towards 1 by ``uncertainty`` s: with sleeve deviations d the covariance
    matrix becomes ``(1 - s) C + s d d'``. Components add up to the volatility; without any
    volatility marginal and component risk are 0. Null values count as no print.
    """
    x = returns.where(F.col(value).isNotNull()).select(portfolio, sleeve, time, F.col(value).alias("_r"), F.col(weight).alias("_w"))
    at = x.groupBy(portfolio, time).agg(F.sum(F.col("_r") * F.col("_w")).alias("_p"))
    each = x.join(at, [portfolio, time])
    sums = each.groupBy(portfolio, sleeve).agg(F.first("_w").alias("_w"), F.sum("_r").alias("_r"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.sum(F.col("_r") * F.col("_p")).alias("_rp"))
    whole = at.groupBy(portfolio).agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_p"))
    own = sums.join(whole, portfolio).withColumns({
        "_dev": F.sqrt(F.greatest(F.lit(0.0), F.col("_rr") / F.col("_n") - F.pow(F.col("_r") / F.col("_n"), F.lit(2)))),
        "_cov": F.col("_rp") / F.col("_n") - F.col("_r") * F.col("_p") / F.col("_n") / F.col("_n"),
    })
    devs = own.groupBy(portfolio).agg(F.sum(F.col("_w") * F.col("_dev")).alias("_wd"), F.sum(F.col("_w") * F.col("_cov")).alias("_variance"))
    s = uncertainty
    joined = own.join(devs, portfolio).withColumn("volatility", F.sqrt(F.greatest(F.lit(0.0), (1 - s) * F.col("_variance") + s * F.col("_wd") * F.col("_wd"))))
    marginal = F.when(F.col("volatility") > 0, ((1 - s) * F.col("_cov") + s * F.col("_dev") * F.col("_wd")) / F.col("volatility")).otherwise(0.0)
    return joined.withColumn("marginal", marginal).select(portfolio, sleeve, F.col("_w").alias("weight"), "volatility", "marginal", (F.col("_w") * F.col("marginal")).alias("component"))


def gross_bounds(sleeves: DataFrame, portfolio: str, sleeve: str, target: str, present: str, limit: str) -> DataFrame:
    """``portfolio, bound, feasible``: the largest scale s with ``sum |s * target + present| <= limit``, and whether s = 0 keeps it.

    The sum is convex and piecewise linear in s, so it is the greatest of its lines, and keeping the
    limit means keeping it on each line that rises. Its slope changes by 2 |target| where a sleeve
    crosses zero, at -present / target: running sums over these places give every line, and the
    bound is the least of the places where a line reaches the limit. A bound may be above 1.
    """
    a, b = F.col(target), F.col(present)
    whole = sleeves.groupBy(portfolio).agg(F.sum(F.abs(b)).alias("at_0"), F.sum(F.when(b == 0, F.abs(a)).otherwise(F.signum(b) * a)).alias("slope_0"), F.max(limit).alias("cap"))
    turn = -b / a
    places = sleeves.where((a != 0) & (turn > 0)).select(portfolio, sleeve, turn.alias("t"), (2 * F.abs(a)).alias("bend"))
    swept = running_sums(places, [portfolio], ["t", sleeve], {"slope": F.col("bend"), "back": F.col("bend") * F.col("t")})
    first = whole.select(portfolio, F.lit(0.0).alias("slope"), F.lit(0.0).alias("back"))
    lines = swept.select(portfolio, "slope", "back").unionByName(first).join(whole, portfolio)
    rise = F.col("slope_0") + F.col("slope")
    reach = F.when(rise > 0, (F.col("cap") - F.col("at_0") + F.col("back")) / rise)
    found = lines.groupBy(portfolio).agg(F.min(reach).alias("reach"), F.first(F.col("at_0") <= F.col("cap")).alias("feasible"))
    return found.select(portfolio, F.when(F.col("feasible"), F.coalesce("reach", F.lit(float("inf")))).otherwise(0.0).alias("bound"), "feasible")


def linear_bounds(loads: DataFrame, keys: list[str], target: str, present: str, limit: str) -> DataFrame:
    """``keys, bound, feasible`` for limits on ``|s * target + present|``, summed by key before."""
    a, b, cap = F.col("a"), F.col("b"), F.col("cap")
    by = loads.groupBy(*keys).agg(F.sum(target).alias("a"), F.sum(present).alias("b"), F.max(limit).alias("cap"))
    bound = F.when(a > 0, (cap - b) / a).when(a < 0, (cap + b) / -a).otherwise(F.lit(float("inf")))
    feasible = F.abs(b) <= cap
    return by.select(*keys, F.when(feasible, bound).otherwise(0.0).alias("bound"), feasible.alias("feasible"))


def safe_scale(sleeves: DataFrame, loads: DataFrame, portfolio: str, sleeve: str, target: str, present: str) -> DataFrame:
    """``portfolio, scale, feasible, binding``: the largest scale in [0, 1] of the targets under which every limit is kept.

    ``sleeves`` has the columns gross_limit and net_limit; ``loads`` (portfolio, sleeve, limit_name,
    load, cap) has one row for each group or factor of a sleeve. ``binding`` names, in order, the
    limits that hold the scale below 1; a limit that present weights break already makes the scale 0.
    """
    gross = gross_bounds(sleeves, portfolio, sleeve, target, present, "gross_limit").withColumn("limit_name", F.lit("gross"))
    net = linear_bounds(sleeves, [portfolio], target, present, "net_limit").withColumn("limit_name", F.lit("net"))
    each = loads.join(sleeves.select(portfolio, sleeve, F.col(target).alias("_a"), F.col(present).alias("_b")), [portfolio, sleeve])
    each = each.select(portfolio, "limit_name", (F.col("_a") * F.col("load")).alias("_a"), (F.col("_b") * F.col("load")).alias("_b"), "cap")
    named = linear_bounds(each, [portfolio, "limit_name"], "_a", "_b", "cap")
    every = gross.unionByName(net).unionByName(named.select(*gross.columns))
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("bound")))
    held = F.array_sort(F.collect_set(F.when(F.col("bound") < 1, F.col("limit_name"))))  # one entry a limit, not a sleeve
    return every.groupBy(portfolio).agg(F.bool_and("feasible").alias("feasible"), scale.alias("scale"), held.alias("binding")).select(portfolio, F.when(F.col("feasible"), F.col("scale")).otherwise(0.0).alias("scale"), "feasible", "binding")


#: What makes a sleeve unfit, and what reduced it, in order.
ELIGIBILITY = {
    "scorecard_not_review_eligible": "NOT coalesce(scorecard_status = 'REVIEW_REQUIRED', false)", "validation_package_not_verified": "NOT coalesce(validation_integrity = 'VERIFIED', false)",
    "regime_candidate_blocked": "NOT coalesce(regime_status = 'REVIEW_REQUIRED', false)", "regime_risk_increase_prohibited": "NOT coalesce(regime_proposed <= regime_current, false)",
}


def construct(sleeves: DataFrame, returns: DataFrame, loads: DataFrame, health: DataFrame, policy: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Multi-strategy construction runs: one row a portfolio, and one a sleeve.

    ``sleeves``: portfolio, sleeve, signal, score, regime_current, regime_proposed, capacity,
    liquidity, drawdown, decay, scorecard_status, validation_integrity, regime_status,
    delta_multiplier, pending, fx. ``returns``: portfolio, sleeve, time, r. ``loads``: see
    ``safe_scale``. ``health``: portfolio, health. ``policy``: maximum_sleeve, minimum_liquidity,
    maximum_drawdown, minimum_decay, uncertainty, target_volatility, maximum_gross, maximum_net,
    stress_shock, maximum_stress.

    Unfit sleeves and blocked data make all targets 0 and the run BLOCKED. Else magnitudes are capped
    by risk weights, reduced by regime and capacity or disabled, scaled to the target volatility under
    moved correlations, and scaled again by the largest safe scale. Volatility is proportional to the
    targets, so it is worked out once. An independent gate then sums the effective weights anew.
    Reasons come in order: data, sleeves, aggregate limits, gate. A sleeve without returns has no
    volatility; a portfolio without health is blocked.
    """
    p = policy
    unfit = F.array_compact(F.array(*(F.when(F.expr(c), F.concat("sleeve", F.lit(f":{n}"))) for n, c in ELIGIBILITY.items())))
    s = sleeves.withColumn("unfit", unfit).join(health, "portfolio", "left")
    gate = s.groupBy("portfolio").agg(
        F.bool_or(~F.coalesce(~F.col("health").isin("BLOCKED", "UNAVAILABLE"), F.lit(False))).alias("no_data"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("unfit") > 0, F.struct("sleeve", "unfit")))), lambda x: x["unfit"])).alias("unfit_all"),
    )  # fmt: skip  # only sleeves that are unfit are gathered, as the run names each of them
    gate = gate.withColumn("blocked", F.col("no_data") | (F.size("unfit_all") > 0))
    weights = capped_weights(s.select("portfolio", "sleeve", "score"), "portfolio", "sleeve", "score", p["maximum_sleeve"]).select("portfolio", "sleeve", "weight")
    s = s.join(weights, ["portfolio", "sleeve"]).join(gate.select("portfolio", "blocked"), "portfolio")
    regime = F.least(F.lit(1.0), F.col("regime_proposed") / F.col("regime_current"))
    changes = {
        "regime_reduction": regime < 1, "capacity_reduction": F.col("capacity") < 1, "liquidity_disabled": F.col("liquidity") < p["minimum_liquidity"],
        "drawdown_disabled": F.col("drawdown") > p["maximum_drawdown"], "signal_decay_disabled": F.col("decay") < p["minimum_decay"],
    }
    off = changes["liquidity_disabled"] | changes["drawdown_disabled"] | changes["signal_decay_disabled"] | F.col("blocked")
    s = s.withColumns({"base": F.when(off, 0.0).otherwise(F.signum("signal") * F.col("weight") * regime * F.col("capacity")), "changed": F.array_compact(F.array(*(F.when(c, n) for n, c in changes.items())))})
    s = staged(s, "sleeves")
    moved = returns.join(s.select("portfolio", "sleeve", F.col("base").alias("w")), ["portfolio", "sleeve"])
    risk = staged(component_risk(moved, "portfolio", "sleeve", "time", "r", "w", p["uncertainty"]), "risk")
    of_portfolio = risk.groupBy("portfolio").agg(F.max("volatility").alias("stressed"))
    s = s.join(of_portfolio, "portfolio", "left").join(risk.select("portfolio", "sleeve", "marginal"), ["portfolio", "sleeve"], "left").fillna(0.0, ["stressed", "marginal"])
    s = s.withColumn("vol_scale", F.when(F.col("stressed") > 0, F.least(F.lit(1.0), p["target_volatility"] / F.col("stressed"))).otherwise(1.0))
    s = staged(s.withColumns({"a": F.col("base") * F.col("vol_scale") * F.col("delta_multiplier"), "b": F.col("pending") + F.col("fx"), "gross_limit": F.lit(p["maximum_gross"]), "net_limit": F.lit(p["maximum_net"])}), "scaled")
    safe = staged(safe_scale(s, loads, "portfolio", "sleeve", "a", "b"), "safe")
    s = s.join(safe, "portfolio").withColumns({"target": F.col("base") * F.col("vol_scale") * F.col("scale"), "effective": F.col("a") * F.col("scale") + F.col("b")})
    s = staged(s, "targets")
    # the gate: limits summed anew from the effective weights
    slack = 1e-9
    sums = s.groupBy("portfolio").agg(F.sum(F.abs("effective")).alias("gross"), F.sum("effective").alias("net"), F.max(F.abs("effective")).alias("largest"), F.first("stressed").alias("stressed_before"), F.first("vol_scale").alias("vol_scale"))
    by_limit = loads.join(s.select("portfolio", "sleeve", "effective"), ["portfolio", "sleeve"]).groupBy("portfolio", "limit_name").agg(F.abs(F.sum(F.col("effective") * F.col("load"))).alias("held"), F.max("cap").alias("cap"))
    broken = by_limit.where(F.col("held") > F.col("cap") + slack).groupBy("portfolio").agg(F.array_sort(F.collect_set("limit_name")).alias("broken"))
    run = sums.join(gate, "portfolio").join(safe, "portfolio").join(broken, "portfolio", "left").withColumn("broken", F.coalesce("broken", F.array().cast("array<string>")))
    over = (F.col("gross") > p["maximum_gross"] + slack) | (F.abs("net") > p["maximum_net"] + slack)
    failed = F.array_compact(F.concat(
        F.array(F.when(F.col("gross") > p["maximum_gross"] + slack, "gross_exposure_limit"), F.when(F.abs("net") > p["maximum_net"] + slack, "net_exposure_limit"), F.when(F.col("largest") > p["maximum_sleeve"] + slack, "single_weight_limit"), F.when(-F.col("net") * p["stress_shock"] > p["maximum_stress"] + slack, "stress_loss_limit")),
        F.transform("broken", lambda n: F.concat(F.lit("limit:"), n)),
    ))
    reasons = F.array_compact(F.concat(
        F.array(F.when(F.col("no_data"), "portfolio_data_health_blocked")), "unfit_all",
        F.array(F.when(~F.col("feasible"), "pending_or_fx_hidden_leverage_exceeds_policy"), F.when(over | (F.size("broken") > 0), "aggregate_constraints_not_satisfied")),
        F.transform(failed, lambda n: F.concat(F.lit("independent_risk_gate:"), n)),
    ))
    final = F.col("stressed_before") * F.col("vol_scale") * F.col("scale")
    run = run.withColumn("reasons", reasons).select("portfolio", F.when(F.size("reasons") > 0, "BLOCKED").otherwise("REVIEW_REQUIRED").alias("status"), "reasons", "gross", "net", (1 - F.col("net")).alias("cash"), final.alias("stressed_volatility"), "vol_scale", F.col("scale").alias("aggregate_scale"), "binding")
    why = F.concat("changed", F.array_compact(F.array(F.when(F.col("vol_scale") < 1, "target_volatility_reduction"), F.when(F.col("scale") < 1, "aggregate_constraint_reduction"))))
    each = s.select("portfolio", "sleeve", "target", "effective", F.when(F.col("target") == 0, 0.0).otherwise(F.col("target") * F.col("marginal")).alias("component"), F.array_join(why, ",").alias("reasons"))
    return run, each
