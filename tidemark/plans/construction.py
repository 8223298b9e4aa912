"""Queries on portfolio risk without pairs and on the largest safe scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import construction
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.staging import staged
from tidemark.sources.views import table, with_views

# pairs, spelled out: covariances over all days, with no move where there is no print
_FULL = with_views("returns") + """, t AS (SELECT count(DISTINCT day) AS n FROM returns), i AS (SELECT instrument_id, sum(r) / max(n) AS m, count(*) OVER () AS k FROM returns, t GROUP BY 1),
x AS (SELECT a.instrument_id AS i, b.instrument_id AS j, sum(a.r * b.r) AS s FROM returns a JOIN returns b USING (day) GROUP BY 1, 2),
c AS (SELECT p.instrument_id AS i, q.instrument_id AS j, coalesce(s, 0) / n - p.m * q.m AS cov, p.k AS k FROM i p CROSS JOIN i q CROSS JOIN t LEFT JOIN x ON x.i = p.instrument_id AND x.j = q.instrument_id)"""


def _equal(spark, d):
    r = views.returns(spark, d)
    n = r.agg(F.count_distinct("instrument_id").alias("n"))
    return r.crossJoin(n).select(F.lit("all").alias("portfolio"), "instrument_id", "day", "r", (1 / F.col("n")).alias("w"))  # n is one row


@query("p13_portfolio_volatility", _FULL + " SELECT round(sqrt(sum(cov) / max(k * k)), 8) AS volatility FROM c")
def p13(spark, d):
    return construction.component_risk(_equal(spark, d), "portfolio", "instrument_id", "day", "r", "w").agg(F.round(F.max("volatility"), 8).alias("volatility"))


@query("p19_component_risk", _FULL + """, d AS (SELECT i, sqrt(cov) AS dev FROM c WHERE i = j), st AS (SELECT c.i, c.j, k, CASE WHEN c.i = c.j THEN cov ELSE cov + 0.25 * (a.dev * b.dev - cov) END AS cov FROM c JOIN d a ON a.i = c.i JOIN d b ON b.i = c.j),
m AS (SELECT i, sum(cov) / max(k) AS s, max(k) AS k FROM st GROUP BY 1) SELECT i AS instrument_id, round(s / sqrt(sum(s / k) OVER ()), 8) AS marginal, round(s / k / sqrt(sum(s / k) OVER ()), 8) AS component FROM m""")
def p19(spark, d):
    """Under correlations moved a quarter of the way to 1."""
    out = construction.component_risk(_equal(spark, d), "portfolio", "instrument_id", "day", "r", "w", 0.25)
    return out.select("instrument_id", F.round("marginal", 8).alias("marginal"), F.round("component", 8).alias("component"))


@query("p17_safe_scale", """WITH s AS (SELECT o_custkey AS p, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS a, CASE o_orderstatus WHEN 'F' THEN 0.1 * o_totalprice WHEN 'O' THEN -0.1 * o_totalprice ELSE 0 END AS b, o_orderpriority AS g, (o_orderkey % 5 - 2) / 2.0::DOUBLE AS f FROM orders),
pt AS (SELECT DISTINCT p, t FROM (SELECT p, 0.0::DOUBLE AS t FROM s UNION ALL SELECT p, 1.0 FROM s UNION ALL SELECT p, -b / a FROM s WHERE a <> 0 AND -b / a > 0 AND -b / a < 1)),
v AS (SELECT pt.p, t, sum(abs(t * a + b)) AS v FROM pt JOIN s USING (p) GROUP BY 1, 2),
nx AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY p ORDER BY t)),
gross AS (SELECT p, 'gross' AS name, coalesce(min(CASE WHEN v <= 400000 AND v2 > 400000 THEN t + (400000 - v) / (v2 - v) * (t2 - t) END), 1) AS bound, max(CASE WHEN t = 0 THEN v END) <= 400000 AS ok FROM nx GROUP BY 1),
lin AS (SELECT p, 'net' AS name, sum(a) AS a, sum(b) AS b, 250000 AS cap FROM s GROUP BY 1 UNION ALL SELECT p, 'group:' || g, sum(a), sum(b), 150000 FROM s GROUP BY p, g UNION ALL SELECT p, 'factor:size', sum(a * f), sum(b * f), 200000 FROM s GROUP BY 1),
e AS (SELECT p, name, bound, ok FROM gross UNION ALL SELECT p, name, CASE WHEN abs(a + b) <= cap THEN 1 WHEN a > 0 THEN (cap - b) / a ELSE (cap + b) / -a END, abs(b) <= cap FROM lin)
SELECT p AS portfolio_id, bool_and(ok) AS feasible, round(CASE WHEN bool_and(ok) THEN greatest(0, least(1, min(bound))) ELSE 0 END, 6) AS scale, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok OR bound < 1), '') AS binding FROM e GROUP BY 1""")
def p17(spark, d):
    """A customer's orders as sleeves: what is filled or offset is there already, the rest is scaled."""
    price, status, key = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderkey")
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("portfolio_id"), key.alias("sleeve"), F.when(key % 3 == 0, -price).otherwise(price).alias("target"), F.when(status == "F", 0.1 * price).when(status == "O", -0.1 * price).otherwise(0.0).alias("present"),
        "o_orderpriority", F.lit(400000.0).alias("gross_limit"), F.lit(250000.0).alias("net_limit"),
    )
    loads = s.select("portfolio_id", "sleeve", F.concat(F.lit("group:"), "o_orderpriority").alias("limit_name"), F.lit(1.0).alias("load"), F.lit(150000.0).alias("cap")).unionByName(
        s.select("portfolio_id", "sleeve", F.lit("factor:size").alias("limit_name"), ((F.col("sleeve") % 5 - 2) / 2.0).alias("load"), F.lit(200000.0).alias("cap"))
    )
    out = construction.safe_scale(s, loads, "portfolio_id", "sleeve", "target", "present")
    return out.select("portfolio_id", "feasible", F.round("scale", 6).alias("scale"), F.array_join("binding", ",").alias("binding"))


_POLICY = {"maximum_sleeve": 0.3, "minimum_liquidity": 0.15, "maximum_drawdown": 0.95, "minimum_decay": 0.1, "uncertainty": 0.2, "target_volatility": 0.02, "maximum_gross": 0.605, "maximum_net": 0.405, "stress_shock": -0.1, "maximum_stress": 0.05}


def _run20(spark, d):
    """Instruments as sleeves of the portfolio that their brand begins with."""
    r = views.returns(spark, d).withColumn("portfolio", F.substring("instrument_id", 7, 1))
    s = r.groupBy("portfolio", F.col("instrument_id").alias("sleeve")).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("signal"), (1 / F.stddev_pop("r")).alias("score")).where("score IS NOT NULL")
    n = F.col("n")
    s = s.select(
        "portfolio", "sleeve", "n", "signal", "score", F.lit(1.0).alias("regime_current"), F.when(n % 5 == 0, 0.5).otherwise(1.0).alias("regime_proposed"), F.when(n % 3 == 0, 0.8).otherwise(1.0).alias("capacity"), ((n % 11) / 10.0).alias("liquidity"), ((n % 13) / 12.0).alias("drawdown"), ((n % 7) / 6.0).alias("decay"),
        F.lit("REVIEW_REQUIRED").alias("scorecard_status"), F.when(n % 23 == 0, "BROKEN").otherwise("VERIFIED").alias("validation_integrity"), F.lit("REVIEW_REQUIRED").alias("regime_status"), F.when(n % 2 == 0, 0.5).otherwise(1.0).alias("delta_multiplier"), ((n % 5) * 0.01).alias("pending"), ((n % 3) * -0.01).alias("fx"),
    )
    s = staged(s, "sleeves")
    loads = s.select("portfolio", "sleeve", F.concat(F.lit("group:"), F.col("n") % 2).alias("limit_name"), F.lit(1.0).alias("load"), F.lit(0.155).alias("cap"))
    health = s.select("portfolio").distinct().select("portfolio", F.when(F.col("portfolio") == "5", "BLOCKED").otherwise("HEALTHY").alias("health"))
    return construction.construct(s, r.select("portfolio", F.col("instrument_id").alias("sleeve"), F.col("day").alias("time"), "r"), loads, health, _POLICY)


# pairs within each portfolio, the gross limit between its breakpoints
_SQL20 = with_views("returns") + """, z AS (SELECT substr(instrument_id, 7, 1) AS p, instrument_id AS k, count(*) AS n, avg(r) AS signal, 1 / nullif(stddev_pop(r), 0) AS score FROM returns GROUP BY 1, 2),
k0 AS (SELECT *, row_number() OVER w - 1 AS above, sum(score) OVER (PARTITION BY p ORDER BY score DESC, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM z WHERE score IS NOT NULL WINDOW w AS (PARTITION BY p ORDER BY score DESC, k)),
k1 AS (SELECT *, coalesce(min(CASE WHEN (1 - above * 0.3::DOUBLE) * score / rest <= 0.3::DOUBLE THEN above END) OVER (PARTITION BY p), count(*) OVER (PARTITION BY p)) AS capped FROM k0),
k2 AS (SELECT *, CASE WHEN above < capped THEN least(0.3::DOUBLE, greatest(0, 1 - above * 0.3::DOUBLE)) ELSE greatest(0, 1 - capped * 0.3::DOUBLE) * score / max(CASE WHEN above = capped THEN rest END) OVER (PARTITION BY p) END AS weight FROM k1),
g AS (SELECT p, p = '5' AS no_data, coalesce(string_agg(k || ':validation_package_not_verified', ',' ORDER BY k) FILTER (n % 23 = 0), '') AS unfit FROM k2 GROUP BY 1),
b AS (SELECT k2.*, CASE WHEN no_data OR unfit <> '' OR (n % 11) / 10.0::DOUBLE < 0.15 OR (n % 13) / 12.0::DOUBLE > 0.95 OR (n % 7) / 6.0::DOUBLE < 0.1 THEN 0 ELSE sign(signal) * weight * CASE WHEN n % 5 = 0 THEN 0.5 ELSE 1 END * CASE WHEN n % 3 = 0 THEN 0.8 ELSE 1 END END AS base,
    concat_ws(',', CASE WHEN n % 5 = 0 THEN 'regime_reduction' END, CASE WHEN n % 3 = 0 THEN 'capacity_reduction' END, CASE WHEN (n % 11) / 10.0::DOUBLE < 0.15 THEN 'liquidity_disabled' END, CASE WHEN (n % 13) / 12.0::DOUBLE > 0.95 THEN 'drawdown_disabled' END, CASE WHEN (n % 7) / 6.0::DOUBLE < 0.1 THEN 'signal_decay_disabled' END) AS changed FROM k2 JOIN g USING (p)),
t AS (SELECT substr(instrument_id, 7, 1) AS p, count(DISTINCT day) AS days FROM returns JOIN b ON b.k = instrument_id GROUP BY 1), i AS (SELECT b.p, b.k, base, sum(r) / max(days) AS m FROM b JOIN returns ON instrument_id = b.k JOIN t ON t.p = b.p GROUP BY 1, 2, 3),
x AS (SELECT a.instrument_id AS i, c.instrument_id AS j, sum(a.r * c.r) AS s FROM returns a JOIN returns c USING (day) WHERE substr(a.instrument_id, 7, 1) = substr(c.instrument_id, 7, 1) GROUP BY 1, 2),
c AS (SELECT a.p, a.k AS i, e.k AS j, a.base AS wi, e.base AS wj, coalesce(s, 0) / days - a.m * e.m AS cov FROM i a JOIN i e ON a.p = e.p JOIN t ON t.p = a.p LEFT JOIN x ON x.i = a.k AND x.j = e.k),
dv AS (SELECT i, sqrt(cov) AS dev FROM c WHERE i = j), st AS (SELECT c.*, CASE WHEN c.i = c.j THEN cov ELSE cov + 0.2 * (u.dev * v.dev - cov) END AS moved FROM c JOIN dv u ON u.i = c.i JOIN dv v ON v.i = c.j),
vol AS (SELECT p, sqrt(greatest(0, sum(wi * wj * moved))) AS stressed FROM st GROUP BY 1), mg AS (SELECT st.p, st.i AS k, CASE WHEN max(stressed) > 0 THEN sum(wj * moved) / max(stressed) ELSE 0 END AS marginal FROM st JOIN vol ON vol.p = st.p GROUP BY 1, 2),
s AS (SELECT b.*, stressed, marginal, CASE WHEN stressed > 0 THEN least(1, 0.02 / stressed) ELSE 1 END AS vs FROM b JOIN vol ON vol.p = b.p JOIN mg ON mg.p = b.p AND mg.k = b.k),
ab AS (SELECT *, base * vs * CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1 END AS a, (n % 5) * 0.01::DOUBLE + (n % 3) * -0.01::DOUBLE AS h FROM s),
pt AS (SELECT DISTINCT p, q FROM (SELECT p, 0.0::DOUBLE AS q FROM ab UNION ALL SELECT p, 1.0 FROM ab UNION ALL SELECT p, -h / a FROM ab WHERE a <> 0 AND -h / a > 0 AND -h / a < 1)), v AS (SELECT pt.p, q, sum(abs(q * a + h)) AS v FROM pt JOIN ab ON ab.p = pt.p GROUP BY 1, 2),
nx AS (SELECT *, lead(q) OVER w AS q2, lead(v) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY p ORDER BY q)), gr AS (SELECT p, 'gross' AS name, coalesce(min(CASE WHEN v <= 0.605 AND v2 > 0.605 THEN q + (0.605 - v) / (v2 - v) * (q2 - q) END), 1) AS bound, max(CASE WHEN q = 0 THEN v END) <= 0.605 AS ok FROM nx GROUP BY 1),
ln AS (SELECT p, 'net' AS name, sum(a) AS a, sum(h) AS h, 0.405 AS cap FROM ab GROUP BY 1 UNION ALL SELECT p, 'group:' || (n % 2), sum(a), sum(h), 0.155 FROM ab GROUP BY p, n % 2),
e AS (SELECT p, name, bound, ok FROM gr UNION ALL SELECT p, name, CASE WHEN abs(a + h) <= cap THEN 1 WHEN a > 0 THEN (cap - h) / a ELSE (cap + h) / -a END, abs(h) <= cap FROM ln),
sf AS (SELECT p, bool_and(ok) AS feasible, CASE WHEN bool_and(ok) THEN greatest(0, least(1, min(bound))) ELSE 0 END AS scale, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok OR bound < 1), '') AS binding FROM e GROUP BY 1),
f AS (SELECT ab.*, feasible, scale, binding, base * vs * scale AS target, a * scale + h AS effective FROM ab JOIN sf ON sf.p = ab.p),
lim AS (SELECT p, string_agg('independent_risk_gate:limit:group:' || y, ',' ORDER BY y) AS broken FROM (SELECT p, n % 2 AS y, abs(sum(effective)) AS held FROM f GROUP BY 1, 2) WHERE held > 0.155 + 1e-9 GROUP BY 1),
o AS (SELECT f.p, sum(abs(effective)) AS gross, sum(effective) AS net, max(abs(effective)) AS largest, max(stressed * vs * scale) AS vol, max(vs) AS vs, max(scale) AS scale, bool_and(feasible) AS feasible, max(binding) AS binding FROM f GROUP BY 1),
run AS (SELECT o.*, concat_ws(',', CASE WHEN no_data THEN 'portfolio_data_health_blocked' END, nullif(unfit, ''), CASE WHEN NOT feasible THEN 'pending_or_fx_hidden_leverage_exceeds_policy' END, CASE WHEN gross > 0.605 + 1e-9 OR abs(net) > 0.405 + 1e-9 OR broken IS NOT NULL THEN 'aggregate_constraints_not_satisfied' END,
    CASE WHEN gross > 0.605 + 1e-9 THEN 'independent_risk_gate:gross_exposure_limit' END, CASE WHEN abs(net) > 0.405 + 1e-9 THEN 'independent_risk_gate:net_exposure_limit' END, CASE WHEN largest > 0.3 + 1e-9 THEN 'independent_risk_gate:single_weight_limit' END, CASE WHEN net * 0.1 > 0.05 + 1e-9 THEN 'independent_risk_gate:stress_loss_limit' END, broken) AS reasons FROM o JOIN g ON g.p = o.p LEFT JOIN lim ON lim.p = o.p)"""


@query("p20_construction_run", _SQL20 + " SELECT p AS portfolio, CASE WHEN reasons = '' THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS status, reasons, round(gross, 6) AS gross, round(net, 6) AS net, round(1 - net, 6) AS cash, round(vol, 6) AS stressed_volatility, round(vs, 6) AS vol_scale, round(scale, 6) AS aggregate_scale, binding FROM run")
def p20(spark, d):
    run, _ = _run20(spark, d)
    numbers = ("gross", "net", "cash", "stressed_volatility", "vol_scale", "aggregate_scale")
    return run.withColumns({"reasons": F.array_join("reasons", ","), "binding": F.array_join("binding", ","), **{c: F.round(c, 6) for c in numbers}})


@query("p20_target_sleeves", _SQL20 + " SELECT p AS portfolio, k AS sleeve, round(target, 6) AS target, round(effective, 6) AS effective, round(target * marginal, 8) AS component, concat_ws(',', nullif(changed, ''), CASE WHEN vs < 1 THEN 'target_volatility_reduction' END, CASE WHEN scale < 1 THEN 'aggregate_constraint_reduction' END) AS reasons FROM f")
def p20_sleeves(spark, d):
    return _run20(spark, d)[1].withColumns({"target": F.round("target", 6), "effective": F.round("effective", 6), "component": F.round("component", 8)})
