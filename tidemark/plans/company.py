"""Queries on company research, news, models, reconciliation and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, text
from tidemark.operators.controls import reasons
from tidemark.plans.controls import why
from tidemark.plans.market import r6
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views

# company research: a company is a customer, its revenue what it ordered

_CO_COLS = {"operating_income": "c_acctbal * 10", "cash_flow": "c_acctbal * 12", "capex": "revenue * 0.05E0", "debt": "abs(c_acctbal) * 20 + 1000", "tax": "0.21E0", "invested": "revenue * 0.5E0 + 1000"}
_CO = f"""WITH o AS (SELECT o_custkey, sum(o_totalprice) AS revenue, count(*) AS shares, sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END) AS prior FROM orders GROUP BY 1),
    c AS (SELECT c_custkey AS company_id, c_acctbal, revenue, shares, prior, {', '.join(f'{e} AS {k}' for k, e in _CO_COLS.items())} FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""
_I1 = {"operating_margin": "operating_income / revenue", "free_cash_flow": "cash_flow - capex", "dilution": "CASE WHEN prior > 0 THEN CAST(shares - prior AS DOUBLE) / prior END", "nopat": "operating_income * (1 - tax)", "roic": "operating_income * (1 - tax) / invested"}
_QUALITY = "least(100, greatest(0, 50 + operating_income / revenue * 25 + (cash_flow - capex) / revenue * 25 + operating_income * (1 - tax) / invested * 30 - debt / revenue * 10))"


def _companies(spark, d):
    early = (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).cast("int")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("shares"), F.sum(early).alias("prior"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("company_id"), "c_acctbal", "revenue", "shares", "prior", *(F.expr(e).alias(k) for k, e in _CO_COLS.items()))


@query("i1_derived_metrics", _CO + " SELECT company_id, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _I1.items()) + ", CASE WHEN revenue IS NULL THEN 'UNAVAILABLE' ELSE 'MEASURED' END AS state FROM c")
def i1(spark, d):
    state = F.when(F.col("revenue").isNull(), "UNAVAILABLE").otherwise("MEASURED")
    return _companies(spark, d).select("company_id", *(r6(F.expr(e), k) for k, e in _I1.items()), state.alias("state"))


@query("i3_quality_score", _CO + f" SELECT company_id, CASE WHEN revenue IS NOT NULL THEN round(({_QUALITY})::DOUBLE, 6) END AS score FROM c")
def i3(spark, d):
    return _companies(spark, d).select("company_id", F.when(F.col("revenue").isNotNull(), F.round(F.expr(_QUALITY).cast("double"), 6)).alias("score"))


_EXPECT = {"revenue": (100_000.0, 2_000_000.0), "operating_margin": (0.01, 0.5), "roic": (0.02, 1.0)}
_FACTS = {"revenue": "revenue", "operating_margin": "operating_income / revenue", "roic": "operating_income * (1 - tax) / invested"}
_I5 = {k: f"{_FACTS[k]} IS NULL OR {_FACTS[k]} < {lo!r} OR {_FACTS[k]} > {hi!r}" for k, (lo, hi) in _EXPECT.items()}


@query("i5_thesis_drift", _CO + f" SELECT company_id, {why(_I5)} AS breaches FROM c")
def i5(spark, d):
    return _companies(spark, d).select("company_id", reasons(_I5).alias("breaches"))


@query("i6_invalidation_rules", _CO + ", r(rule_id, metric, op, bound) AS (VALUES (1, 'revenue', '<', 150000.0::DOUBLE), (2, 'debt', '>', 100000.0::DOUBLE), (3, 'capex', '>', 50000.0::DOUBLE)), v AS (SELECT company_id, unnest(['revenue', 'debt', 'capex']) AS metric, unnest([revenue, debt, capex]) AS value FROM c) SELECT company_id, rule_id, round(value, 2) AS value FROM v JOIN r USING (metric) WHERE CASE op WHEN '<' THEN value < bound ELSE value > bound END")
def i6(spark, d):
    rules = {"revenue": (1, "<", 150000.0), "debt": (2, ">", 100000.0), "capex": (3, ">", 50000.0)}
    fired = [F.when(F.col(m) < b if op == "<" else F.col(m) > b, F.struct(F.lit(i).alias("rule_id"), F.round(m, 2).alias("value"))) for m, (i, op, b) in rules.items()]
    return _companies(spark, d).select("company_id", F.explode(F.array_compact(F.array(*fired))).alias("x")).select("company_id", "x.rule_id", "x.value")


_REB = "WITH p AS (SELECT c_nationkey AS portfolio_id, c_custkey, abs(c_acctbal) / sum(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS present, 1.0::DOUBLE / count(*) OVER (PARTITION BY c_nationkey) AS target FROM customer)"
_I9 = {"turnover_limit": "turnover > 0.5", "single_weight_limit": "largest > 0.04", "cash_limit": "abs(cash) > 0.01"}


@query("i9_rebalance_candidate", _REB + f", t AS (SELECT portfolio_id, sum(abs(target - present)) / 2 AS turnover, max(target) AS largest, sum(target - present) AS cash FROM p GROUP BY 1) SELECT portfolio_id, round(turnover, 6) AS turnover, {why(_I9)} AS reasons FROM t")
def i9(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("portfolio_id"), F.abs("c_acctbal").alias("w"))
    whole = c.groupBy("portfolio_id").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))  # pre-aggregated, no window over a whole portfolio
    gap = F.lit(1.0) / F.col("n") - F.col("w") / F.col("s")
    t = c.join(whole, "portfolio_id").groupBy("portfolio_id").agg((F.sum(F.abs(gap)) / 2).alias("turnover"), F.max(F.lit(1.0) / F.col("n")).alias("largest"), F.sum(gap).alias("cash"))
    return t.select("portfolio_id", r6(F.col("turnover"), "turnover"), reasons(_I9).alias("reasons"))


@query("i10_portfolio_assessment", _REB + " SELECT portfolio_id, count(*) AS holdings, sum((present > 0.1::DOUBLE)::INT)::BIGINT AS breaches, round(max(present), 6) AS largest FROM p GROUP BY 1")
def i10(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("portfolio_id"), F.abs("c_acctbal").alias("w"))
    share = F.col("w") / F.col("s")
    return c.join(c.groupBy("portfolio_id").agg(F.sum("w").alias("s")), "portfolio_id").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("holdings"), F.count_if(share > 0.1).alias("breaches"), r6(F.max(share), "largest"))


@query("i11_scenario_value", "SELECT p_partkey, round(0.25::DOUBLE * p_retailprice * 0.7 + 0.5::DOUBLE * p_retailprice + 0.25::DOUBLE * p_retailprice * 1.4, 6) AS value FROM part")
def i11(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", r6(p * 0.25 * 0.7 + p * 0.5 + p * 0.25 * 1.4, "value"))


_THEMES = {"time": ("time", "year", "day"), "people": ("people", "person", "family"), "work": ("work", "company", "project")}
_THEME_SUM = {t: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ws) for t, ws in _THEMES.items()}


@query("i12_theme_discovery", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS theme, {e} AS matched, {len(_THEMES[t])} AS phrases FROM documents" for t, e in _THEME_SUM.items()) + ") SELECT doc_id, theme, round(matched / phrases::DOUBLE, 6) AS strength FROM s WHERE matched > 0")
def i12(spark, d):
    found = F.array(*(F.struct(F.lit(t).alias("theme"), (F.expr(e) / F.lit(float(len(_THEMES[t])))).alias("strength")) for t, e in _THEME_SUM.items()))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).where("x.strength > 0").select("doc_id", "x.theme", r6(F.col("x.strength"), "strength"))


@query("i13_due_reviews", "SELECT o_custkey, max(o_orderdate) AS last_review FROM orders GROUP BY 1 HAVING max(o_orderdate) + INTERVAL 90 DAY <= TIMESTAMP '1998-07-01'")
def i13(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_review"))
    return last.where(F.col("last_review") + F.expr("INTERVAL 90 DAYS") <= F.lit("1998-07-01").cast("timestamp_ntz"))


# text and news


@query("t2_normalized_headline", "SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(substr(text, 1, position(chr(10) IN text || chr(10)) - 1)), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS headline FROM documents")
def t2(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalized_headline(F.substring_index("text", "\n", 1)).alias("headline"))


_NEWS = {"language_unsupported": "lang NOT IN ('en', 'de')", "late_ingestion": "doc_id % 13 > 8", "text_missing": "text IS NULL OR length(text) = 0", "rights_missing": "doc_id % 29 = 0"}
_NEWS_STATUS = "CASE WHEN doc_id % 29 = 0 THEN 'BLOCKED' WHEN lang NOT IN ('en', 'de') OR doc_id % 13 > 8 THEN 'REVIEW_REQUIRED' ELSE 'ELIGIBLE' END"


@query("t4_news_assessment", f"SELECT doc_id, round((doc_id % 10 + 1) / 10.0::DOUBLE * CASE WHEN lang = 'en' THEN 1 ELSE 0.8 END, 6) AS credibility, {why(_NEWS)} AS reasons, {_NEWS_STATUS} AS status FROM documents")
def t4(spark, d):
    score = (F.col("doc_id") % 10 + 1) / F.lit(10.0) * F.when(F.col("lang") == "en", 1.0).otherwise(0.8)
    return table(spark, d, "documents").select("doc_id", r6(score, "credibility"), reasons(_NEWS).alias("reasons"), F.expr(_NEWS_STATUS).alias("status"))


@query("t6_event_confidence", "WITH s AS (SELECT source, (count(*) % 10 + 1) / 11.0::DOUBLE AS reliability FROM documents GROUP BY 1) SELECT doc_id, round(reliability * (doc_id % 5 + 1) / 5, 6) AS confidence, lang = 'en' AS eligible FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source")
def t6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    s = docs.groupBy(F.col("source").alias("src")).agg(((F.count(F.lit(1)) % 10 + 1) / F.lit(11.0)).alias("reliability"))
    return docs.join(s, F.col("source").eqNullSafe(F.col("src"))).select("doc_id", r6(F.col("reliability") * (F.col("doc_id") % 5 + 1) / 5, "confidence"), (F.col("lang") == "en").alias("eligible"))


@query("t8_revision_lineage", with_views("revisions") + " SELECT instrument_id, period, b.revision::INT AS predecessor, a.revision::INT AS successor FROM revisions a JOIN revisions b USING (instrument_id, period) WHERE a.revision = b.revision + 1")
def t8(spark, d):
    r = views.revisions(spark, d).select("instrument_id", "period", "revision")
    return r.withColumn("predecessor", F.lag("revision").over(Window.partitionBy("instrument_id", "period").orderBy("revision"))).where("predecessor IS NOT NULL").select("instrument_id", "period", "predecessor", F.col("revision").alias("successor"))


@query("t11_category_distribution", """WITH k AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS category), n AS (SELECT (user_id % 5)::BIGINT AS topic, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT topic, sum(n)::BIGINT AS whole FROM n GROUP BY 1)
    SELECT topic, category, coalesce(n, 0) AS posts, round(coalesce(n, 0) / whole, 6) AS share FROM t CROSS JOIN k LEFT JOIN n USING (topic, category)""")
def t11(spark, d):
    kinds = ("view", "click", "purchase", "signup", "error", "refund")  # every type, and one that may be absent
    t = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("topic")).agg(F.count(F.lit(1)).alias("whole"), *(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    return t.unpivot(["topic", "whole"], list(kinds), "category", "posts").select("topic", "category", "posts", r6(F.col("posts") / F.col("whole"), "share"))


_RIGHTS = {"author_missing": "user_id IS NULL", "published_after_ingest": "event_id % 17 = 0", "type_not_permitted": "event_type = 'error'"}


@query("t12_rights_filter", f"SELECT event_type, {why(_RIGHTS)} AS violations, count(*) AS posts FROM events GROUP BY 1, 2")
def t12(spark, d):
    return table(spark, d, "events").groupBy("event_type", reasons(_RIGHTS).alias("violations")).agg(F.count(F.lit(1)).alias("posts"))


#: Phrases that read as instructions.
_ORDERS = "|".join(text.INJECTIONS)


@query("t15_instruction_screen", f"SELECT conv_id, count(*) AS turns, bool_or(regexp_matches(coalesce(text, ''), '{_ORDERS}', 'i')) AS flagged FROM conversations GROUP BY 1")
def t15(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.coalesce("text", F.lit("")).rlike(f"(?i){_ORDERS}")).alias("flagged"))


# models

_HOLD = with_views("holdout")
_M11 = {"too_few_observations": "n < 50", "single_class": "pos = 0 OR pos = n", "not_better_than_predecessor": "brier >= old_brier"}


@query("m11_candidate_report", _HOLD + f", s AS (SELECT model_id, count(*) AS n, sum(outcome) AS pos, avg(pow(candidate - outcome, 2)) AS brier, avg(pow(predecessor - outcome, 2)) AS old_brier FROM holdout GROUP BY 1) SELECT model_id, n, round(brier, 6) AS brier, round(old_brier, 6) AS predecessor_brier, {why(_M11)} AS reasons, CASE WHEN {why(_M11)} = '' THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS outcome FROM s")
def m11(spark, d):
    sq = lambda c: F.avg(F.pow(F.col(c) - F.col("outcome"), F.lit(2)))
    s = views.holdout(spark, d).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("pos"), sq("candidate").alias("brier"), sq("predecessor").alias("old_brier"))
    why_ = reasons(_M11)
    return s.select("model_id", "n", r6(F.col("brier"), "brier"), r6(F.col("old_brier"), "predecessor_brier"), why_.alias("reasons"), F.when(why_ == "", "REVIEW_REQUIRED").otherwise("REJECTED").alias("outcome"))


@query("m12_monitoring", _HOLD + " SELECT model_id, round(max(abs(candidate - predecessor)), 6) AS probability_shift, round(max(greatest(0, abs(predecessor - 0.5) - abs(candidate - 0.5))), 6) AS confidence_degradation, avg(abs(candidate - predecessor)) > 0.34 AS drifted FROM holdout GROUP BY 1")
def m12(spark, d):
    shift = F.abs(F.col("candidate") - F.col("predecessor"))
    worse = F.greatest(F.lit(0.0), F.abs(F.col("predecessor") - 0.5) - F.abs(F.col("candidate") - 0.5))
    return views.holdout(spark, d).groupBy("model_id").agg(r6(F.max(shift), "probability_shift"), r6(F.max(worse), "confidence_degradation"), (F.avg(shift) > 0.34).alias("drifted"))


@query("m13_drift_breach", "WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1) SELECT e.event_id, e.user_id, e.value FROM events e JOIN a USING (user_id) WHERE a.status = 'signup' AND e.event_type = 'view' AND e.value >= 30")
def m13(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    last = e.where(F.col("event_type").isin("signup", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return e.where("event_type = 'view' AND value >= 30").join(last.where("status = 'signup'"), "user_id").select("event_id", "user_id", "value")


# execution and reconciliation


@query("e3_simple_execution_quality", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(100 + l_extendedprice % 20 - 110) / 110, 6) AS slippage FROM lineitem")
def e3(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.abs(F.lit(100) + F.col("l_extendedprice") % 20 - 110) / 110, "slippage"))


_SIDES = {True: "l_linenumber % 2 = 1", False: "l_linenumber % 2 = 0"}


@query("e4_shadow_comparison", "WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), b AS (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) SELECT l_orderkey, concat_ws(',', CASE WHEN a.q IS NULL OR b.q IS NULL THEN 'missing' END, CASE WHEN a.q <> b.q THEN 'quantity' END, CASE WHEN abs(a.p - b.p) > 1000 THEN 'price' END) AS differences FROM a FULL JOIN b USING (l_orderkey)")
def e4(spark, d):
    odd = F.expr(_SIDES[True])
    both = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(odd, F.col("l_quantity"))).alias("a"), F.sum(F.when(~odd, F.col("l_quantity"))).alias("b"), F.avg(F.when(odd, F.col("l_extendedprice"))).alias("p"), F.avg(F.when(~odd, F.col("l_extendedprice"))).alias("r"))
    return both.select("l_orderkey", reasons({"missing": "a IS NULL OR b IS NULL", "quantity": "a <> b", "price": "abs(p - r) > 1000"}).alias("differences"))


@query("e9_reconcile_accounts", "WITH x AS (SELECT l_suppkey, count(*) AS fills, sum(l_tax * 100) AS fees, sum((l_linestatus = 'O')::INT)::BIGINT AS open FROM lineitem GROUP BY 1), y AS (SELECT l_suppkey, count(*) AS fills, sum(l_tax * 100) AS fees, sum((l_linestatus = 'O')::INT)::BIGINT AS open FROM lineitem WHERE l_suppkey % 9 > 0 OR l_linenumber <> 4 GROUP BY 1) SELECT l_suppkey, x.fills - coalesce(y.fills, 0) AS fills_apart, x.open - coalesce(y.open, 0) AS open_apart FROM x LEFT JOIN y USING (l_suppkey) WHERE x.fills <> coalesce(y.fills, 0) OR abs(x.fees - coalesce(y.fees, 0)) > 0.01")
def e9(spark, d):
    theirs = F.expr("l_suppkey % 9 > 0 OR l_linenumber <> 4").cast("int")
    is_open = (F.col("l_linestatus") == "O").cast("int")
    gap = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(1 - theirs).alias("fills_apart"), F.sum(is_open * (1 - theirs)).alias("open_apart"), F.sum(F.col("l_tax") * 100 * (1 - theirs)).alias("fees"))
    return gap.where("fills_apart <> 0 OR abs(fees) > 0.01").select("l_suppkey", "fills_apart", "open_apart")


@query("e10_fill_dedupe", "SELECT l_orderkey, l_linenumber, count(*) AS seen, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1, 2")
def e10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("seen"), (F.min("l_quantity") != F.max("l_quantity")).alias("conflict"))


@query("e12_portfolio_state", "WITH p AS (SELECT l_suppkey, l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(sum(q * c), 2) AS state, bool_and(q >= 0) AS may_increase FROM p GROUP BY 1")
def e12(spark, d):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    p = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(signed).alias("q"), F.avg("l_extendedprice").alias("c"))
    return p.groupBy("l_suppkey").agg(F.round(F.sum(F.col("q") * F.col("c")), 2).alias("state"), F.bool_and(F.col("q") >= 0).alias("may_increase"))


@query("e6_split_adjusted_positions", "WITH s AS (SELECT l_partkey, l_shipdate AS at, product(CASE WHEN l_linenumber = 7 THEN 2.0 ELSE 1.0 END) AS factor FROM lineitem WHERE l_linenumber = 7 GROUP BY 1, 2), f AS (SELECT l.l_partkey, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice, l.l_quantity * coalesce(product(s.factor), 1) AS q FROM lineitem l LEFT JOIN s ON s.l_partkey = l.l_partkey AND s.at > l.l_shipdate GROUP BY l.l_partkey, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_shipdate) SELECT l_partkey, round(ln(sum(q)), 6) AS log_quantity FROM f GROUP BY 1")
def e6(spark, d):
    """Each fill counts times the splits that come after it: a running sum from the end, no pairs of fills and splits."""
    li = table(spark, d, "lineitem").dropDuplicates(["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"])
    later = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate")).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("l_partkey", "l_shipdate")
    split = (F.col("l_linenumber") == 7).cast("int")
    n = li.select("l_partkey", "l_shipdate", "l_quantity", split.alias("s")).groupBy("l_partkey", "l_shipdate").agg(F.sum("l_quantity").alias("q"), F.sum("s").alias("s"))
    after = n.withColumn("k", F.sum("s").over(later) - F.sum("s").over(same))
    return after.groupBy("l_partkey").agg(r6(F.log(F.sum(F.col("q") * F.pow(F.lit(2.0), F.col("k")))), "log_quantity"))


# operations


@query("o2_sre_overview", "SELECT user_id % 5 AS service, max(ts) AS last_probe, arg_max(value, (ts, event_id)) AS last_value, min(CASE WHEN event_type = 'purchase' THEN ts END) AS acknowledged_at FROM events GROUP BY 1")
def o2(spark, d):
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("service")).agg(F.max("ts").alias("last_probe"), F.max_by("value", order).alias("last_value"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("acknowledged_at"))


@query("o4_active_alerts", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'")
def o4(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return asof.latest_by(e, ["user_id"], F.desc("ts"), F.desc("event_id")).where("event_type <> 'purchase'").select("user_id", "event_id", "ts")


_DUE = "WITH s AS (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), d AS (SELECT *, CASE WHEN last IS NULL THEN TIMESTAMP '1997-01-01' ELSE last + INTERVAL 60 DAY END AS due_at FROM s)"


@query("o6_cadence_due", _DUE + " SELECT c_custkey, due_at, due_at <= TIMESTAMP '1998-08-01' AS due, due_at + INTERVAL 10 DAY < TIMESTAMP '1998-08-01' AS overdue FROM d")
def o6(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    due_at = F.when(F.col("last").isNull(), ts("1997-01-01")).otherwise(F.col("last") + F.expr("INTERVAL 60 DAYS"))
    s = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", due_at.alias("due_at"))
    return s.select("c_custkey", "due_at", (F.col("due_at") <= ts("1998-08-01")).alias("due"), (F.col("due_at") + F.expr("INTERVAL 10 DAYS") < ts("1998-08-01")).alias("overdue"))


_KEEP = "CASE WHEN o_orderstatus = 'O' THEN 'POLICY_DISABLED' WHEN o_orderkey % 10 = 0 THEN 'LEGAL_HOLD' WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN 'RETENTION_WINDOW_ACTIVE' ELSE 'RETENTION_WINDOW_ELAPSED_REVIEW_REQUIRED' END"


@query("o8_retention", f"SELECT o_orderkey, {_KEEP} AS reason, CASE WHEN {_KEEP} LIKE '%ELAPSED%' THEN 'ELIGIBLE_FOR_REVIEW' ELSE 'RETAIN' END AS disposition FROM orders")
def o8(spark, d):
    why_ = F.expr(_KEEP.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    return table(spark, d, "orders").select("o_orderkey", why_.alias("reason"), F.when(why_.contains("ELAPSED"), "ELIGIBLE_FOR_REVIEW").otherwise("RETAIN").alias("disposition"))


@query("o11_run_budget", "SELECT conv_id, count(*) AS turns, sum(length(coalesce(text, ''))) ::BIGINT AS cost, CASE WHEN count(*) > 8 THEN 'TURN_LIMIT' WHEN sum(length(coalesce(text, ''))) > 1000 THEN 'COST_LIMIT' ELSE 'WITHIN_BUDGET' END AS status FROM conversations GROUP BY 1")
def o11(spark, d):
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("cost"))
    return r.withColumn("status", F.when(F.col("turns") > 8, "TURN_LIMIT").when(F.col("cost") > 1000, "COST_LIMIT").otherwise("WITHIN_BUDGET"))


@query("o13_alert_routing", "WITH r(route, kind, floor) AS (VALUES ('pager', 'error', 50.0), ('mail', 'error', 0.0), ('mail', 'view', 80.0)) SELECT event_id, route FROM events JOIN r ON event_type = kind AND value >= floor")
def o13(spark, d):
    routes = (("pager", "error", 50.0), ("mail", "error", 0.0), ("mail", "view", 80.0))
    hit = F.array_compact(F.array(*(F.when((F.col("event_type") == k) & (F.col("value") >= v), r) for r, k, v in routes)))
    return table(spark, d, "events").select("event_id", F.explode(hit).alias("route"))


# point-in-time reads that share the latest-by and as-of operators

_LATEST_EVENTS = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE rn = 1"


@query("a21_facts_as_of", _LATEST_EVENTS)
def a21(spark, d):
    known = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return known.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("a16_execution_snapshot", "WITH l AS (" + _LATEST_EVENTS + ") SELECT user_id, max(CASE WHEN event_type = 'error' THEN value END) AS halt, max(CASE WHEN event_type = 'signup' THEN value END) AS risk, max(CASE WHEN event_type = 'click' THEN value END) AS slippage, CASE WHEN count(DISTINCT CASE WHEN event_type IN ('error', 'signup', 'click') THEN event_type END) = 3 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS state FROM l GROUP BY 1")
def a16(spark, d):
    known = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    last = lambda k: F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.struct("ts", "event_id")))
    s = known.groupBy("user_id").agg(last("error").alias("halt"), last("signup").alias("risk"), last("click").alias("slippage"))
    return s.withColumn("state", F.when(F.expr("halt IS NOT NULL AND risk IS NOT NULL AND slippage IS NOT NULL"), "AVAILABLE").otherwise("UNAVAILABLE"))


@query("a13_delisting_closes", with_views("validity") + ", x AS (SELECT o_custkey AS symbol, max(o_orderdate) AS delisted_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT mapping_id, CASE WHEN delisted_at IS NULL THEN valid_until WHEN valid_until IS NULL THEN greatest(delisted_at, valid_from) ELSE least(valid_until, greatest(delisted_at, valid_from)) END AS valid_until FROM validity LEFT JOIN x USING (symbol)")
def a13(spark, d):
    x = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_orderdate").alias("delisted_at"))
    shut = F.greatest("delisted_at", "valid_from")  # not before the interval begins
    until = F.when(F.col("delisted_at").isNull(), F.col("valid_until")).otherwise(F.least("valid_until", shut))
    return views.validity(spark, d).join(x, "symbol", "left").select("mapping_id", until.alias("valid_until"))


@query("f17_macro_surprise", with_views("revisions") + " SELECT instrument_id, period, round(arg_max(value, revision) - arg_min(value, revision), 6) AS surprise FROM revisions GROUP BY 1, 2")
def f17(spark, d):
    r = views.revisions(spark, d)
    return r.groupBy("instrument_id", "period").agg(r6(F.max_by("value", "revision") - F.min_by("value", "revision"), "surprise"))


@query("f14_turnover", with_views("bars") + ", s AS (SELECT p_brand AS instrument_id, sum(p_size) * 100 AS shares FROM part GROUP BY 1) SELECT instrument_id, day, round(volume / shares, 6) AS turnover FROM bars JOIN s USING (instrument_id)")
def f14(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_brand").alias("instrument_id")).agg((F.sum("p_size") * 100).alias("shares"))
    return views.bars(spark, d).join(s, "instrument_id").select("instrument_id", "day", r6(F.col("volume") / F.col("shares"), "turnover"))
