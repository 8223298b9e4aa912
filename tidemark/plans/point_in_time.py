"""Queries on latest-visible reads, splits and evidence, record comparison and pre-trade screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, research, text
from tidemark.plans.market import RUN_SQL, _run, r6
from tidemark.plans.reference_data import _SOCIAL, _posts
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views

DAY, NOON = "1996-06-30", "2024-01-15"


def day(s: str = DAY):
    return F.lit(s).cast("date")


def moment(s: str = NOON):
    return F.lit(s).cast("timestamp_ntz")


# latest-visible reads; each table has rows that are known only after the time of the read


@query("a6_macro_revision_history", with_views("revisions") + f" SELECT instrument_id, period, revision::INT AS revision, value, known_at FROM revisions WHERE known_at <= DATE '{DAY}'")
def a6(spark, d):
    return research.visible(views.revisions(spark, d), day(), "known_at").select("instrument_id", "period", "revision", "value", "known_at")


_FEATURES = """WITH features AS (SELECT l_linenumber AS feature_id, l_partkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS event_at, CAST(l_shipdate AS DATE) AS effective_at,
    CAST(l_shipdate AS DATE) + l_linenumber AS known_at, CAST(l_shipdate AS DATE) + l_linenumber + CAST(l_suppkey % 5 AS INTEGER) AS computed_at, l_extendedprice AS value FROM lineitem)"""


def _features(spark, d):
    shipped = F.to_date("l_shipdate")
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("feature_id"), F.col("l_partkey").alias("instrument_id"), F.trunc("l_shipdate", "month").alias("event_at"), shipped.alias("effective_at"), "l_suppkey", F.col("l_extendedprice").alias("value"))
    known = li.withColumn("known_at", F.expr("date_add(effective_at, feature_id)"))
    return known.withColumn("computed_at", F.expr("date_add(known_at, cast(l_suppkey % 5 AS int))")).drop("l_suppkey")


@query("a7_feature_versions", _FEATURES + f" SELECT feature_id, instrument_id, event_at, computed_at, value FROM features WHERE computed_at <= DATE '{DAY}'")
def a7(spark, d):
    return research.visible(_features(spark, d), day(), "computed_at").select("feature_id", "instrument_id", "event_at", "computed_at", "value")


_FOUR = " AND ".join(f"{c} <= DATE '{DAY}'" for c in ("event_at", "effective_at", "known_at", "computed_at"))


@query("a8_features_as_of", _FEATURES + f", k AS (SELECT *, row_number() OVER (PARTITION BY feature_id, instrument_id, event_at ORDER BY known_at DESC, computed_at DESC, value DESC) AS rn FROM features WHERE {_FOUR}) SELECT feature_id, instrument_id, event_at, known_at, computed_at, value FROM k WHERE rn = 1")
def a8(spark, d):
    keys, times = ["feature_id", "instrument_id", "event_at"], ["event_at", "effective_at", "known_at", "computed_at"]
    return research.latest_visible(_features(spark, d), keys, day(), times, ["known_at", "computed_at", "value"]).select(*keys, "known_at", "computed_at", "value")


@query("a9_research_query", f"""WITH o AS (SELECT l_orderkey AS dataset_id, l_suppkey AS source_id, l_partkey AS instrument_id, l_linenumber AS kind, CAST(date_trunc('month', l_shipdate) AS DATE) AS event_at, CAST(l_shipdate AS DATE) AS effective_at,
    CAST(l_shipdate AS DATE) + l_linenumber AS known_at, CAST(l_quantity AS INTEGER) AS revision, l_linestatus = 'F' AS ok, l_returnflag = 'A' AS adjusted, l_extendedprice AS value FROM lineitem),
    k AS (SELECT o.*, row_number() OVER (PARTITION BY source_id, instrument_id, kind, event_at ORDER BY revision DESC, known_at DESC, value DESC) AS rn FROM o WHERE ok AND NOT adjusted AND effective_at <= DATE '{DAY}' AND known_at <= DATE '{DAY}'
    AND dataset_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= DATE '{DAY}') AND source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND instrument_id IN (SELECT p_partkey FROM part))
    SELECT source_id, instrument_id, kind, event_at, known_at, revision, value FROM k WHERE rn = 1""")
def a9(spark, d):
    shipped = F.to_date("l_shipdate")
    li = table(spark, d, "lineitem")
    observations = li.select(
        F.col("l_orderkey").alias("dataset_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("instrument_id"), F.col("l_linenumber").alias("kind"), F.trunc("l_shipdate", "month").alias("event_at"), shipped.alias("effective_at"),
        F.date_add(shipped, F.col("l_linenumber")).alias("known_at"), F.col("l_quantity").cast("int").alias("revision"), F.when(F.col("l_linestatus") == "F", "VALIDATED").otherwise("REJECTED").alias("status"),
        F.when(F.col("l_returnflag") == "A", "LATEST_ADJUSTED").otherwise("AS_REPORTED").alias("adjustment"), F.col("l_extendedprice").alias("value"),
    )
    datasets = table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), (F.col("o_orderstatus") == "F").alias("sealed"), F.to_date("o_orderdate").alias("sealed_at"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("permitted"))
    instruments = table(spark, d, "part").select(F.col("p_partkey").alias("instrument_id"))
    out = research.research_rows(observations, datasets, sources, instruments, day())
    return out.select("source_id", "instrument_id", "kind", "event_at", "known_at", "revision", "value")


def _asked(name, right_sql, values, sql_values):
    """An as-of read for every purchase, with the SQL that ranks all earlier rows."""
    return f"""WITH d AS (SELECT event_id AS decision_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS ({right_sql}), j AS (SELECT d.decision_id, {values}, row_number() OVER (PARTITION BY decision_id ORDER BY r.at DESC, r.seq DESC) AS rn
    FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.at <= d.ts) SELECT decision_id, {sql_values} FROM j WHERE rn = 1"""


def _as_of(spark, d, right, values):
    left = views.decisions(spark, d).withColumnRenamed("instrument_id", "user_id")
    return asof.as_of_join(left, right, "user_id", "decided_at", "at", values, "seq").select("decision_id", *values)


@query("a14_risk_profile_as_of", _asked("a14", "SELECT user_id, ts AS at, event_id AS seq, value AS risk_limit FROM events WHERE event_type = 'signup'", "risk_limit", "risk_limit"))
def a14(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("risk_limit"))
    return _as_of(spark, d, e, ["risk_limit"])


@query("a25_strategy_enabled_as_of", _asked("a25", "SELECT user_id, ts AS at, event_id AS seq, event_type = 'click' AS enabled FROM events WHERE event_type IN ('click', 'error')", "enabled", "coalesce(enabled, false) AS enabled"))
def a25(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'error')").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("enabled"))
    return _as_of(spark, d, e, ["enabled"]).withColumn("enabled", F.coalesce("enabled", F.lit(False)))


@query("a30_account_snapshot_as_of", _asked("a30", "SELECT user_id, ts + to_minutes(event_id % 7) AS at, event_id AS seq, value AS cash FROM events WHERE event_type = 'view' AND value > 5", "cash, seq AS snapshot_id", "cash, snapshot_id"))
def a30(spark, d):
    known = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))
    e = table(spark, d, "events").where("event_type = 'view' AND value > 5").select("user_id", known.alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("cash"), F.col("event_id").alias("snapshot_id"))
    return _as_of(spark, d, e, ["cash", "snapshot_id"])


_FILINGS = """WITH f AS (SELECT l_suppkey AS source_id, l_orderkey AS filing_id, l_returnflag AS concept, CAST(l_shipdate AS DATE) AS accepted_at, CAST(l_shipdate AS DATE) + l_linenumber AS ingested_at, l_linenumber AS revision, l_extendedprice AS value, l_quantity AS scale FROM lineitem)"""


def _filings(spark, d):
    shipped = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("filing_id"), F.col("l_returnflag").alias("concept"), shipped.alias("accepted_at"), F.date_add(shipped, F.col("l_linenumber")).alias("ingested_at"),
        F.col("l_linenumber").alias("revision"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("scale"),
    )


@query("a19_filings_as_of", _FILINGS + f", k AS (SELECT *, row_number() OVER (PARTITION BY source_id, filing_id, concept ORDER BY revision DESC, accepted_at DESC, value DESC, scale DESC) AS rn FROM f WHERE accepted_at <= DATE '{DAY}' AND ingested_at <= DATE '{DAY}') SELECT source_id, filing_id, concept, accepted_at, revision, value FROM k WHERE rn = 1")
def a19(spark, d):
    keys = ["source_id", "filing_id", "concept"]
    return research.latest_visible(_filings(spark, d), keys, day(), ["accepted_at", "ingested_at"], ["revision", "accepted_at", "value", "scale"]).select(*keys, "accepted_at", "revision", "value")


@query("a20_macro_observations_as_of", with_views("revisions") + f", k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, period ORDER BY known_at DESC, revision DESC) AS rn FROM revisions WHERE known_at <= DATE '{DAY}' AND period <= DATE '{DAY}') SELECT instrument_id, period, known_at, revision::INT AS revision, value FROM k WHERE rn = 1")
def a20(spark, d):
    return research.latest_visible(views.revisions(spark, d), ["instrument_id", "period"], day(), ["known_at", "period"], ["known_at", "revision"]).select("instrument_id", "period", "known_at", "revision", "value")


_FACTS = """WITH f AS (SELECT o_custkey AS company_id, o_orderpriority AS metric, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS observed_at, CAST(o_orderdate AS DATE) + CAST(o_custkey % 10 AS INTEGER) AS known_at, o_orderkey AS revision, o_totalprice AS value FROM orders)"""


def _facts(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("metric"), F.trunc("o_orderdate", "quarter").alias("observed_at"), F.expr("date_add(to_date(o_orderdate), cast(o_custkey % 10 AS int))").alias("known_at"),
        F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("value"),
    )


@query("a22_fact_history_as_of", _FACTS + f", k AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric, observed_at ORDER BY revision DESC) AS rn FROM f WHERE known_at <= DATE '{DAY}') SELECT company_id, metric, observed_at, revision, value FROM k WHERE rn = 1")
def a22(spark, d):
    keys = ["company_id", "metric", "observed_at"]
    return research.latest_visible(_facts(spark, d), keys, day(), ["known_at"], ["revision"]).select(*keys, "revision", "value")


@query("a23_latest_standardised", _FACTS + f", k AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric ORDER BY observed_at DESC, known_at DESC, revision DESC) AS rn FROM f WHERE known_at <= DATE '{DAY}') SELECT company_id, metric, observed_at, value FROM k WHERE rn = 1")
def a23(spark, d):
    return research.latest_visible(_facts(spark, d), ["company_id", "metric"], day(), ["known_at"], ["observed_at", "known_at", "revision"]).select("company_id", "metric", "observed_at", "value")


@query("f16_latest_fundamental", _FACTS + f", k AS (SELECT *, CASE WHEN revision % 3 > 0 THEN value * 2 END AS standardised, row_number() OVER (PARTITION BY company_id, metric ORDER BY observed_at DESC, known_at DESC, revision DESC) AS rn FROM f WHERE known_at <= DATE '{DAY}') SELECT company_id, metric, coalesce(standardised, value) AS value, standardised IS NOT NULL AS is_standardised FROM k WHERE rn = 1")
def f16(spark, d):
    facts = _facts(spark, d).withColumn("standardised", F.when(F.col("revision") % 3 > 0, F.col("value") * 2))
    last = research.latest_visible(facts, ["company_id", "metric"], day(), ["known_at"], ["observed_at", "known_at", "revision"])
    return last.select("company_id", "metric", F.coalesce("standardised", "value").alias("value"), F.col("standardised").isNotNull().alias("is_standardised"))


@query("a26_news_candidates_as_of", f"""WITH n AS (SELECT doc_id, coalesce(source, '') AS source, doc_id // 3 AS root_id, doc_id % 3 AS revision, lang, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS published_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 + (doc_id % 13) * 60) AS ingested_at FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, root_id ORDER BY revision DESC) AS rn FROM n WHERE published_at <= TIMESTAMP '{NOON}' AND ingested_at <= TIMESTAMP '{NOON}') SELECT source, root_id, k.doc_id, k.revision, quality FROM k JOIN labels USING (doc_id) WHERE rn = 1""")
def a26(spark, d):
    at = lambda m: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=m.cast("int"))
    doc = F.col("doc_id")
    n = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.floor(doc / 3).cast("long").alias("root_id"), (doc % 3).alias("revision"), at(doc * 37).alias("published_at"), at(doc * 37 + (doc % 13) * 60).alias("ingested_at"))
    last = research.latest_visible(n, ["source", "root_id"], moment(), ["published_at", "ingested_at"], ["revision"])
    return last.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("source", "root_id", "doc_id", "revision", "quality")


@query("a27_narrative_windows_as_of", _SOCIAL + f"""w AS (SELECT topic, time_bucket(INTERVAL '1 day', published_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS volume, count(DISTINCT author) AS authors FROM p GROUP BY 1, 2) SELECT * FROM w WHERE window_start + INTERVAL 1 DAY <= TIMESTAMP '{NOON}'""")
def a27(spark, d):
    w = text.narrative_windows(_posts(spark, d), "1 day").withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 DAY"))
    return research.visible(w, moment(), "window_end").select("topic", "window_start", "volume", "authors")


_TOPS = (("events", "event_id", "ts"), ("orders", "o_orderkey", "o_orderdate"), ("lineitem", "l_orderkey", "l_shipdate"))


@query("a34_latest_by_authority", " UNION ALL ".join(f"SELECT '{t}' AS authority, max({i}) AS id, max({a}) AS at FROM {t} WHERE {a} = (SELECT max({a}) FROM {t})" for t, i, a in _TOPS))
def a34(spark, d):
    out = None
    for t, i, a in _TOPS:
        top = table(spark, d, t).agg(F.max(F.struct(F.col(a).alias("at"), F.col(i).alias("id"))).alias("x")).select(F.lit(t).alias("authority"), "x.id", "x.at")
        out = top if out is None else out.unionByName(top)
    return out


@query("a35_approval_status", "SELECT user_id AS model_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY 1")
def a35(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("model_id"), F.col("event_type").alias("status"), "event_id")
    return asof.latest_value(e, ["model_id"], ["status", "event_id"], "event_id")


@query("a36_latest_reconciliation", "SELECT o_custkey AS account_id, o_orderkey AS reconciliation_id, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def a36(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account_id"), "o_orderdate", F.col("o_orderkey").alias("reconciliation_id"), F.col("o_orderstatus").alias("status"))
    return asof.latest_value(o, ["account_id"], ["reconciliation_id", "status"], "o_orderdate", "reconciliation_id")


@query("a37_portfolio_evidence_as_of", f"""SELECT 'holding' AS kind, o_custkey AS portfolio_id, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderdate <= TIMESTAMP '{DAY}' UNION ALL SELECT 'delivery', o_custkey, l_orderkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= TIMESTAMP '{DAY}'""")
def a37(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("portfolio_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at")).join(o.select("portfolio_id", "id"), "id")
    both = o.withColumn("kind", F.lit("holding")).unionByName(li.withColumn("kind", F.lit("delivery")))
    return research.visible(both, moment(DAY), "at").select("kind", "portfolio_id", "id", "at")


@query("a38_research_for_thesis", "SELECT t.item_id AS thesis_id, d.doc_id, d.source FROM documents d JOIN (SELECT item_id, item_id % 20 AS s FROM benchmark) t ON d.source = 'src' || t.s WHERE d.doc_id * 37 <= 14 * 1440 UNION ALL SELECT -1, doc_id, source FROM documents WHERE lang = 'en' AND doc_id * 37 <= 14 * 1440")
def a38(spark, d):
    docs = table(spark, d, "documents").where("doc_id * 37 <= 14 * 1440")
    theses = table(spark, d, "benchmark").select(F.col("item_id").alias("thesis_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    own = docs.select("doc_id", "source").join(theses, "source").select("thesis_id", "doc_id", "source")
    return own.unionByName(docs.where("lang = 'en'").select(F.lit(-1).cast("long").alias("thesis_id"), "doc_id", "source"))


@query("t7_events_by_entity_as_of", f"SELECT user_id AS entity_id, event_id, event_type, ts FROM events WHERE ts <= TIMESTAMP '{NOON}'")
def t7(spark, d):
    return research.visible(table(spark, d, "events"), moment(), "ts").select(F.col("user_id").alias("entity_id"), "event_id", "event_type", "ts")


@query("o15_evidence_by_strategy", "SELECT o_orderpriority AS strategy, o_orderkey AS evidence_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::INT AS position FROM orders")
def o15(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("evidence_id"), F.row_number().over(w).alias("position"))


@query("o14_provider_checks_due", f"SELECT user_id AS provider, max(ts) AS last_check, max(ts) + to_hours(user_id % 48 + 1) <= TIMESTAMP '2024-01-30' AS due, max(ts) + to_hours(2 * (user_id % 48 + 1)) <= TIMESTAMP '2024-01-30' AS overdue FROM events GROUP BY user_id")
def o14(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("provider")).agg(F.max("ts").alias("last_check"))
    every = (F.col("provider") % 48 + 1).cast("int")
    at = lambda k: F.col("last_check") + F.make_dt_interval(hours=every * k) <= F.lit("2024-01-30").cast("timestamp_ntz")
    return last.select("provider", "last_check", at(1).alias("due"), at(2).alias("overdue"))


# splits, evidence and metrics


@query("v1_chronological_splits", with_views("bars") + ", n AS (SELECT instrument_id, count(*) AS n FROM bars GROUP BY 1), a AS (SELECT *, greatest(1, floor(n * 0.6::DOUBLE)) AS a FROM n WHERE n >= 3) SELECT instrument_id, a::INT AS train_end, least(n - 1, greatest(a + 1, floor(n * 0.8::DOUBLE)))::INT AS validation_end, n::INT AS n FROM a")
def v1(spark, d):
    n = views.bars(spark, d).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
    return research.chronological_splits(n, "instrument_id", 0.6, 0.2)


@query("v4_protocol_check", "SELECT o_orderkey AS protocol_id, 10 + o_custkey % 40 AS test, 5 + o_orderkey % 60 AS step FROM orders WHERE 5 + o_orderkey % 60 < 10 + o_custkey % 40")
def v4(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("protocol_id"), (10 + F.col("o_custkey") % 40).alias("test"), (5 + F.col("o_orderkey") % 60).alias("step"))
    return p.where("step < test")  # held-out windows would overlap


@query("b6_extended_metrics", RUN_SQL + " SELECT strategy, instrument_id, round(CASE WHEN sqrt(avg(pow(least(net, 0), 2))) > 1e-15 THEN avg(net) / sqrt(avg(pow(least(net, 0), 2))) * sqrt(252) END, 6) AS sortino, round(exp(sum(ln(1 + net)) * 252 / count(*)) - 1, 6) AS annualised FROM run GROUP BY 1, 2")
def b6(spark, d):
    down = F.sqrt(F.avg(F.pow(F.least("net", F.lit(0.0)), F.lit(2))))
    m = _run(spark, d).groupBy("strategy", "instrument_id").agg(F.avg("net").alias("mean"), down.alias("down"), (F.exp(F.sum(F.log1p("net")) * 252 / F.count(F.lit(1))) - 1).alias("annualised"))
    return m.select("strategy", "instrument_id", r6(F.when(F.col("down") > 1e-15, F.col("mean") / F.col("down") * F.sqrt(F.lit(252.0))), "sortino"), r6(F.col("annualised"), "annualised"))


_PHI = lambda x: f"CASE WHEN {x} >= 0 THEN 1 - {_upper(x)} ELSE {_upper(x)} END"


def _upper(x):
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    return f"exp(-({x}) * ({x}) / 2) / 2.5066282746310002::DOUBLE * ({t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"


@query("v16_multiple_testing", f"""WITH t AS (SELECT c_nationkey AS family, c_custkey AS name, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 0.2 AS p, (c_custkey % 50) / 10.0::DOUBLE AS sharpe FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rank, count(*) OVER (PARTITION BY family) AS m FROM t),
    c AS (SELECT *, max(CASE WHEN p <= 0.05::DOUBLE * rank / m THEN p END) OVER (PARTITION BY family) AS cut FROM k), r AS (SELECT o_custkey AS name, count(*) AS runs, avg((o_orderstatus <> 'F')::INT) AS overfitting FROM orders GROUP BY 1),
    j AS (SELECT c.*, coalesce(p <= cut, false) AS discovery, runs, overfitting, sharpe * sqrt(greatest(2, runs) - 1) AS x, (sharpe - sqrt(2 * ln(m * 4))) * sqrt(greatest(2, runs) - 1) AS y FROM c JOIN r USING (name))
    SELECT family, name, discovery, round({_PHI('x')}, 6) AS probabilistic, round({_PHI('y')}, 6) AS deflated, round(overfitting, 6) AS overfitting, discovery AND overfitting <= 0.5 AND {_PHI('y')} >= 0.5 AS passed FROM j""")
def v16(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("name"))
    tests = c.withColumn("p", (F.col("name") * 7919 % 10007) / F.lit(10007.0) * 0.2).withColumn("sharpe", (F.col("name") % 50) / F.lit(10.0))
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderstatus") == "F").alias("passed")).join(c, "name")
    out = research.multiple_testing(tests, runs, "family", 4)
    return out.select("family", "name", "discovery", r6(F.col("probabilistic"), "probabilistic"), r6(F.col("deflated"), "deflated"), r6(F.col("overfitting"), "overfitting"), "passed")


@query("m2_economic_value", with_views("holdout") + " SELECT model_id, round(avg(CASE WHEN candidate >= 0.5::DOUBLE THEN predecessor - 0.3::DOUBLE ELSE 0 END), 6) AS value_after_cost, count(*) AS n FROM holdout GROUP BY 1")
def m2(spark, d):
    taken = F.when(F.col("candidate") >= 0.5, F.col("predecessor") - 0.3).otherwise(0.0)
    return views.holdout(spark, d).groupBy("model_id").agg(r6(F.avg(taken), "value_after_cost"), F.count(F.lit(1)).alias("n"))


# record comparison


_LOGS = """WITH l AS (SELECT l_suppkey AS account, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_quantity AS quantity FROM lineitem WHERE l_linenumber < 7), r AS (SELECT l_suppkey AS account, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 40 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS price,
    CASE WHEN l_orderkey % 90 = 1 THEN l_quantity + 1 ELSE l_quantity END AS quantity FROM lineitem WHERE l_linenumber < 7 AND l_orderkey % 500 <> 3)"""
_ARRIVED = "l_orderkey, l_linenumber, l_partkey, price, quantity"


@query("b15_compare_records", f"""{_LOGS}, a AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY {_ARRIVED})::INT AS position FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY {_ARRIVED})::INT AS position FROM r)
    SELECT * FROM (SELECT account, position, CASE WHEN a.l_orderkey IS NULL THEN 'MISSING_LEFT' WHEN b.l_orderkey IS NULL THEN 'MISSING_RIGHT' WHEN a.l_orderkey <> b.l_orderkey THEN 'L_ORDERKEY' WHEN a.l_partkey <> b.l_partkey THEN 'L_PARTKEY' WHEN abs(a.price - b.price) > 0.01 THEN 'PRICE' WHEN abs(a.quantity - b.quantity) > 0 THEN 'QUANTITY' END AS difference
    FROM a FULL JOIN b USING (account, position)) WHERE difference IS NOT NULL""")
def b15(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber < 7").select(F.col("l_suppkey").alias("account"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    key = F.col("l_orderkey")
    other = li.where(key % 500 != 3).withColumn("price", F.when(key % 40 == 0, F.col("price") + 1).otherwise(F.col("price"))).withColumn("quantity", F.when(key % 90 == 1, F.col("quantity") + 1).otherwise(F.col("quantity")))
    return research.compare_records(li, other, "account", _ARRIVED.split(", "), ["l_orderkey", "l_partkey"], {"price": 0.01, "quantity": 0.0})


@query("b16_reconcile_engines", """WITH a AS (SELECT l_suppkey AS account, l_partkey AS instrument, round(sum(l_quantity), 2) AS filled, round(sum(l_extendedprice), 2) AS equity FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS account, l_partkey AS instrument, round(sum(l_quantity), 2) AS filled, round(sum(l_extendedprice), 2) AS equity FROM lineitem WHERE l_orderkey % 100 <> 7 GROUP BY 1, 2),
    u AS (SELECT account, instrument, 'filled' AS measure, filled AS v FROM a UNION ALL SELECT account, instrument, 'equity', equity FROM a), w AS (SELECT account, instrument, 'filled' AS measure, filled AS v FROM b UNION ALL SELECT account, instrument, 'equity', equity FROM b)
    SELECT account, instrument, measure, coalesce(u.v, 0) AS "left", coalesce(w.v, 0) AS "right" FROM u FULL JOIN w USING (account, instrument, measure) WHERE abs(coalesce(u.v, 0) - coalesce(w.v, 0)) > CASE measure WHEN 'filled' THEN 0.001 ELSE 0.01 END""")
def b16(spark, d):
    li = table(spark, d, "lineitem")
    total = lambda rows: rows.groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("instrument")).agg(F.round(F.sum("l_quantity"), 2).alias("filled"), F.round(F.sum("l_extendedprice"), 2).alias("equity"))
    return research.reconcile_engines(total(li), total(li.where("l_orderkey % 100 <> 7")), ["account", "instrument"], {"filled": 0.001, "equity": 0.01})


# limits and screening


_PROJECTED = """WITH b AS (SELECT l_suppkey AS account, l_partkey AS instrument, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS held, CASE WHEN l_linestatus <> 'F' THEN CASE WHEN l_orderkey % 2 = 0 THEN l_quantity ELSE -l_quantity END ELSE 0 END AS ordered FROM lineitem),
    t AS (SELECT account, instrument, sum(held) AS held, sum(ordered) AS ordered FROM b GROUP BY 1, 2), q AS (SELECT t.*, held + ordered AS projected, p_retailprice AS price FROM t LEFT JOIN (SELECT * FROM part WHERE p_partkey % 17 <> 4) p ON p_partkey = instrument)"""


def _projected(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("instrument"), "l_linestatus", "l_orderkey", F.col("l_quantity").alias("quantity"))
    orders = li.where("l_linestatus <> 'F'").withColumn("quantity", F.when(F.col("l_orderkey") % 2 == 0, F.col("quantity")).otherwise(-F.col("quantity")))
    prices = table(spark, d, "part").where("p_partkey % 17 <> 4").select(F.col("p_partkey").alias("instrument"), F.col("p_retailprice").alias("price"))  # some have none
    return research.projected_exposures(li.where("l_linestatus = 'F'"), orders, prices, ["account"], "instrument")


@query("p21_projected_exposures", _PROJECTED + " SELECT account, instrument, held, ordered, projected, round(projected * price, 2) AS notional, price IS NOT NULL AS priced FROM q")
def p21(spark, d):
    return _projected(spark, d).select("account", "instrument", "held", "ordered", "projected", F.round("notional", 2).alias("notional"), "priced")


@query("p23_pretrade_screening", _PROJECTED + """, e AS (SELECT q.*, s_acctbal, projected * price AS notional FROM q JOIN supplier ON s_suppkey = account), r AS (SELECT account, instrument, concat_ws(',', CASE WHEN price IS NULL THEN 'price_unavailable' END, CASE WHEN NOT coalesce(abs(projected * price) <= 60000, false) THEN 'instrument_notional_limit' END,
    CASE WHEN NOT coalesce(abs(ordered) <= 80, false) THEN 'order_quantity_limit' END, CASE WHEN NOT coalesce(projected >= 0, false) THEN 'short_selling_not_permitted' END, CASE WHEN NOT coalesce(s_acctbal > 0, false) THEN 'account_not_funded' END) AS reasons FROM e)
    SELECT account, instrument, reasons, CASE WHEN reasons = '' THEN 'APPROVE' ELSE 'REJECT' END AS decision FROM r""")
def p23(spark, d):
    accounts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), "s_acctbal")
    checks = {
        "price_unavailable": F.col("priced"), "instrument_notional_limit": F.abs("notional") <= 60000, "order_quantity_limit": F.abs("ordered") <= 80,
        "short_selling_not_permitted": F.col("projected") >= 0, "account_not_funded": F.col("s_acctbal") > 0,
    }
    return research.screen(_projected(spark, d).join(accounts, "account"), checks).select("account", "instrument", "reasons", "decision")


# evidence decisions


@query("t5_research_candidates", """WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'WITHDRAWN' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'ACCEPTED' END AS status, (n_chars % 101) / 100.0::DOUBLE AS credibility FROM documents)
    SELECT doc_id, CASE coalesce(status, 'BLOCKED') WHEN 'WITHDRAWN' THEN 'WITHDRAW' WHEN 'BLOCKED' THEN 'REDUCE' ELSE 'MAINTAIN' END AS action, CASE WHEN status = 'ACCEPTED' THEN credibility ELSE 0 END AS maximum_confidence FROM a""")
def t5(spark, d):
    k = F.col("doc_id") % 4
    a = table(spark, d, "documents").select("doc_id", F.when(k == 0, "WITHDRAWN").when(k == 1, "BLOCKED").when(k == 2, "ACCEPTED").alias("status"), ((F.col("n_chars") % 101) / F.lit(100.0)).alias("credibility"))
    return research.research_candidates(a).select("doc_id", "action", "maximum_confidence")


@query("v20_promotion_eligible", """WITH l AS (SELECT DISTINCT l_orderkey AS scorecard_id, l_partkey AS package_id, l_returnflag AS package_content_hash FROM lineitem),
    p AS (SELECT p_partkey AS package_id, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS content_hash FROM part WHERE p_size % 4 <> 0),
    g AS (SELECT DISTINCT scorecard_id FROM l JOIN p USING (package_id) WHERE content_hash = package_content_hash)
    SELECT o_orderkey AS scorecard_id, coalesce(o_orderkey % 7 <> 0 AND o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderkey IN (SELECT scorecard_id FROM g), false) AS eligible FROM orders""")
def v20(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "REVIEW_REQUIRED").otherwise("DRAFT")
    cards = o.select(F.col("o_orderkey").alias("scorecard_id"), F.col("o_custkey").alias("strategy_version"), F.col("o_orderpriority").alias("dataset_version"), F.lit("costs-1").alias("cost_model_version"), status.alias("status"), F.when(F.col("o_custkey") % 5 == 0, "BLOCKED").otherwise("HEALTHY").alias("health_status"))
    asked = cards.select("scorecard_id", "strategy_version", "dataset_version", F.when(F.col("scorecard_id") % 7 == 0, "costs-2").otherwise("costs-1").alias("cost_model_version"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scorecard_id"), F.col("l_partkey").alias("package_id"), F.col("l_returnflag").alias("package_content_hash"))
    k = F.col("p_partkey") % 3
    packages = table(spark, d, "part").select(F.col("p_partkey").alias("package_id"), F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("content_hash"), F.when(F.col("p_size") % 4 != 0, "VERIFIED").otherwise("TAMPERED").alias("integrity_status"))
    return research.promotion_eligible(asked, cards, links, packages).select("scorecard_id", "eligible")


@query("i7_analysis_status", """WITH f AS (SELECT o_custkey AS company_id, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS quality, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS valuation, min(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS drift, min(o_totalprice) < 20000 AS breached FROM orders GROUP BY 1),
    e AS (SELECT f.*, CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE 'HEALTHY' END AS health FROM f LEFT JOIN customer ON c_custkey = company_id),
    r AS (SELECT company_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'company_quality_unavailable' END, CASE WHEN valuation IS NULL THEN 'valuation_unavailable' END, CASE WHEN drift IS NULL THEN 'thesis_drift_unavailable' END, CASE WHEN breached THEN 'thesis_invalidation_breached' END, CASE WHEN coalesce(health <> 'HEALTHY', true) THEN 'data_health_blocked' END) AS reasons FROM e)
    SELECT company_id, reasons, CASE WHEN reasons = '' THEN 'READY' ELSE 'BLOCKED' END AS status FROM r""")
def i7(spark, d):
    price, kind = F.col("o_totalprice"), F.col("o_orderpriority")
    facts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", price)).alias("quality"), F.max(F.when(kind == "1-URGENT", price)).alias("valuation"), F.min(F.when(kind == "5-LOW", price)).alias("drift"), (F.min(price) < 20000).alias("breached")
    )
    health = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") < 0, "BLOCKED").when(F.col("c_acctbal").isNotNull(), "HEALTHY").alias("health"))
    return research.analysis_status(facts.join(health, "company_id", "left")).select("company_id", "reasons", "status")
