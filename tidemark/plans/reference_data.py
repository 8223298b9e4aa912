"""Queries on point-in-time reads, identity, text, operations and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import asof, execution, resolution, text
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import table, with_views
from tidemark.streaming import jobs


def r6(c, name):
    return F.round(c, 6).alias(name)


DAY = "1996-06-30"


def _known(spark, d):
    return views.revisions(spark, d).where(F.col("known_at") <= F.lit(DAY).cast("date"))


@query("a1_available_all_revisions", with_views("revisions") + f" SELECT instrument_id, count(*) AS n, max(known_at) AS latest FROM revisions WHERE known_at <= DATE '{DAY}' GROUP BY 1")
def a1(spark, d):
    return _known(spark, d).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.max("known_at").alias("latest"))


_LATEST = with_views("revisions") + f", l AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, period ORDER BY revision DESC) AS rn FROM revisions WHERE known_at <= DATE '{DAY}')"


@query("a3_fundamentals_as_of", _LATEST + " SELECT instrument_id, period, revision::INT AS revision, value, known_at FROM l WHERE rn = 1")
def a3(spark, d):
    return asof.latest_by(_known(spark, d), ["instrument_id", "period"], F.desc("revision")).select("instrument_id", "period", "revision", "value", "known_at")


@query("a4_revision_history", with_views("revisions") + " SELECT instrument_id, period, revision::INT AS revision, value, round(value - lag(value) OVER (PARTITION BY instrument_id, period ORDER BY revision), 6) AS change FROM revisions")
def a4(spark, d):
    w = Window.partitionBy("instrument_id", "period").orderBy("revision")
    return views.revisions(spark, d).select("instrument_id", "period", "revision", "value", r6(F.col("value") - F.lag("value").over(w), "change"))


@query("a5_macro_as_of", _LATEST + " SELECT instrument_id, period, value FROM l WHERE rn = 1")
def a5(spark, d):
    return asof.latest_value(_known(spark, d), ["instrument_id", "period"], ["value"], "revision")


@query("a10_resolve_symbol", with_views("validity") + """ SELECT o.o_orderkey AS request_id, v.mapping_id FROM orders o LEFT JOIN validity v ON v.symbol = o.o_custkey AND v.valid_from <= o.o_orderdate AND (v.valid_until IS NULL OR o.o_orderdate < v.valid_until)""")
def a10(spark, d):
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("at"))
    return resolution.resolve_at(req, views.validity(spark, d), "request_id", "symbol", "at", "valid_from", "valid_until", "mapping_id").select("request_id", "mapping_id")


@query("a11_resolve_identifier", with_views("validity") + """, j AS (SELECT o.o_orderkey AS request_id, count(v.mapping_id) AS n, min(v.mapping_id) AS mapping_id FROM orders o LEFT JOIN validity v ON v.symbol = o.o_custkey AND v.valid_from <= o.o_orderdate - INTERVAL 200 DAY
    AND (v.valid_until IS NULL OR o.o_orderdate - INTERVAL 200 DAY < v.valid_until) GROUP BY 1) SELECT request_id, CASE n WHEN 1 THEN 'RESOLVED' WHEN 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN mapping_id END AS mapping_id FROM j""")
def a11(spark, d):
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("symbol"), (F.col("o_orderdate") - F.expr("INTERVAL 200 DAY")).alias("at"))
    return resolution.resolve_at(req, views.validity(spark, d), "request_id", "symbol", "at", "valid_from", "valid_until", "mapping_id")


@query("a15_latest_quote", with_views("quotes", "decisions") + """ SELECT decision_id, quote_id, last FROM (SELECT d.decision_id, q.quote_id, q.last, row_number() OVER (PARTITION BY d.decision_id ORDER BY q.observed_at DESC, q.quote_id DESC) AS rn
    FROM decisions d LEFT JOIN quotes q ON q.instrument_id = d.instrument_id AND q.observed_at <= d.decided_at) WHERE rn = 1""")
def a15(spark, d):
    q = views.quotes(spark, d).select("instrument_id", "observed_at", "quote_id", "last", F.col("quote_id").alias("seq"))
    out = asof.as_of_join(views.decisions(spark, d), q, "instrument_id", "decided_at", "observed_at", ["quote_id", "last"], "seq")
    return out.select("decision_id", "quote_id", "last")


@query("a17_quotes_available", with_views("quotes") + " SELECT instrument_id, count(*) AS n, max(observed_at) AS latest FROM quotes WHERE observed_at <= TIMESTAMP '2024-01-15' AND ingested_at <= TIMESTAMP '2024-01-15' GROUP BY 1")
def a17(spark, d):
    t = F.lit("2024-01-15").cast("timestamp_ntz")
    return asof.known_at(views.quotes(spark, d), t, "observed_at", "ingested_at").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("latest"))


@query("a29_latest_holdings", "SELECT o_custkey, o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) USING (o_custkey) WHERE o_orderdate = m")
def a29(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return o.join(last, "o_custkey").where("o_orderdate = m").select("o_custkey", "o_orderkey")  # keeps ties


@query("a33_paged_projection", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def a33(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("q16_overlapping_validity", with_views("validity") + """, v AS (SELECT symbol, mapping_id, valid_from, valid_until + INTERVAL 30 DAY AS valid_until FROM validity), w AS (SELECT *, max(coalesce(valid_until, TIMESTAMP '9999-12-31')) OVER (PARTITION BY symbol ORDER BY valid_from, mapping_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v) SELECT symbol, mapping_id FROM w WHERE valid_from < reach""")
def q16(spark, d):
    v = views.validity(spark, d).withColumn("valid_until", F.col("valid_until") + F.expr("INTERVAL 30 DAY"))
    return asof.overlapping_validity(v, "symbol", "valid_from", "valid_until", "mapping_id").select("symbol", "mapping_id")


# identity and sources


@query("c3_replay_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS contents FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def c3(spark, d):
    rows = table(spark, d, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return identity.replay_conflicts(rows, "id", F.col("l_partkey")).select("id.l_orderkey", "id.l_linenumber", "contents")


@query("s5_scan_bars", "SELECT l_orderkey, l_shipdate, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def s5(spark, d):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "lineitem").where(F.col("l_shipdate").between(ts("1995-01-01"), ts("1995-03-31"))).select("l_orderkey", "l_shipdate", "l_extendedprice")


_S8_JSON = """'{"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}'"""


@query("s8_capture_append", f"""WITH rows AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, sha256({_S8_JSON}) AS h FROM lineitem),
    held AS (SELECT l_orderkey, l_linenumber, h AS held FROM rows WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY h) = 1),
    r AS (SELECT rows.*, held, coalesce(held, min(h) OVER (PARTITION BY l_orderkey, l_linenumber)) AS known FROM rows LEFT JOIN held USING (l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN h <> known THEN 'CONFLICT' ELSE 'INSERT' END AS outcome FROM r WHERE h <> known OR held IS NULL""")
def s8(spark, d):
    key, rows = ["l_orderkey", "l_linenumber"], table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    known, _ = jobs.capture(rows.where("l_returnflag = 'A'"), None, key)
    return jobs.judged(rows, known, key).where("outcome <> 'KNOWN'").select(*rows.columns, "outcome")



# text


@query("t1_strip_markup", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM pages")
def t1(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("t1_sanitize_text")
def t1_sanitize(spark, d):
    clean = table(spark, d, "pages").select("page_id", text.sanitize(F.col("html")).alias("s"))
    return clean.select("page_id", "s.text", F.array_join("s.flags", ",").alias("flags"))


@query("t3_duplicate_clusters", "SELECT sha256(text) AS cluster_id, min(doc_id) AS canonical_id, count(*) AS members FROM documents GROUP BY 1")
def t3(spark, d):
    news = table(spark, d, "documents").withColumn("published_at", F.col("doc_id"))  # published in order of id
    return text.duplicate_clusters(news)


_SOCIAL = "WITH p AS (SELECT event_type AS topic, user_id AS author, ts AS published_at, greatest(-1, least(1, CAST(value AS DECIMAL(18, 2)) * 0.004 - 1))::DECIMAL(18, 6) AS sentiment FROM events), "


def _posts(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("user_id").alias("author"), F.col("ts").alias("published_at"), F.expr("cast(greatest(-1, least(1, cast(value AS DECIMAL(18, 2)) * 0.004 - 1)) AS DECIMAL(18, 6))").alias("sentiment"))


@query("t9_topic_clusters", _SOCIAL + "x AS (SELECT 1) SELECT topic, count(*) AS posts, count(DISTINCT author) AS authors FROM p GROUP BY 1")
def t9(spark, d):
    return _posts(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("author").alias("authors"))


# operations


@query("o1_sli_windows", """WITH t AS (SELECT (user_id % 5)::BIGINT AS service, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, count(*) AS total, sum((event_type <> 'error')::INT)::BIGINT AS good FROM events GROUP BY 1, 2)
    SELECT service, w AS window_start, total, good, round(good / total, 6) AS sli, CASE WHEN row_number() OVER (PARTITION BY service ORDER BY w) > 3 THEN 'MEASURED' ELSE 'UNAVAILABLE' END AS state FROM t""")
def o1(spark, d):
    e = table(spark, d, "events")
    by = e.groupBy((F.col("user_id") % 5).alias("service"), F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("good"))
    n = F.row_number().over(Window.partitionBy("service").orderBy("w"))
    return by.select("service", F.col("w.start").alias("window_start"), "total", "good", r6(F.col("good") / F.col("total"), "sli"), F.when(n > 3, "MEASURED").otherwise("UNAVAILABLE").alias("state"))


@query("o3_alert_sessions", """WITH s AS (SELECT user_id, ts, event_id, event_type, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM events)
    SELECT user_id, session, min(ts) AS opened_at, count(*) AS events FROM s GROUP BY 1, 2""")
def o3(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, d, "events").withColumn("session", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w), F.lit(0)))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("opened_at"), F.count(F.lit(1)).alias("events"))


@query("o9_cost_report", """SELECT coalesce(o_orderpriority, 'TOTAL') AS category, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, date_trunc('month', o_orderdate)), (date_trunc('month', o_orderdate)))""")
def o9(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    sets = o.groupingSets([[F.col("o_orderpriority"), F.col("month")], [F.col("month")]], "o_orderpriority", "month")
    return sets.agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("category"), "month", "total", "n")


@query("o12_recent_events", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def o12(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("e11_sequence_gaps", "SELECT user_id, before, after, CASE WHEN after = before THEN 'DUPLICATE' ELSE 'GAP' END AS kind FROM (SELECT user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_id AS after FROM events) WHERE after - before <> 1")
def e11(spark, d):
    return execution.sequence_gaps(table(spark, d, "events"), "user_id", "event_id")
