"""Queries on raw observations: payloads of five kinds and their resolution to instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resolution
from tidemark.plans.registry import query
from tidemark.sources.views import table

_KIND = {"view": "OHLCV", "click": "DIVIDEND", "purchase": "SPLIT", "signup": "SYMBOL_CHANGE"}


def _raw(spark, d):
    """Events as raw observations: what an event has becomes the text fields of its kind's payload, right or wrong."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("v", F.col("value").cast("decimal(18,2)").cast("string"))
    kind = F.lit("DELISTING")
    for a, b in _KIND.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    text = lambda c: F.col(c).cast("string")
    every = {
        "open": F.col("v"), "high": F.coalesce("k", F.lit("n/a")), "low": (F.col("value") - F.col("event_id") % 7).cast("decimal(18,2)").cast("string"), "close": F.col("v"), "volume": (F.col("user_id") % 11 - 1).cast("string"),
        "interval": F.when(F.col("event_id") % 13 > 0, "1d").otherwise(" "), "amount": (F.col("event_id") % 9 - 1).cast("string"), "currency": F.when(F.col("event_id") % 6 > 0, "usd").otherwise("dollar"),
        "ratio": F.when(F.col("event_id") % 8 > 0, (F.col("event_id") % 5).cast("string")).otherwise("two"), "old_symbol": (F.col("event_id") % 4).cast("string"), "new_symbol": (F.col("user_id") % 4).cast("string"), "reason": F.when(F.col("event_id") % 3 > 0, "merger").otherwise(""),
    }
    payload = F.create_map(*(x for n, c in every.items() for x in (F.lit(n), c)))
    payload = F.when(F.col("event_id") % 2 == 0, F.map_concat(payload, F.create_map(F.lit("cash_out_price"), F.when(F.col("event_id") % 10 > 0, (F.col("event_id") % 12 - 2).cast("string")).otherwise("")))).otherwise(payload)
    return e.select(
        F.col("event_id").alias("raw_id"), kind.alias("kind"), F.lit("user").alias("namespace"), text("user_id").alias("identifier"), F.concat(F.lit("V"), F.col("event_id") % 3).alias("exchange"),
        F.col("ts").alias("event_at"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 60).cast("int"))).alias("ingested_at"), payload.alias("payload"),
    )


_RAW = """raw AS (SELECT event_id AS id, user_id AS u, event_type AS ty, ts AS event_at, ts + to_hours(CAST(event_id % 60 AS INT)) AS known, 'V' || (event_id % 3) AS exchange, CAST(value AS DECIMAL(18, 2)) AS v, json_extract_string(props, '$.k') AS k, value FROM events),
fields AS (SELECT *, TRY_CAST(coalesce(k, 'n/a') AS DECIMAL(30, 12)) AS hi, CAST(value - id % 7 AS DECIMAL(18, 2)) AS lo, u % 11 - 1 AS vol, id % 9 - 1 AS amount, CASE WHEN id % 8 > 0 THEN id % 5 END AS ratio, CASE WHEN id % 10 > 0 THEN id % 12 - 2 END AS price, id % 2 = 0 AS priced FROM raw),
checked AS (SELECT *, CASE ty
    WHEN 'view' THEN [CASE WHEN hi IS NULL THEN 'invalid_high' END, CASE WHEN id % 13 = 0 THEN 'invalid_interval' END, CASE WHEN hi IS NOT NULL AND (v <= 0 OR hi <= 0 OR lo <= 0) THEN 'non_positive_price' END, CASE WHEN hi IS NOT NULL AND (hi < v OR lo > v) THEN 'impossible_ohlc' END, CASE WHEN vol < 0 THEN 'negative_volume' END]
    WHEN 'click' THEN [CASE WHEN amount < 0 THEN 'negative_dividend' END, CASE WHEN id % 6 = 0 THEN 'invalid_currency' END]
    WHEN 'purchase' THEN [CASE WHEN ratio IS NULL THEN 'invalid_ratio' END, CASE WHEN ratio <= 0 THEN 'non_positive_split_ratio' END]
    WHEN 'signup' THEN [CASE WHEN id % 4 = u % 4 THEN 'invalid_symbol_change' END]
    ELSE [CASE WHEN id % 3 = 0 THEN 'invalid_delisting_reason' END, CASE WHEN priced AND price IS NULL THEN 'invalid_cash_out_price' END, CASE WHEN priced AND price < 0 THEN 'negative_cash_out_price' END] END AS issues,
    CASE ty WHEN 'view' THEN 'close=' || t(v) || ',high=' || coalesce(t(hi), '') || ',interval=' || CASE WHEN id % 13 > 0 THEN '1d' ELSE '' END || ',low=' || t(lo) || ',open=' || t(v) || ',volume=' || vol
    WHEN 'click' THEN 'amount=' || amount || ',currency=' || CASE WHEN id % 6 > 0 THEN 'USD' ELSE 'DOLLAR' END WHEN 'purchase' THEN 'ratio=' || coalesce(ratio::VARCHAR, '') WHEN 'signup' THEN 'new_symbol=' || (u % 4) || ',old_symbol=' || (id % 4)
    ELSE CASE WHEN priced THEN 'cash_out_price=' || coalesce(price::VARCHAR, '') || ',' ELSE '' END || 'reason=' || CASE WHEN id % 3 > 0 THEN 'merger' ELSE '' END END AS normalized FROM fields)"""
# plain text of a number: no zeros at its end
_RAW = _RAW.replace("t(hi)", "regexp_replace(regexp_replace(hi::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')").replace("t(v)", "regexp_replace(regexp_replace(v::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')").replace("t(lo)", "regexp_replace(regexp_replace(lo::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")


def _flat(column: str):
    return F.array_join(F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.col(column)[k], F.lit("")))), ",")


@query("q17_normalize_payload", f"WITH {_RAW} SELECT id AS raw_id, normalized, array_to_string(list_filter(issues, lambda x: x IS NOT NULL), ',') AS issues FROM checked")
def q17(spark, d):
    rows = resolution.normalize_payload(_raw(spark, d))
    return rows.select("raw_id", _flat("normalized").alias("normalized"), F.array_join("payload_issues", ",").alias("issues"))


@query("q18_normalize_observations", f"""WITH {_RAW},
m AS (SELECT user_id AS u, user_id * 10 + event_id % 5 AS instrument_id, ts AS a, ts + INTERVAL 12 DAY AS b, ts + INTERVAL 1 DAY AS known FROM events WHERE event_type IN ('signup', 'view')),
gone AS (SELECT user_id * 10 + event_id % 5 AS instrument_id, ts AS e, ts + INTERVAL 2 HOUR AS g FROM events WHERE event_type = 'error'),
hit AS (SELECT r.id, m.instrument_id FROM raw r JOIN m ON m.u = r.u AND m.a <= r.event_at AND r.event_at < m.b AND m.known <= r.known WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.instrument_id = m.instrument_id AND gone.e <= r.event_at AND gone.g <= r.known)),
res AS (SELECT id, count(h.instrument_id) AS n, min(h.instrument_id) AS one FROM raw LEFT JOIN hit h USING (id) GROUP BY id),
j AS (SELECT c.*, n, CASE WHEN n = 1 THEN one END AS instrument_id FROM checked c JOIN res USING (id)),
f AS (SELECT *, instrument_id % 10 < 4 AS in_scope, list_filter(list_prepend(CASE WHEN exchange NOT IN ('V' || instrument_id % 3, 'M' || instrument_id % 3) THEN 'exchange_instrument_mismatch' END, issues), lambda x: x IS NOT NULL) AS found FROM j)
SELECT id AS raw_id, instrument_id, CASE WHEN n <> 1 THEN 'UNRESOLVED' WHEN NOT in_scope THEN 'OUT_OF_SCOPE' WHEN len(found) > 0 THEN 'REJECTED' ELSE 'VALIDATED' END AS status,
CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN NOT in_scope THEN 'historical_source_asset_out_of_scope' ELSE array_to_string(found, ',') END AS issues, CASE WHEN n = 1 AND in_scope THEN normalized END AS normalized FROM f""")
def q18(spark, d):
    e = table(spark, d, "events")
    instrument = (F.col("user_id") * 10 + F.col("event_id") % 5).alias("instrument_id")
    mappings = e.where("event_type IN ('signup', 'view')").select(F.lit("user").alias("namespace"), F.col("user_id").cast("string").alias("identifier"), instrument, F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 12 DAY")).alias("valid_until"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ingested_at"))
    delistings = e.where("event_type = 'error'").select(instrument, F.col("ts").alias("effective_at"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("ingested_at"))
    ident = F.col("instrument_id")
    instruments = mappings.select("instrument_id").distinct().select("instrument_id", F.when(ident % 10 < 2, "EQUITY").when(ident % 10 < 4, "ETF").otherwise("BOND").alias("asset_class"), F.concat(F.lit("V"), ident % 3).alias("venue"), F.concat(F.lit("M"), ident % 3).alias("mic"))
    out = resolution.normalize_observations(_raw(spark, d), mappings, delistings, instruments)
    return out.select("raw_id", "instrument_id", "status", F.array_join("issues", ",").alias("issues"), _flat("normalized").alias("normalized"))
