"""Adapter views: market-research tables over the star-schema files, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a trade: instrument, provider, day, px, qty and the arrival order's columns."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("p_brand").alias("instrument_id"), F.col("l_returnflag").alias("provider"), F.to_date("l_shipdate").alias("day"),
        (F.lit(100) + F.col("l_extendedprice") % 20).alias("px"), F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
    )


ARRIVAL = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")


def roll_up(trades: DataFrame, *keys: str) -> DataFrame:
    """Daily open, high, low, close, volume and trades by ``keys``."""
    order = F.struct(*ARRIVAL)
    return trades.groupBy(*keys, "day").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"),
        F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(raw_bars(spark, sf_dir), "instrument_id")


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(raw_bars(spark, sf_dir), "instrument_id", "provider")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close-to-close returns by instrument; the first day of each has none."""
    w = Window.partitionBy("instrument_id").orderBy("day")
    return bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).where("r IS NOT NULL").select("instrument_id", "day", "r")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("quote_id"), F.col("user_id").alias("instrument_id"), (F.col("value") + 1).alias("last"),
        F.col("ts").alias("observed_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))).alias("ingested_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("instrument_id"), F.col("ts").alias("decided_at"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("o_orderpriority").alias("portfolio_id"), F.col("o_orderkey").alias("position_id"),
        (F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("notional"),
        F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"), F.col("r_name").alias("currency"),
    )


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(d, "doc_id").select(
        F.col("lang").alias("model_id"), F.col("doc_id").alias("observation_id"), F.col("quality").alias("outcome"),
        ((F.col("n_chars") % 97) / F.lit(96.0)).alias("candidate"), ((F.col("doc_id") % 10) / F.lit(9.0)).alias("predecessor"),
    )


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("mapping_id"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"))
    return v.where("valid_until IS NULL OR valid_until > valid_from").withColumnRenamed("o_custkey", "symbol")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_partkey", F.trunc("l_shipdate", "month")).orderBy(*ARRIVAL)
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("instrument_id"), F.trunc("l_shipdate", "month").alias("period"), F.row_number().over(w).alias("revision"),
        F.col("l_extendedprice").alias("value"), F.expr("date_add(to_date(l_shipdate), cast(l_linenumber AS int))").alias("known_at"),
    )


SQL = {
    "trades": """trades AS (SELECT p.p_brand AS instrument_id, l.l_returnflag AS provider, CAST(l.l_shipdate AS DATE) AS day, 100 + (l.l_extendedprice % 20) AS px, l.l_quantity AS qty,
        l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "bars": """bars AS (SELECT instrument_id, day, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close, sum(qty) AS volume, count(*) AS trades
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, day ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS rn FROM trades) GROUP BY instrument_id, day)""",
    "provider_bars": """provider_bars AS (SELECT instrument_id, provider, day, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close, sum(qty) AS volume, count(*) AS trades
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, provider, day ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS rn FROM trades) GROUP BY instrument_id, provider, day)""",
    "returns": """returns AS (SELECT instrument_id, day, r FROM (SELECT instrument_id, day, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY day) - 1 AS r FROM bars) WHERE r IS NOT NULL)""",
    "quotes": """quotes AS (SELECT event_id AS quote_id, user_id AS instrument_id, value + 1 AS last, ts AS observed_at, ts + to_minutes(event_id % 7) AS ingested_at FROM events)""",
    "decisions": """decisions AS (SELECT event_id AS decision_id, user_id AS instrument_id, ts AS decided_at FROM events WHERE event_type = 'purchase')""",
    "exposures": """exposures AS (SELECT o_orderpriority AS portfolio_id, o_orderkey AS position_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS notional,
        c_mktsegment AS sector, n_name AS country, r_name AS currency FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "holdout": """holdout AS (SELECT lang AS model_id, doc_id AS observation_id, quality AS outcome, (n_chars % 97) / 96.0::DOUBLE AS candidate, (doc_id % 10) / 9.0::DOUBLE AS predecessor FROM labels JOIN documents USING (doc_id))""",
    "validity": """validity AS (SELECT * FROM (SELECT o_custkey AS symbol, o_orderkey AS mapping_id, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders)
        WHERE valid_until IS NULL OR valid_until > valid_from)""",
    "revisions": """revisions AS (SELECT l_partkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
        row_number() OVER (PARTITION BY l_partkey, date_trunc('month', l_shipdate) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS revision,
        l_extendedprice AS value, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS known_at FROM lineitem)""",
}
_NEEDS = {"bars": ("trades",), "provider_bars": ("trades",), "returns": ("trades", "bars")}


def with_views(*names: str) -> str:
    """``WITH`` and the named views in SQL, with those that they need."""
    order = [n for name in names for n in (*_NEEDS.get(name, ()), name)]
    return "WITH " + ", ".join(SQL[n] for n in dict.fromkeys(order))
