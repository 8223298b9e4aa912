"""Readers of landed files: daily bars, return pages, company facts and evidence pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "date date, open decimal(30,12), high decimal(30,12), low decimal(30,12), close decimal(30,12), volume decimal(30,12)"
OBSERVATION = "observation_id string, account_id string, period_start timestamp, period_end timestamp, return_fraction double"
PAGE = f"observations array<struct<{OBSERVATION.replace(' ', ':').replace(',:', ',')}>>, next_cursor string"
UNIT = "struct<start:string,end:string,val:double,filed:string,form:string,accn:string>"
FACTS = f"entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{UNIT}>>>>>"

EVIDENCE = "facts array<struct<instrument_id:string,metric:string,value:string,unit:string,observed_at:string,available_at:string,source_identifier:string,source_url:string,revision:int>>, next_cursor string"
OFFSET = r"(Z|[+-]\d\d:\d\d)$"


def read_daily_bars_csv(spark: SparkSession, path: str, zone: str, close_time: str, start: str, end: str) -> DataFrame:
    """Date-only bars at the local market close in UTC, inside [start, end], close above 0; a malformed row fails."""
    raw = spark.read.schema(BARS).option("header", True).option("mode", "FAILFAST").csv(path)
    local = F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(close_time)))
    at = raw.withColumn("event_at", F.to_utc_timestamp(local, zone))
    return at.where(F.col("event_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (F.col("close") > 0))


def read_return_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row an observation of landed pages; the period must run forward and the return be above -1."""
    rows = spark.read.schema(PAGE).json(path).select(F.inline("observations"))
    return rows.withColumn("valid", F.coalesce((F.col("period_end") > F.col("period_start")) & (F.col("return_fraction") > -1), F.lit(False)))


def read_company_facts(spark: SparkSession, path: str, concepts: DataFrame) -> DataFrame:
    """``entity, taxonomy, concept, period_start, period_end, value, filed, available_at`` of wanted concepts in USD.

    Available the day after filing. ``concepts`` (concept) is joined, not broadcast by hint.
    """
    top = spark.read.schema(FACTS).json(path).select(F.col("entityName").alias("entity"), F.explode("facts").alias("taxonomy", "by_concept"))
    each = top.select("entity", "taxonomy", F.explode("by_concept").alias("concept", "fact")).join(concepts, "concept")
    rows = each.select("entity", "taxonomy", "concept", F.inline(F.col("fact.units")["USD"]))
    filed = F.to_date("filed")
    return rows.select("entity", "taxonomy", "concept", F.to_date("start").alias("period_start"), F.to_date("end").alias("period_end"), F.col("val").alias("value"), filed.alias("filed"), F.date_add(filed, 1).alias("available_at"))


def read_evidence_pages(spark: SparkSession, path: str, instrument_id: str, provider: str) -> DataFrame:
    """One row a fact of landed pages, with its provenance and ``issue``, null where it may be used.

    A fact without an instrument is of the one asked for, one without a revision is of revision 0.
    Times must carry an offset; the source must be an https address.
    """
    raw = spark.read.schema(EVIDENCE).json(path).select(F.inline("facts"))
    zoned = F.col("observed_at").rlike(OFFSET) & F.col("available_at").rlike(OFFSET)
    issue = (
        F.when(F.coalesce("instrument_id", F.lit(instrument_id)) != instrument_id, "instrument_mismatch").when(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "source_url_requires_https")
        .when(~F.coalesce(zoned, F.lit(False)), "time_without_zone").when(F.col("metric").isNull() | F.expr("try_cast(value AS decimal(30,12))").isNull() | F.col("unit").isNull() | F.col("source_identifier").isNull(), "invalid_fact")
    )
    return raw.select(
        F.coalesce("instrument_id", F.lit(instrument_id)).alias("instrument_id"), "metric", F.expr("try_cast(value AS decimal(30,12))").alias("value"), "unit", F.expr("try_cast(observed_at AS timestamp)").alias("observed_at"), F.expr("try_cast(available_at AS timestamp)").alias("available_at"),
        "source_identifier", "source_url", F.coalesce("revision", F.lit(0)).alias("revision"), F.lit(provider).alias("provider"), issue.alias("issue"),
    )


def combine_pages(pages: list[DataFrame], most: int = 1000) -> DataFrame:
    """The union of provider pages by name; more pages than the bound are refused."""
    if not pages or len(pages) > most:
        raise ValueError(f"between 1 and {most} pages")
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def seal_dataset(members: DataFrame, path: str, row_hash, created_at) -> DataFrame:
    """Write validated members as Parquet and return their one-row manifest.

    A member that is not VALIDATED or was not known by ``created_at`` is counted as a violation and
    nothing is sealed while there is one (status BLOCKED).
    """
    from tidemark.functions.identity import set_digest

    bad = members.where((F.col("status") != "VALIDATED") | (F.col("ingested_at") > created_at)).count()
    if not bad:
        members.write.mode("errorifexists").parquet(path)
    digest = set_digest(members.withColumn("__h", row_hash).withColumn("__all", F.lit(1)), ["__all"], "__h")
    span = members.agg(F.min("event_at").alias("valid_from"), F.max("event_at").alias("valid_until"))
    return digest.crossJoin(span).select("rows", "digest", "valid_from", "valid_until", F.lit(bad).alias("violations"), F.lit("BLOCKED" if bad else "SEALED").alias("status"))  # one row each
