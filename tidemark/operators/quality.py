"""Data quality: detection, findings and gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import with_previous


def flag_array(*flags: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags)))


def bad_ohlc() -> Column:
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))


def assess_bars(bars: DataFrame, key: str, time: str, arrival: list[str], ranges: int | None = None) -> DataFrame:
    """Flags and score of each bar in arrival order: ``flags, quality_score, status``; a key's bars lie in several ranges."""
    same = Window.partitionBy(key, time).orderBy(*arrival)
    flagged = with_previous(bars, [key], arrival, time, "__before", ranges).withColumn("__n", F.row_number().over(same))
    flags = flag_array(
        ("duplicate_bar", F.col("__n") > 1),
        ("time_regression", F.col(time) <= F.col("__before")),
        ("non_positive_price", F.least("open", "high", "low", "close") <= 0),
        ("invalid_ohlc_range", bad_ohlc()),
        ("negative_volume", F.col("volume") < 0),
    )
    out = flagged.withColumn("flags", flags).drop("__n", "__before")
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.size("flags") * F.lit(0.2))
    return out.withColumn("quality_score", score).withColumn("status", F.when(F.size("flags") > 0, "REJECTED").otherwise("VALIDATED"))


def gaps(bars: DataFrame, key: str, day: str, interval_days: int = 1) -> DataFrame:
    """Gaps over the interval: ``key, gap_start, gap_end, gap_days, missing_bars``."""
    w = Window.partitionBy(key).orderBy(day)
    seen = bars.select(key, day).distinct().withColumn("gap_start", F.lag(day).over(w))
    found = seen.withColumn("gap_days", F.datediff(day, "gap_start")).where(F.col("gap_days") > interval_days)
    missing = F.greatest(F.lit(1), (F.col("gap_days") / interval_days).cast("int") - 1)
    return found.select(key, "gap_start", F.col(day).alias("gap_end"), "gap_days", missing.alias("missing_bars"))


def duplicates(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """Rows after the first of each key, in arrival order."""
    w = Window.partitionBy(*key).orderBy(*arrival)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def unique_report(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def regressions(df: DataFrame, key: str, time: str, arrival: list[str], ranges: int | None = None) -> DataFrame:
    """Rows whose time is before that of the row that arrived before."""
    return with_previous(df, [key], arrival, time, "previous", ranges).where(F.col(time) < F.col("previous"))


def stale(df: DataFrame, keys: list[str], day: str, expected_end, stale_days: int) -> DataFrame:
    """``keys, latest, stale_days`` of keys whose last day lies more than ``stale_days`` before the expected end; without one, before the table's last day."""
    last = df.groupBy(*keys).agg(F.max(day).alias("latest"))
    if expected_end is None:
        last = last.crossJoin(last.agg(F.max("latest").alias("_end")))  # one row
        expected_end = F.col("_end")
    return last.withColumn("stale_days", F.datediff(expected_end, "latest")).where(F.col("stale_days") > stale_days).select(*keys, "latest", "stale_days")


def provider_disagreement(df: DataFrame, key: str, day: str, value: str, tolerance: float) -> DataFrame:
    """Times at which providers differ by more than the tolerance, or one of them is not positive."""
    by = df.groupBy(key, day).agg(F.count_distinct("provider").alias("providers"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return by.where((F.col("providers") > 1) & ((F.col("lowest") <= 0) | ((F.col("highest") - F.col("lowest")) / F.col("lowest") > tolerance)))


def incomplete(universe: DataFrame, df: DataFrame, key: str, day: str, start, end, minimum: int) -> DataFrame:
    """Reasons for which an expected key's data set is incomplete; a key without rows appears too."""
    have = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))
    joined = universe.join(have, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reasons = flag_array(
        ("MISSING_BARS", F.col("n") == 0), ("TOO_FEW", F.col("n") < minimum), ("STARTS_LATE", F.col("first") > start), ("ENDS_EARLY", F.col("last") < end)
    )
    return joined.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''").select(key, "n", "reasons")


#: Actions of findings from mild to severe, in order, and the mildest that blocks.
SEVERITY = ("INFO", "WARN", "DEGRADE_CONFIDENCE", "BLOCK_INSTRUMENT", "BLOCK_STRATEGY", "BLOCK_ASSET_CLASS", "GLOBAL_BLOCK")
LEAST_BLOCK = "BLOCK_INSTRUMENT"


def health(findings: DataFrame, scope: str) -> DataFrame:
    """Findings of (scope, check, action) as one row for each scope with the worst action.

    An action that is unknown or null ranks above all and blocks.
    """
    known = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("action"))
    rank = F.when(known > 0, known).otherwise(len(SEVERITY) + 1)
    worst = findings.withColumn("__rank", rank).groupBy(scope).agg(F.count(F.lit(1)).alias("findings"), F.max_by("action", "__rank").alias("action"), F.max("__rank").alias("__r"))
    return worst.select(scope, "findings", "action", (F.col("__r") > SEVERITY.index(LEAST_BLOCK)).alias("blocking"))


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with the names of the rules that each row breaks; a null predicate counts as broken."""
    return df.withColumn("violations", flag_array(*((n, ~F.coalesce(c, F.lit(False))) for n, c in rules)))
