"""The catalogue of transparent features: what is defined, whether or not it can be computed from what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Market features by family.
MARKET = {
    "PRICE_RETURNS": ("simple_return", "log_return", "multi_horizon_return"),
    "TREND": ("sma", "ema", "moving_average_distance", "breakout", "trend_slope"),
    "MOMENTUM": ("multi_horizon_momentum", "risk_adjusted_momentum"),
    "VOLATILITY": ("realized_volatility", "downside_volatility", "range_volatility"),
    "LIQUIDITY": ("dollar_volume", "adv", "turnover", "amihud_proxy"),
}
#: Features of fundamentals and of macro releases.
FUNDAMENTAL = ("revenue_growth", "operating_margin", "fcf", "debt", "dilution", "roic_components")
MACRO = ("rate_level_change", "curve_slope", "inflation_change", "employment_change", "revision_or_surprise")
VERSION = "1.0.0"
COLUMNS = "name string, version string, family string, source string, fields array<string>, frequency string, lookback int, missing_data string, quality_failure string, late_data string, unit string, calculation string"


def feature_catalogue(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """One row for each feature version, in the columns of ``COLUMNS``; ``more`` adds definitions.

    A (name, version) that is defined twice is refused, as is a definition without a name, a version,
    sources or a lookback of at least 0.
    """
    rules = ("reject", "reject", "reject_future_knowledge", "decimal")
    rows = [(n, VERSION, family, "OHLCV", ["close", "event_at", "knowledge_at"], "1d", 1, *rules, "transparent-market-v1") for family, names in MARKET.items() for n in names]
    for family, source, fields, names in (("FUNDAMENTAL", "FUNDAMENTALS", ["accepted_at", "value", "revision"], FUNDAMENTAL), ("MACRO", "MACRO", ["release_at", "actual", "revision"], MACRO)):
        rows += [(n, VERSION, family, source, fields, "release", 0, *rules, "transparent-input-v1") for n in names]
    known = spark.createDataFrame(rows, COLUMNS)
    if more is None:
        return known
    every = known.unionByName(more.select(*known.columns))
    if not every.where("coalesce(trim(name), '') = '' OR coalesce(trim(version), '') = '' OR source IS NULL OR lookback IS NULL OR lookback < 0").isEmpty():
        raise ValueError("a definition needs a name, a version, a source and a lookback")
    if not every.groupBy("name", "version").count().where("count > 1").isEmpty():
        raise ValueError("duplicate_feature_definition")
    return every
