"""Account marks to returns, and venue calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nav_to_returns(marks: DataFrame, provider: str) -> DataFrame:
    """One row for each two consecutive marks of an account: the period's return, its reference and when it could be known.

    ``marks``: account_id, observed_at, ingested_at, equity, source_reference. Marks stand in order of
    (observed_at, ingested_at, source_reference). The reference is ``before->after``; the return was
    ingested when its later mark was, but never before that was observed. ``issue`` names a time that
    does not increase, equity that is not positive or a reference that occurs twice, and the return
    is then null. An account with one mark has no row.
    """
    w = Window.partitionBy("account_id").orderBy("observed_at", "ingested_at", "source_reference")
    same = F.count(F.lit(1)).over(Window.partitionBy("account_id", "source_reference"))
    before = marks.withColumns({"same": same, "start": F.lag("observed_at").over(w), "base": F.lag("equity").over(w), "from": F.lag("source_reference").over(w)}).where("start IS NOT NULL")
    issue = (
        F.when(F.col("same") > 1, "duplicate_account_performance_snapshot").when(F.col("observed_at") <= F.col("start"), "non_increasing_account_performance_time")
        .when(~F.coalesce((F.col("base") > 0) & (F.col("equity") > 0), F.lit(False)), "invalid_account_equity")
    )
    rows = before.withColumn("issue", issue)
    return rows.select(
        "account_id", F.col("start").alias("period_start"), F.col("observed_at").alias("period_end"), F.when(F.col("issue").isNull(), F.col("equity") / F.col("base") - 1).alias("return_fraction"), F.lit(provider).alias("provider"),
        F.concat("from", F.lit("->"), "source_reference").alias("source_reference"), F.greatest("ingested_at", "observed_at").alias("ingested_at"), "issue",
    )


def trading_sessions(moments: DataFrame, key: str, sessions: DataFrame, holidays: DataFrame) -> DataFrame:
    """``key, is_open``: whether a moment (key, venue, observed_at in UTC) lies in a session of its venue.

    ``sessions``: venue, weekday (0 is Monday), opens_at and closes_at in minutes of the local day,
    zone; the end is exclusive and on the same day. ``holidays``: venue, holiday. Venues without
    sessions are closed. Sessions are met by venue and local weekday, so a moment meets those of its
    own day; a moment is taken once for each zone of its venue.
    """
    zones = sessions.select("venue", "zone").distinct()
    local = F.from_utc_timestamp(F.col("observed_at").cast("timestamp"), F.col("zone")).cast("timestamp_ntz")
    at = moments.select(key, "venue", "observed_at").join(zones, "venue").withColumn("local", local).withColumns({"weekday": F.weekday("local"), "holiday": F.to_date("local")})
    minute = F.hour("local") * 60 + F.minute("local")
    met = at.join(holidays.select("venue", "holiday").distinct(), ["venue", "holiday"], "left_anti").join(sessions, ["venue", "zone", "weekday"]).where((minute >= F.col("opens_at")) & (minute < F.col("closes_at")))
    return moments.select(key).join(met.select(key).distinct().withColumn("is_open", F.lit(True)), key, "left").fillna(False, ["is_open"])
