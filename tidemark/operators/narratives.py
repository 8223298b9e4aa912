"""Narrative windows: what a topic's posts of a period say, against the period before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The classes of discussion, and those that promote.
CLASSES = ("NEWS_DISCUSSION", "ANALYSIS", "OPINION", "QUESTION", "PROMOTIONAL_ACTIVITY", "AUTOMATED_SPAM")
PROMOTING = ("PROMOTIONAL_ACTIVITY", "AUTOMATED_SPAM")
#: Reasons that block a window.
BLOCKING = ("DATA_HEALTH_BLOCKED", "INSUFFICIENT_OBSERVATIONS", "PUMP_AND_DUMP_RISK_HIGH")
#: Levels of spam, coordination and pump risk, to 12 digits, that count as high.
HIGH = 0.6
LEAST_POSTS = 3


def _one(x):
    return F.least(F.lit(1.0), x)


def _high(c):
    return F.round(c, 12) >= HIGH


def distribution(posts: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``keys, <name>``: value:count of a column, values in order, nulls left out. One entry a value, counted before it is gathered."""
    by = posts.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, "n"))), lambda x: F.concat(x[column].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias(name))


def narrative_metrics(posts: DataFrame, size: str, health: DataFrame, prices: DataFrame, least: int = LEAST_POSTS) -> DataFrame:
    """One row for each topic and window that has posts: 20 metrics, ``status`` and ``reasons`` in order.

    ``posts``: topic, author, published_at, sentiment, bot, emotion, spam, coordination, influence,
    discussion_class, language, geography, flagged. ``health`` (topic, window_start, health) and
    ``prices`` (topic, window_start, price_return): a window without health is blocked, one without a
    price counts as unchanged. The window before is the last one with posts. Disagreement is the mean
    distance from the window's mean sentiment, which takes a second pass: posts meet one row for each
    window. Nulls are left out of means; a window in which a measure is all null has 0.
    """
    keys = ["topic", "window_start"]
    at = posts.withColumn("window_start", F.window("published_at", size)["start"])
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    share = lambda c: F.avg(c.cast("double"))
    first = at.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mention_volume"), F.count_distinct("author").alias("unique_authors"), *map(mean, ("sentiment", "bot", "emotion", "spam", "coordination")),
        F.coalesce(F.max("influence") / F.nullif(F.sum("influence"), F.lit(0.0)), F.lit(0.0)).alias("influencer_concentration"),
        share(F.coalesce(F.col("discussion_class").isin(*PROMOTING), F.lit(False))).alias("promotional_share"), F.bool_or(F.coalesce("flagged", F.lit(False))).alias("flagged"),
    )
    apart = at.select(*keys, F.col("sentiment").alias("_s")).join(first.select(*keys, F.col("sentiment").alias("_m")), keys).groupBy(*keys).agg(F.coalesce(F.avg(F.abs(F.col("_s") - F.col("_m"))), F.lit(0.0)).alias("disagreement"))
    w = Window.partitionBy("topic").orderBy("window_start")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    rows = first.join(apart, keys).join(health, keys, "left").join(prices, keys, "left")
    rows = rows.withColumns({
        "baseline": F.lag("mention_volume").over(w).isNotNull(),
        "mention_acceleration": (F.col("mention_volume") - before("mention_volume")) / F.greatest(before("mention_volume"), F.lit(1)),
        "author_growth": (F.col("unique_authors") - before("unique_authors")) / F.greatest(before("unique_authors"), F.lit(1)),
        "sentiment_change": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sentiment") - before("sentiment"))),
        "divergence": _one(F.abs(F.col("sentiment") - F.greatest(F.lit(-1.0), _one(F.coalesce("price_return", F.lit(0.0)))))),
        "crowding": _one((F.col("influencer_concentration") + F.col("coordination") + F.col("promotional_share")) / 3),
    })
    rows = rows.withColumns({
        "pump_risk": _one((F.col("bot") + F.col("spam") + F.col("coordination") + F.col("promotional_share") + F.col("divergence")) / 5),
        "persistence": F.col("baseline").cast("double"), "emerging": ~F.col("baseline") & (F.col("mention_volume") >= least),
    })
    named = {
        "COORDINATED_PROMOTION_LIKELY": _high("coordination"), "DATA_HEALTH_BLOCKED": F.coalesce(F.col("health") != "HEALTHY", F.lit(True)), "INSUFFICIENT_OBSERVATIONS": F.col("mention_volume") < least,
        "NO_PRIOR_BASELINE": ~F.col("baseline"), "PUMP_AND_DUMP_RISK_HIGH": _high("pump_risk"), "SPAM_CONCENTRATION_HIGH": _high("spam"), "UNTRUSTED_CONTENT_SANITIZED": F.col("flagged"),
    }
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c in named.items())))
    rows = rows.withColumn("reasons", reasons).withColumn("status", F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, BLOCKING))), "BLOCKED").otherwise("REVIEW_REQUIRED"))
    for column, name in (("discussion_class", "categories"), ("language", "languages"), ("geography", "geographies")):
        rows = rows.join(distribution(at, keys, column, name), keys, "left").fillna("", [name])
    return rows.drop("flagged", "health", "price_return", "baseline")
