"""Point-in-time reads: latest-by and as-of joins for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_at(df: DataFrame, t, event: str, known: str) -> DataFrame:
    """Rows whose event and knowledge times are both at or before ``t``."""
    return df.where((F.col(event) <= t) & (F.col(known) <= t))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order`` (give descending columns)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_value(df: DataFrame, keys: list[str], values: list[str], *order: str) -> DataFrame:
    """As ``latest_by`` by the greatest ``order``, as an aggregation that combines before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    return best.select(*keys, "__v.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    Both sides are stacked and carried forward in one ordered window, so cost is n log n and no
    pair is formed. ``tie`` orders right rows of one time. Left rows without a match get nulls.
    """
    names = left.columns
    stacked_left = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*names).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    stacked_right = right.select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__l"), F.struct(*values).alias("__r"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked_left.unionByName(stacked_right).withColumn("__last", F.last("__r", ignorenulls=True).over(w))
    return carried.where("__side = 1").select("__l.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def overlapping_validity(intervals: DataFrame, key: str, start: str, end: str, ident: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(start, ident).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce(F.col(end), F.to_timestamp(F.lit("9999-12-31")).cast(intervals.schema[start].dataType))).over(w)
    return intervals.withColumn("__reach", reach).where(F.col(start) < F.col("__reach")).drop("__reach")
