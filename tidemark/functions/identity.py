"""Content identity: canonical row hashes, mergeable set digests, table comparison and replay conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanes of a set digest: so many hexadecimal digits of a row's hash each, summed modulo a prime.
LANES, LANE_DIGITS, PRIME = 4, 15, (1 << 61) - 1


def _plain(number: Column) -> Column:
    """A number as decimal text without zeros at its end; what no decimal(30,12) holds as the engine writes it."""
    text = number.cast("decimal(30,12)").cast("string")
    # twelve places follow a point, so that zeros are cut there at most; outside ANSI mode small numbers are written with an exponent and stay so
    cut = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.coalesce(F.when(F.contains(text, F.lit("E")), text).otherwise(cut), number.cast("string"))


def _canonical(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return _plain(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.DateType, T.BinaryType)):
        return value.cast("string") if isinstance(kind, T.DateType) else F.lower(F.hex(value))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    return value


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON: names in order, no spaces, nulls kept, decimals and floating numbers as text, times to the microsecond.

    Whole numbers and booleans stay themselves. All columns unless some are named.
    """
    fields = sorted((f for f in df.schema.fields if columns is None or f.name in columns), key=lambda f: f.name)
    return F.to_json(F.struct(*(_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of a row."""
    return F.sha2(canonical_json(df, columns), 256)


def set_digest(df: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """``keys, rows, digest``: the multiset of a key's row hashes, whatever their order and partitions; repeats count.

    Each hash gives ``LANES`` numbers, which are summed modulo a prime and hashed with the number of
    rows. Sums combine before the shuffle, so no group's rows meet and a digest of many tables is
    as cheap as a count.
    """
    lane = lambda k: F.sum(F.conv(F.substring(hashed, 1 + k * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(20,0)")).alias(f"_l{k}")
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(lane(k) for k in range(LANES)))
    parts = [F.col("rows").cast("string"), *((F.coalesce(F.col(f"_l{k}"), F.lit(0)) % F.lit(PRIME).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for k in range(LANES))]
    return sums.select(*keys, "rows", F.sha2(F.concat_ws(":", *parts), 256).alias("digest"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``rows, digest`` of a whole table, one row; an empty table has one too."""
    return set_digest(df.select(row_hash(df).alias("_h")), [], "_h")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rows_a, rows_b, same, only_a, only_b`` of two tables with the same columns, as multisets of rows.

    Rows meet by hash, counted before the shuffle; ``only_a`` is the number of rows, repeats
    included, that ``a`` has more of than ``b``.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    b = b.select(*a.columns)
    sides = a.select(row_hash(a).alias("h"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(row_hash(b).alias("h"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = sides.groupBy("h").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    more = lambda p, q: F.coalesce(F.sum(F.greatest(F.col(p) - F.col(q), F.lit(0))), F.lit(0))
    out = each.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("rows_b"), more("x", "y").alias("only_a"), more("y", "x").alias("only_b"))
    return out.select("rows_a", "rows_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("same"), "only_a", "only_b")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one table has more of, with the ``side`` that has them."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def replay_conflicts(df: DataFrame, ident: str, hashed: Column) -> DataFrame:
    """Ids under which different content was recorded."""
    return df.groupBy(ident).agg(F.count_distinct(hashed).alias("contents")).where("contents > 1")
