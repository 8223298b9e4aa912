"""Ordered work that no single key confines to one task: ranges of (key, order) and what they carry on.

A key with a third of all rows lies in many ranges. Each range is summed or folded by itself, and
only one row for each range goes on to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

#: Rows of an Arrow batch that ``ordered_fold`` gives out.
OUT_ROWS = 10_000


def in_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``piece``, the number of the range of (keys, order) that a row lies in; written, so that it stays so.

    Rows equal in keys and order share a range: end ``order`` with something that tells rows apart.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(ranges, *keys, *order).withColumn("piece", F.spark_partition_id()), "ranges")


def carried(dealt: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``dealt`` with ``before_<sum>``: the sums of a key's earlier ranges.

    A range is the continuation of at most one key, so what is carried has at most one row for each
    range and is broadcast.
    """
    totals = dealt.groupBy("piece", *keys).agg(*(F.sum(c).alias(c) for c in sums))
    ahead = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("piece").alias("_piece"), *(F.col(k).alias(f"_{k}") for k in keys), *(F.sum(c).over(ahead).alias(f"before_{c}") for c in sums), F.lag("piece").over(Window.partitionBy(*keys).orderBy("piece")).alias("_last"))
    before = staged(before.where("_last IS NOT NULL").drop("_last"), "carried")
    on = [F.col("piece") == F.col("_piece"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    return dealt.join(F.broadcast(before), on, "left").drop("_piece", *(f"_{k}" for k in keys)).fillna(0, [f"before_{c}" for c in sums])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums by key in order, the row itself included; nulls add nothing, a null key is a key."""
    with_parts = df.withColumns({f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    dealt = carried(in_ranges(with_parts, keys, order, ranges), keys, [f"_s_{n}" for n in sums])
    within = Window.partitionBy("piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({n: F.sum(f"_s_{n}").over(within) + F.col(f"before__s_{n}") for n in sums})
    return out.drop("piece", *(f"_s_{n}" for n in sums), *(f"before__s_{n}" for n in sums))


def with_previous(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the value that ``column`` has in the row before, by key in order; null in a key's first row."""
    dealt = in_ranges(df, keys, order, ranges)
    # a range's last row of a key: found among those with the greatest value of the first order column
    top = F.broadcast(dealt.groupBy("piece", *keys).agg(F.max(order[0]).alias("_top")).select(F.col("piece").alias("_piece"), *(F.col(k).alias(f"_{k}") for k in keys), "_top"))
    on = [F.col("piece") == F.col("_piece"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    last = dealt.join(top, [*on, F.col(order[0]).eqNullSafe(F.col("_top"))]).groupBy("piece", *keys).agg(F.max_by(F.struct(column), F.struct(*order)).alias("_end"))
    ahead = Window.partitionBy(*keys).orderBy("piece")
    ends = last.select(F.col("piece").alias("_piece"), *(F.col(k).alias(f"_{k}") for k in keys), F.lag("_end").over(ahead)[column].alias("_before"))
    ends = staged(ends.where("_before IS NOT NULL"), "ends")
    within = Window.partitionBy("piece", *keys).orderBy(*order)
    numbered = dealt.withColumns({"_n": F.row_number().over(within), name: F.lag(column).over(within)})
    out = numbered.join(F.broadcast(ends), on, "left").withColumn(name, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col(name)))
    return out.drop("piece", "_n", "_before", "_piece", *(f"_{k}" for k in keys))


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], Iterator[tuple]], schema: str, finish: Callable[[tuple, object], Iterator[tuple]] | None = None) -> DataFrame:
    """Each key's rows in order through ``step(state, row)``, which yields rows of ``schema``.

    ``start()`` makes a key's state, which ``step`` changes in place; ``finish(key, state)`` yields
    what remains at its end. Rows are dealt by key and sorted within tasks, so that a task holds one
    batch and the state of one key, however many rows that key has.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, state, out = None, None, None, []

        def given() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=kind)

        kind = pa.schema(arrow_schema)
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            for k in range(batch.num_rows):
                row = {n: c[k] for n, c in columns.items()}
                at = tuple(row[n] for n in keys)
                if at != key:
                    if key is not None and finish:
                        out.extend(finish(key, state))
                    key, state = at, start()
                out.extend(step(state, row))
                if len(out) >= OUT_ROWS:
                    yield given()
                    out.clear()
        if key is not None and finish:
            out.extend(finish(key, state))
        if out:
            yield given()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
