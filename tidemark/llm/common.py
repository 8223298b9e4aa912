"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import dataclasses
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session sets none, a local session (tests) gets a temporary folder; on a cluster that
    would be a disk of one machine, so it is refused.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = spark.conf.get("tidemark.local.shared", None)
    if fallback is None:
        fallback = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tidemark.local.shared", fallback)
    return fallback


_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_passing", default=None)


def staged(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and a plan that
    uses the table several times computes it once. A join of two such tables is also one that
    adaptive execution can split where a key is hot. Inside ``passing`` a table goes at the
    block's end unless it ``stays``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not stays and (made := _passing.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``staged`` writes in this block are deleted at its end. What the block gives on must stay."""
    token = _passing.set(made := [])
    try:
        yield
    finally:
        _passing.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs in this block sends Python so many rows an Arrow batch at most, which both sides hold whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """What this process has freed goes back to the system: a Python worker that has done its task stays beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a table that ``attached`` broadcasts; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def attached(rows: DataFrame, table: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each of their keys; null is a key like others.

    A table of up to ``most`` rows is broadcast after its rows were counted. A larger one is joined
    by shuffle, where adaptive execution splits the rows of a hot key. Give narrow staged tables.
    """
    found = table.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    if table.count() <= (BROADCAST_ROWS if most is None else most):
        found = F.broadcast(found)
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(found, on).drop(*(f"_key_{k}" for k in keys))


@dataclasses.dataclass
class BitTable:
    """Bits at the leading bits of 64-bit hashes; may have more members than were put in."""

    bits: np.ndarray
    shift: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(self.shift)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


#: Bits of a table for each entry, and its largest size in bits (64 MB).
BITS_EACH, MOST_BITS = 16, 1 << 29


def bit_table(hashes: DataFrame, rows: int):
    """Broadcast ``BitTable`` of the 64-bit hashes in the column ``hash``, of which there are about ``rows``.

    Its size is bounded, whatever their number: a fuller table lets more through and loses none.
    """
    size = 16
    while 1 << size < min(MOST_BITS, rows * BITS_EACH):
        size += 1
    at = hashes.select(F.shiftrightunsigned("hash", 64 - size).alias("at"))
    parts = at.groupBy(F.shiftright("at", 6).alias("part")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(1 << size - 6, np.uint64)
    bits[parts.column("part").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(BitTable(bits, 64 - size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def identity(df: DataFrame) -> list[Column]:
    """``h, g``: two 64-bit hashes of a whole row, nulls told apart from their neighbours.

    Rows equal in every column, and only those, are equal in both.
    """
    parts = []
    for f in df.schema.fields:
        c = named(f.name)
        parts += [F.to_json(F.struct(c)) if _has_map(f.dataType) else c, c.isNull()]
    return [F.xxhash64(F.lit(k), *parts).alias(n) for k, n in enumerate(("h", "g"))]


def identified(df: DataFrame) -> DataFrame:
    """``row`` (all columns of ``df`` as one, so that their names clash with nothing), ``h, g``."""
    return df.select(F.struct(*map(named, df.columns)).alias("row"), *identity(df))
