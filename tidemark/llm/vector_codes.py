"""Vector codes by product quantisation with exact integer arithmetic.

Vectors become integers, are cut into ``PARTS`` consecutive parts, and each part is coded by the
nearest entry of its codebook. Nearest entries come from ``|c|^2 - 2 x.c``, whose dot products are
taken by float64 matrix products of limbs: integers are broken into limbs so short that every
partial sum of a product stays below 2^53 and so is exact; the products are recombined in int64, and
the first smallest entry wins.

Each task sees a stretch of vectors and hands back integer sums by part and entry, so a round moves
at most ``PARTS * ENTRIES`` rows a task; only the codebooks, whose size is fixed, are on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attached, staged

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components become floor(SCALE * x).
SCALE = 1024
#: Vectors that are coded at a time.
BLOCK = 4096
#: Largest size of a component, so that distances and dot products fit int64.
LARGEST = 1 << 26


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 arrays, lowest limb first: ``x = sum(limb[k] << (bits * k))``, the last one signed."""
    out, rest = [], x
    while True:
        high = rest >> bits
        if not len(rest) or (high.min() >= -1 and high.max() <= 0):  # the rest fits one signed limb
            out.append(rest.astype(np.float64))
            return out
        out.append((rest - (high << bits)).astype(np.float64))
        rest = high


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices in int64, by float64 matrix products of limbs."""
    inner = x.shape[1]
    bits = (53 - max(1, inner).bit_length()) // 2  # inner * 2^bits * 2^bits <= 2^53
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row of ``x``, and its squared distance."""
    away = (book * book).sum(axis=1)[None, :] - 2 * exact_products(x, book)
    at = away.argmin(axis=1)
    return at, away[np.arange(len(x)), at] + (x * x).sum(axis=1)


def integers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are usable, and their vectors as integers."""
    column = batch.column("vec")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(np.nan_to_num(sizes.astype(float), nan=-1) == width)  # null vectors have no size
    if not len(whole):
        return whole, np.zeros((0, width), np.int64)
    values = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(whole), width)
    with np.errstate(over="ignore"):
        values = np.floor(values * SCALE)  # a null component comes as NaN
    usable = np.isfinite(values).all(axis=1)
    values = values[usable]
    if values.size and np.abs(values).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have squared distances that may not fit 64 bits")
    return whole[usable], values.astype(np.int64)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _finite(vectors: DataFrame) -> DataFrame:
    """``id, label, vec`` of rows whose vector has the length of the smallest id's and holds no null and only finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(f"vec IS NOT NULL AND size(vec) > 0 AND size(vec) % {PARTS} = 0 AND forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    width = rows.agg(F.expr("min_by(size(vec), struct(id IS NULL, id, vec))")).first()[0] or 0
    return rows.where(F.size("vec") == width)


def first_books(kept: DataFrame) -> np.ndarray:
    """Codebooks ``[part, entry, position]``: the parts of the vectors with the smallest ids (at most ``ENTRIES`` rows)."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").toArrow().column("vec").to_pylist()
    width = len(rows[0]) if rows else 0
    x = np.floor(np.array(rows, np.float64).reshape(len(rows), width) * SCALE)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have squared distances that may not fit 64 bits")
    return np.stack(_parts(x.astype(np.int64)))


def improved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, each used entry to the floor of its parts' mean."""
    _, entries, wide = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES parts, whatever the table's size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros((PARTS, entries, wide), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, x = integers(batch.slice(at, BLOCK), PARTS * wide)
                for k, part in enumerate(_parts(x)):
                    code, _ = nearest(part, books[k])
                    np.add.at(total[k], code, part)
                    count[k] += np.bincount(code, minlength=entries)
        k, e = np.nonzero(count)
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * wide, pa.int32()), pa.array(total[k, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(k * entries + e), pa.array(count[k, e]), each], ["slot", "n", "total"])

    partial = kept.select("vec").mapInArrow(sums, "slot long, n long, total array<long>")
    summed = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(j))) for j in range(wide))).alias("total")).toArrow()
    out = books.copy()
    for slot, n, total in zip(*(summed.column(c).to_pylist() for c in ("slot", "n", "total")), strict=True):
        out[slot // entries, slot % entries] = np.array(total, np.int64) // n
    return out


def train(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(kept)
    for _ in range(rounds if books.size else 0):
        books = improved(kept, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every kept vector."""
    wide = books.shape[2]
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                rows, x = integers(some, PARTS * wide)
                found = [nearest(part, books[k]) for k, part in enumerate(_parts(x))]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(take), some.column("label").take(take), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(e for _, e in found), pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("id", "label", "vec").mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a whole finite vector.

    Codebooks start from the smallest ids (null ids come last; rows that share an id stand in order
    of their vectors). All vectors need one length, a multiple of
    ``PARTS``, that of the smallest id; others are left out like broken ones. With fewer than
    ``ENTRIES`` vectors the codebooks are smaller. Null labels are one label; repeated rows are
    repeated; without any usable vector the result is empty; other columns are ignored. Components
    beyond 2^16 are refused, as distances might not fit 64 bits.
    """
    kept = _finite(vectors)
    books = train(kept, rounds)
    if not books.size:
        return kept.where(F.lit(False)).select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = staged(coded(kept, books), "codes")
    by_label = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return attached(rows, by_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """``vector_codes`` over ``embeddings`` as DuckDB SQL: distances by their definition, round by round."""
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT rid, vec_id, label, p, v[1 + p * (len(v) // 4) : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 256)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"code{r} AS MATERIALIZED (SELECT rid, p, min({{d: list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e: e}}) AS m FROM parts a JOIN book{r} b USING (p) GROUP BY rid, p)")
        if r < ROUNDS:
            steps.append(
                f"mean{r} AS (SELECT p, e, list(y ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(c)::HUGEINT / count(*))::BIGINT AS y FROM (SELECT p, m.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM code{r} JOIN parts USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e),"
                f" book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} n USING (p, e))"
            )
    last = f"code{ROUNDS}"
    steps.append(f"coded AS (SELECT rid, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM {last} GROUP BY rid)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid) CROSS JOIN digest"


SQL = _sql()
