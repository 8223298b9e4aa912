"""Mixing sources to target weights by systematic sampling.

Each source gets a target: its weight's share of all words, at most ``MOST`` times its own size,
the excess reshared by weight. Every document of a source expects ``target / source_size`` copies.
The documents of a source stand in order of size (largest first, then id); expected copies are
prefix-summed along that order, one random offset is added, and a document is emitted once for each
integer boundary that its share of the line crosses. The order by size keeps the words taken within
about one document's size of the target.

Prefix sums are exact integers: expected copies are cut to multiples of 2^-24 and the offset is one
of them. The place of a document in its source is found in two levels, so that no task holds a
whole source: rows are dealt by ranges of (source, size, id), counted by range and source, and
numbered within their range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import identified, identity, staged

#: Weights by a source's place in code point order, repeated (null comes last).
WEIGHTS = (5, 2, 1)
#: A source's target, and so a document's copies, stop at this many times its size.
MOST = 3
#: Parts of a copy in which prefix sums are kept.
UNIT = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h, g``: words of each whole text (null: 0), and two hashes of the whole row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("size"),
        *identity(docs),
    )


def targets(by_source: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row a source, null too.

    Capped sources are those for which ``MOST * size / weight`` is at most the level at which all
    targets add up; along that ratio they are a prefix, so running sums find the level at once.
    The sums run over one row for each source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    whole = Window.partitionBy()
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    rated = place.withColumn("level", level).withColumn("free", F.col("source_size") * MOST > F.col("weight") * F.col("level"))
    # the first free source in ratio order fixes the level for all free ones
    first = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(whole)
    return rated.select("source", "source_size", F.when(F.col("free"), F.col("weight") * first["level"]).otherwise((F.col("source_size") * MOST).cast("double")).cast("double").alias("target"))


def copies(docs: DataFrame, seed: int = 0, ranges: int | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, h, g, copies`` for every row; h and g are hashes of the whole row.

    A null source is a source of its own, last in order; a null text has size 0; null ids come
    last among documents of one size. Rows equal in source, size and id share their copies in any
    order. A source without words has target 0 and takes no copies. The offset depends on the
    source's name and ``seed`` alone, so reruns agree. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sized = staged(sizes(docs), "sizes")
    by_source = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.repartitionByRange(ranges, F.col("source"), F.col("size").desc(), F.col("doc_id"), F.rand(seed)).withColumn("piece", F.spark_partition_id())
    dealt = staged(dealt, "dealt")
    counted = dealt.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = counted.select("source", "piece", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("piece", "source").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last())
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f"|{seed}"))), 1, 6), 16, 10).cast("long")  # 24 bits
    rate = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST))) * UNIT)).otherwise(0).cast("long")
    ranked = (
        dealt.withColumn("place", F.row_number().over(within))
        .alias("d")
        .join(start.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.piece") == F.col("s.piece")))
        .select("d.doc_id", "d.source", "d.size", "d.h", "d.g", (F.col("d.place") + F.col("s.start")).cast("long").alias("place"))
    )
    sources = by_source.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"), offset.alias("u"))
    joined = ranked.join(sources, F.col("source").eqNullSafe(F.col("of")))
    crossed = F.expr(f"(place * rate + u) div {UNIT} - ((place - 1) * rate + u) div {UNIT}")
    return joined.select("doc_id", "source", "size", "source_size", "target", "h", "g", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: words that the mix takes of every document."""
    return copies(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows are matched to their copies by hashes of all their columns, so rows that share an id, and
    rows without one, each get their own. Rows repeated as they are come out as often as the mix
    takes them together. A null text or source is as in ``copies``: a text without words is never
    taken. An empty table gives an empty one. Column names don't matter.
    """
    each = copies(docs, seed).groupBy("h", "g").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("k")).where("n > 0")
    each = staged(each, "copies")
    rows = identified(docs)
    taken = rows.join(each.where("k = 1").select("h", "g", "n"), ["h", "g"])
    again = each.where("k > 1").select("h", "g", "n")
    if not again.isEmpty():  # one of them stands for all
        once = rows.join(again.select("h", "g"), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
        taken = taken.unionByName(once.join(again, ["h", "g"]))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


#: ``mix`` over ``documents`` as DuckDB SQL.
SQL = f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER below, 0) * {MOST}) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS level FROM by_source
    WINDOW below AS (ORDER BY source_size / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (SELECT *, source_size * {MOST} > weight * level AS free FROM leveled),
fixed AS (SELECT level FROM rated WHERE free ORDER BY source_size / weight::DOUBLE, source ASC NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN free THEN weight * (SELECT level FROM fixed) ELSE source_size * {MOST} END::DOUBLE AS target FROM rated),
lined AS (SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id ASC NULLS LAST) AS place,
    CASE WHEN source_size > 0 THEN floor(least(target / source_size, {MOST}::DOUBLE) * {UNIT})::BIGINT ELSE 0 END AS rate, ('0x' || substr(md5(coalesce(s.source, '') || '|0'), 1, 6))::BIGINT AS u
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * ((place * rate + u) // {UNIT} - ((place - 1) * rate + u) // {UNIT}) AS taken FROM lined"""
