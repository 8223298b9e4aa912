"""Incremental ingestion of landed provider pages: a streaming file source, a cursor that survives, a ledger of runs.

Each landed JSON file is one page: ``provider_version, retrieved_at, cursor, next_cursor, records``. A
run takes what has landed since the last one (``availableNow``; the stream's checkpoint knows), keeps
it, and follows the cursors from where the last run stopped. What it passes is appended by key, so
that replays add nothing, and the run leaves one row in the ledger.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.jobs import capture

LEDGER = "run long, source_id string, scope string, state string, provider_version string, resume_cursor string, captured_count long, error_code string, recorded_at timestamp"
#: Pages that a run may pass, unless told otherwise.
MOST_PAGES = 1000


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def latest_run(spark: SparkSession, ledger: str, source_id: str, scope: str, as_of: dt.datetime | None = None):
    """The last ledger row of a source and scope by ``as_of``, or None."""
    rows = read_if_there(spark, ledger)
    if rows is None:
        return None
    rows = rows.where((F.col("source_id") == source_id) & (F.col("scope") == scope))
    if as_of is not None:
        rows = rows.where(F.col("recorded_at") <= F.lit(as_of))
    return rows.orderBy(F.desc("recorded_at"), F.desc("run")).first()


def follow(pages: list, cursor: str | None, most: int) -> tuple[list, str | None, str | None]:
    """(pages passed in order, where it stopped, error): the chain of ``pages`` from ``cursor``; no error at its end.

    ``pages`` are (page_id, cursor, next_cursor, issue) with the newest of a cursor last. A page with
    an issue, a cursor seen before, a page that has not landed and the bound on pages each stop it.
    """
    by = {p.cursor: p for p in pages}
    passed, seen = [], set()
    while True:
        if len(passed) == most:
            return passed, cursor, "provider_pagination_limit_exceeded"
        page = by.get(cursor)
        if page is None:
            unread = any(p.issue == "malformed_provider_page" for p in pages)
            return passed, cursor, "malformed_provider_page" if unread else "provider_page_missing"
        if page.issue:
            return passed, cursor, page.issue
        passed.append(page)
        if page.next_cursor is None:
            return passed, None, None
        if page.next_cursor in seen:
            return passed, cursor, "provider_pagination_cursor_loop"
        seen.add(page.next_cursor)
        cursor = page.next_cursor


def ingest_incremental(spark: SparkSession, inbox: str, store: str, records: str, key: list[str], source_id: str, scope: str, stale_after: dt.timedelta, now: dt.datetime, most_pages: int = MOST_PAGES) -> str:
    """One run over ``inbox``; returns its state: HEALTHY, STALE (the last page is old), ERROR or IDLE (nothing had landed).

    ``records`` is the DDL of a record, ``key`` its identity. Under ``store`` lie ``pages`` (all that
    landed), ``passed`` (pages a run went past), ``rows`` and ``conflicts`` (see ``capture``), ``ledger``
    and ``checkpoint``. An ERROR keeps what was captured before it and the cursor where it stopped; the
    next run resumes there, also from pages that landed earlier. Killed at any place, a run that is
    started again takes up the same batch under the same number: rows are appended by key, pages and
    ledger rows by number, so nothing comes twice. Only cursors, at most ``most_pages`` and one more
    of the pages not passed yet, come to the driver; more than ten times that many waiting is an ERROR.
    """
    record = f"array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in records.split(','))}>>"
    schema = f"source_id string, provider_version string, retrieved_at timestamp, cursor string, next_cursor string, records {record}, _corrupt string"
    landed = spark.readStream.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(inbox)
    landed = landed.withColumn("page_id", F.col("_metadata.file_path"))
    states: list[str] = []

    def run(batch: DataFrame, number: int) -> None:
        issue = F.when(F.col("_corrupt").isNotNull() | F.col("records").isNull(), "malformed_provider_page").when(F.col("source_id") != source_id, "page_source_mismatch").when(F.trim(F.coalesce("provider_version", F.lit(""))) == "", "invalid_provider_version").when(F.col("retrieved_at").isNull() | (F.col("retrieved_at") > F.lit(now)), "invalid_retrieved_at")
        _append_once(batch.withColumn("issue", issue).withColumn("run", F.lit(number)).drop("_corrupt"), f"{store}/pages", number)
        pages = spark.read.parquet(f"{store}/pages")
        done = read_if_there(spark, f"{store}/passed")
        waiting = pages if done is None else pages.join(done.where(F.col("run") < number).select("page_id"), "page_id", "left_anti")
        last = latest_run(spark, f"{store}/ledger", source_id, scope)
        if last is not None and last.run == number:  # this batch was finished before the checkpoint knew
            states.append(last.state)
            return
        cursor = last.resume_cursor if last is not None else None
        heads = waiting.orderBy("retrieved_at", "page_id").select("page_id", "cursor", "next_cursor", "issue").limit(10 * (most_pages + 1) + 1).collect()
        passed, stopped, error = ([], cursor, "provider_pagination_limit_exceeded") if len(heads) > 10 * (most_pages + 1) else follow(heads, cursor, most_pages)
        names = spark.createDataFrame([(p.page_id,) for p in passed], "page_id string")
        taken = waiting.join(F.broadcast(names), "page_id")  # at most most_pages names
        rows = taken.select(F.explode("records").alias("r")).select("r.*")
        known = read_if_there(spark, f"{store}/rows")
        fresh, conflicts = capture(rows, known, key)
        seen = read_if_there(spark, f"{store}/conflicts")
        if seen is not None:
            conflicts = conflicts.join(seen.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")
        conflicts.write.mode("append").parquet(f"{store}/conflicts")
        fresh.withColumn("run", F.lit(number)).write.mode("append").parquet(f"{store}/rows")
        _append_once(names.withColumn("run", F.lit(number)), f"{store}/passed", number)
        newest = taken.agg(F.max_by("provider_version", "retrieved_at").alias("version"), F.max("retrieved_at").alias("at")).first()
        count = spark.read.parquet(f"{store}/rows").where(F.col("run") == number).count()
        state = "ERROR" if error else "STALE" if newest["at"] is not None and now - newest["at"] > stale_after else "HEALTHY"
        row = (number, source_id, scope, state, newest["version"], stopped, count, error, now)
        _append_once(spark.createDataFrame([row], LEDGER), f"{store}/ledger", number)
        states.append(state)

    query = landed.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return states[-1] if states else "IDLE"


def _append_once(rows: DataFrame, path: str, number: int) -> None:
    """Append the rows of a run unless the table has rows of that run, from an attempt that got so far."""
    there = read_if_there(rows.sparkSession, path)
    if there is None or there.where(F.col("run") == number).isEmpty():
        rows.write.mode("append").parquet(path)
