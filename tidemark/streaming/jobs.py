"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def narrative_windows(posts: DataFrame, size: str = "1 day", late: str = "6 hours") -> DataFrame:
    """Tumbling windows by topic; posts later than the watermark are dropped. A window's state holds its authors until it closes."""
    windows = posts.withWatermark("published_at", late).groupBy(F.window("published_at", size).alias("w"), "topic")
    return windows.agg(F.count(F.lit(1)).alias("volume"), F.size(F.collect_set("author")).cast("long").alias("authors"), F.avg("sentiment").alias("sentiment")).select("topic", F.col("w.start").alias("window_start"), "volume", "authors", "sentiment")


def sliding_sli(telemetry: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Good and total events of each service in sliding windows."""
    w = telemetry.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "service")
    return w.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("good")).select("service", F.col("w.start").alias("window_start"), "total", "good")


def once_by_key(events: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, however often it is replayed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def late_flag(posts: DataFrame, hours: int = 6) -> DataFrame:
    """Marks rows that were ingested more than some hours after they were published."""
    return posts.withColumn("late", F.col("ingested_at") > F.col("published_at") + F.make_dt_interval(hours=F.lit(hours)))


RESERVED = "account_id long, day date, order_id long, amount double, accepted boolean"


def reserve_notional(orders: DataFrame, limit: float, late: str = "1 day") -> DataFrame:
    """Greedy daily reservation by (account, day): the state is the total so far.

    Rows of a batch are taken in order of (time, order id). The state ends in event time, when the
    watermark has passed the day's end, so nothing that is still accepted meets an empty total and
    an idle query schedules no batches.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = state.get[0] if state.exists else 0.0
        out = []
        for r in pd.concat(parts).sort_values(["at", "order_id"]).itertuples(index=False):
            fits = total + r.amount <= limit
            total += r.amount if fits else 0.0
            out.append((key[0], key[1], r.order_id, r.amount, fits))
        state.update((total,))
        ends = int(pd.Timestamp(key[1]).value // 1_000_000) + 48 * 3_600_000  # the day's end in any zone
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["account_id", "day", "order_id", "amount", "accepted"])

    keyed = orders.withWatermark("at", late).groupBy("account_id", "day")
    return keyed.applyInPandasWithState(step, RESERVED, "total double", "append", GroupStateTimeout.EventTimeTimeout)


EXPIRED = "signal_id long, status string, expired_at timestamp"


def expire_signals(log: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """One row for each signal whose last status stood unanswered for some hours of event time.

    The state is the latest (time, status); a new status moves the timer, the timer ends the state. Only a later status than
    the one held counts, so replays change nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, status = state.get
            state.remove()
            yield pd.DataFrame({"signal_id": [key[0]], "status": [status], "expired_at": [pd.Timestamp(at, unit="us") + pd.Timedelta(hours=hours)]})
            return
        at, status = state.get if state.exists else (-1, "")
        for part in parts:
            last = part.sort_values("ts").iloc[-1]
            t = int(last.ts.value // 1000)
            if t > at:
                at, status = t, last.status
        state.update((at, status))
        state.setTimeoutTimestamp(max(at // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    keyed = log.withWatermark("ts", late).select("signal_id", "ts", "status").groupBy("signal_id")
    return keyed.applyInPandasWithState(step, EXPIRED, "at long, status string", "append", GroupStateTimeout.EventTimeTimeout)


ALERTS = "provider long, run_id long, failures int, raised_at timestamp"


def failure_alerts(runs: DataFrame, threshold: int = 3, idle_days: int = 30, late: str = "1 hour") -> DataFrame:
    """An alert when a provider fails ``threshold`` times in a row; a success ends the row, so each raises one alert.

    ``runs`` has provider, run_id, ts and ok; rows of a batch are taken in order of (ts, run_id). A
    provider that is silent for ``idle_days`` of event time starts anew, and its state is dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        out, r = [], None
        for r in pd.concat(parts).sort_values(["ts", "run_id"]).itertuples(index=False):
            n = 0 if r.ok else n + 1
            if n == threshold:
                out.append((key[0], r.run_id, n, r.ts))
        state.update((n,))
        state.setTimeoutTimestamp(max(int(r.ts.value // 1_000_000) + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["provider", "run_id", "failures", "raised_at"])

    keyed = runs.withWatermark("ts", late).groupBy("provider")
    return keyed.applyInPandasWithState(step, ALERTS, "n int", "append", GroupStateTimeout.EventTimeTimeout)


def judged(new: DataFrame, known: DataFrame | None, key: list[str]) -> DataFrame:
    """Each different content of ``new`` with its ``content_hash``, the ``known_hash`` of its key and ``outcome``: INSERT, CONFLICT or KNOWN.

    Rows are dealt by key once, before they get their hashes; duplicates, the known hash and the
    least one of a key are found where the key's rows lie.
    """
    other = [c for c in new.columns if c not in key]
    digest = F.sha2(F.to_json(F.struct(*sorted(other)), {"ignoreNullFields": "false"}), 256)
    hashed = new.repartition(*key).withColumn("content_hash", digest).dropDuplicates([*key, "content_hash"])
    first = F.min("content_hash").over(Window.partitionBy(*key))
    if known is None:
        ranked = hashed.withColumn("held", F.lit(None).cast("string"))
    else:
        ranked = hashed.join(known.select(*key, F.col("content_hash").alias("held")), key, "left")
    ranked = ranked.withColumn("known_hash", F.coalesce("held", first))
    outcome = F.when(F.col("content_hash") != F.col("known_hash"), "CONFLICT").when(F.col("held").isNull(), "INSERT").otherwise("KNOWN")
    return ranked.select(*new.columns, "content_hash", "known_hash", outcome.alias("outcome"))


def capture(new: DataFrame, known: DataFrame | None, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) of a batch against what is known.

    A row whose key and content are known, or came before in the batch, is a no-op. A key with
    other content is a conflict: of a new key the row with the least content hash is appended.
    """
    told = judged(new, known, key)
    return told.where("outcome = 'INSERT'").select(*new.columns, "content_hash"), told.where("outcome = 'CONFLICT'").select(*new.columns, "content_hash", "known_hash")


def append_new(sink: str, conflict_sink: str, key: list[str]):
    """A foreachBatch function: rows whose key the sink has not yet are appended, other content under a
    known key goes to ``conflict_sink``; replays are no-ops in both.

    Only keys and hashes of the sinks are read.
    """

    def read(spark, path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:  # the first batch finds no sink
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh, conflicts = capture(batch, read(spark, sink), key)
        seen = read(spark, conflict_sink)
        if seen is not None:
            conflicts = conflicts.join(seen.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")
        conflicts.write.mode("append").parquet(conflict_sink)  # before the sink, which they are told by
        fresh.write.mode("append").parquet(sink)

    return write
