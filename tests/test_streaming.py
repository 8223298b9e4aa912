"""Streams against the same work in batch."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/events"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.orderBy("ts").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(batch.schema).parquet(folder), batch


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(40), q.lastProgress
    return spark.table(name)


def test_windows_match_batch(spark, events):
    stream, batch = events
    make = lambda e: e.select(F.col("event_type").alias("topic"), F.col("user_id").alias("author"), F.col("ts").alias("published_at"), F.col("value").alias("sentiment"))
    got = drained(spark, jobs.narrative_windows(make(stream)), "z1", "complete")
    by = make(batch).groupBy("topic", F.window("published_at", "1 day").start.alias("window_start"))
    want = by.agg(F.count("*").alias("volume"), F.count_distinct("author").alias("authors"), F.round(F.avg("sentiment"), 9).alias("s"))
    got = got.withColumn("s", F.round("sentiment", 9)).drop("sentiment")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_close_by_watermark_and_drop_late_posts(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/posts"
    posts = lambda *rows: spark.createDataFrame([("t", a, pd.Timestamp(at, tz="UTC").to_pydatetime(), 1.0) for a, at in rows], "topic string, author long, published_at timestamp, sentiment double").coalesce(1).write.mode("append").parquet(folder)
    posts((1, "2024-01-01 10:00"), (2, "2024-01-01 11:00"), (1, "2024-01-03 12:00"))
    checkpoint = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"

    def run():
        stream = spark.readStream.schema("topic string, author long, published_at timestamp, sentiment double").parquet(folder)
        q = jobs.narrative_windows(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    run()
    posts((3, "2024-01-01 12:00"), (4, "2024-01-03 13:00"), (5, "2024-01-06 00:00"))  # the first is later than the watermark
    run()
    got = {(r.window_start.day, r.volume, r.authors) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 2, 2), (3, 2, 2)}


def test_sliding_sli(spark, events):
    stream, batch = events
    got = drained(spark, jobs.sliding_sli(stream.withColumn("service", F.col("user_id") % 5)), "z2", "complete")
    assert got.agg(F.sum("total")).first()[0] == 2 * batch.count()


def test_once_by_key(spark, events):
    stream, batch = events
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert drained(spark, jobs.once_by_key(twice, ["event_id"], "ts"), "z8").count() == batch.count()


def test_reservation_matches_batch(spark, events):
    stream, batch = events
    make = lambda e: e.select(F.col("user_id").alias("account_id"), F.to_date("ts").alias("day"), F.col("event_id").alias("order_id"), F.col("ts").alias("at"), F.col("value").cast("double").alias("amount"))
    got = drained(spark, jobs.reserve_notional(make(stream), 200.0), "z4")
    want = portfolio.reserve(make(batch), ["account_id", "day"], ["at", "order_id"], "amount", 200.0)
    key = ["account_id", "day", "order_id", "accepted"]
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and got.count() == want.count()


def test_append_new_is_idempotent(spark, events):
    _, batch = events
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write = jobs.append_new(f"{folder}/sink", f"{folder}/conflicts", ["event_id"])
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(f"{folder}/sink").count() == batch.count()
    assert spark.read.parquet(f"{folder}/conflicts").count() == 0
    changed = batch.where("event_id < 3").withColumn("value", F.col("value") + 1)
    for _ in range(2):
        write(changed.unionByName(batch.where("event_id = 5")), 1)
    assert spark.read.parquet(f"{folder}/sink").count() == batch.count()
    conflicts = spark.read.parquet(f"{folder}/conflicts")
    assert sorted(r.event_id for r in conflicts.collect()) == [0, 1, 2]


def test_late_flag(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS published_at, timestamp'2024-01-01 07:00:00' AS ingested_at UNION ALL SELECT timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 05:00:00'")
    assert sorted(r.late for r in jobs.late_flag(rows).collect()) == [False, True]


def test_signals_expire_once(spark, events):
    stream, batch = events
    make = lambda e: e.select(F.col("user_id").alias("signal_id"), "ts", F.col("event_type").alias("status"))
    got = {(r.signal_id, r.status) for r in drained(spark, jobs.expire_signals(make(stream)), "z5").collect()}
    last = batch.groupBy("user_id").agg(F.max("ts").alias("t"), F.max_by("event_type", "ts").alias("status"))
    mark = batch.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("mark"))
    want = {(r.user_id, r.status) for r in last.join(mark).where("t + INTERVAL 6 HOURS < mark").collect()}
    assert got == want and want


def test_failure_alerts_match_islands(spark, events):
    stream, batch = events
    make = lambda e: e.select((F.col("user_id") % 5).alias("provider"), F.col("event_id").alias("run_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    got = sorted((r.provider, r.run_id) for r in drained(spark, jobs.failure_alerts(make(stream), 2), "z7").collect())
    want, n = [], {}
    for r in make(batch).orderBy("provider", "ts", "run_id").collect():
        n[r.provider] = 0 if r.ok else n.get(r.provider, 0) + 1
        if n[r.provider] == 2:
            want.append((r.provider, r.run_id))
    assert got == sorted(want) and want
