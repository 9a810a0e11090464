"""Streams give what the batch form gives, also over a restart from the checkpoint."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidepool.operators import pipeline, windows
from tidepool.streaming import jobs


def run(stream, path, name, mode="append"):
    where = str(path / name)
    stream.writeStream.format("parquet").option("path", where).option("checkpointLocation", where + "-c").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return where


def test_cooldown_over_a_restart(spark, tmp_path):
    schema = StructType([StructField("pool", StringType()), StructField("kind", StringType()), StructField("t", LongType()), StructField("event_id", LongType())])
    rows = [("p", "k", t, i) for i, t in enumerate([0, 100, 3600, 3700, 7300])]
    source = str(tmp_path / "in")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        where = run(jobs.cooled_signals(jobs.landed(spark, source, schema), 3600), tmp_path, "out")
    batch = windows.cooled(spark.createDataFrame(rows, schema), ["pool", "kind"], 3600)
    assert sorted(r.t for r in spark.read.parquet(where).collect()) == sorted(r.t for r in batch.collect())


def test_bars_equal_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("p", start + dt.timedelta(seconds=70 * i), i, float(i), 1.0 + i) for i in range(40)]
    fields = "pool string, ts timestamp, event_id long, volume_usd double, price double"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(source)
    late = [("p", start + dt.timedelta(days=1), 99, 0.0, 0.0)]  # moves the watermark past the last bar
    spark.createDataFrame(late, fields).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    where = run(jobs.bars(jobs.landed(spark, source, schema, 1), "5 minutes"), tmp_path, "out")
    got = {r.bucket: (r.volume, r.open, r.close) for r in spark.read.parquet(where).collect()}
    batch = spark.createDataFrame(rows, fields).groupBy(F.window("ts", "5 minutes").start.alias("b")).agg(F.sum("volume_usd").alias("v"), F.min("price").alias("o"), F.max("price").alias("c"))
    want = {r.b: (r.v, r.o, r.c) for r in batch.collect()}
    assert got and all(want[b] == v for b, v in got.items()) and len(got) >= len(want) - 1


def test_averages_survive_a_restart(spark, tmp_path):
    fields = "pool string, t long, x double"
    source = str(tmp_path / "in")
    for part in ([("p", 1, 1.0), ("p", 2, 2.0)], [("p", 2, 2.0), ("p", 3, 4.0)]):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.landed(spark, source, spark.read.parquet(source).schema)
        where = run(jobs.averaged_variance(stream, 0.5), tmp_path, "out")
    assert [r.value for r in spark.read.parquet(where).orderBy("t").collect()] == pytest.approx([0.5, 1.25, 2.625])


def test_regimes_equal_the_batch_over_restarts(spark, tmp_path):
    fields = "pool string, bucket long, sigma_slow double, sigma_fast double, sufficient boolean, dev_peg double, age_days double, pegged boolean, major boolean, kill boolean"
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    rows = [
        (p, m * 600, pick(0.004, 0.004, 0.02, 0.06, 0.09, None), pick(0.004, 0.02, None), pick(True, True, True, True, False, None), pick(0.001, 0.004, 0.006, None), pick(10.0, 60.0, 60.0, 60.0), pick(True, True, False, None), pick(True, True, True, False, None), rng.random() < 0.01)
        for p in "abcdef" for block in range(60) for m in range(10 * block, 10 * block + 10)
    ]
    rows = [rows[i - i % (7 if r[0] < "d" else 40)][2:] for i, r in enumerate(rows)]  # values last, so that candidates do
    rows = [("abcdef"[i // 600], i % 600 * 600, *r) for i, r in enumerate(rows)]
    cfg, source = pipeline.Config(), str(tmp_path / "in")
    for low, high in ((0, 200), (200, 201), (150, 600)):  # the last part repeats bars that were seen
        part = [r for r in rows if low * 600 <= r[1] < high * 600]
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(source)
        where = run(jobs.regimes(jobs.landed(spark, source, spark.read.parquet(source).schema), cfg, 600), tmp_path, "out")
    want = sorted((r.pool, r.bucket, r.regime or "") for r in pipeline.regimes(spark.createDataFrame(rows, fields), cfg, 600).collect())
    assert sorted((r.pool, r.bucket, r.regime or "") for r in spark.read.parquet(where).collect()) == want
    assert {r[2] for r in want} == {"", "S", "V1", "V2"}


def test_append_sink_and_parameter_changes(spark, tmp_path):
    fields = "pool string, t long, a long, b long"
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    for part in ([("p", 1, 1, 1), ("p", 2, 1, 2)], [("p", 2, 1, 2), ("p", 3, 5, 2)]):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        jobs.append_sink(jobs.landed(spark, source, schema), target, str(tmp_path / "c"), ["pool", "t"]).awaitTermination()
        where = run(jobs.parameter_changes(jobs.landed(spark, source, schema)), tmp_path, "changes")
    assert spark.read.parquet(target).count() == 3
    assert sorted((r.t, r.field, r.old_value, r.new_value) for r in spark.read.parquet(where).collect()) == [(2, "b", 1, 2), (3, "a", 1, 5)]


def test_latest_state_and_watch_set(spark, tmp_path):
    fields = "pool string, slot long, seq long, value double"
    source = str(tmp_path / "in")
    spark.createDataFrame([("p", 5, 1, 1.0), ("p", 7, 2, 2.0), ("q", 1, 3, 9.0), ("p", 7, 4, 3.0), ("p", 6, 5, 4.0)], fields).coalesce(1).write.parquet(source)
    stream = jobs.landed(spark, source, spark.read.parquet(source).schema)
    query = jobs.latest_state(stream).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [("p", 7, 4, 3.0), ("q", 1, 3, 9.0)]
    seen = []
    jobs.watched(stream, lambda: spark.createDataFrame([("q",)], "pool string"), lambda rows: seen.extend(r.pool for r in rows.collect()), str(tmp_path / "w")).awaitTermination()
    assert seen == ["q"]


def test_block_times_join_whichever_side_comes_first(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    spark.createDataFrame([(1, at(0)), (2, at(1)), (3, at(2)), (99, at(9000))], "slot long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "tx"))
    spark.createDataFrame([(1, 100, at(5)), (2, 200, at(0)), (98, 1, at(9000))], "slot long, block_time long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "blocks"))
    left, right = (jobs.landed(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema) for n in ("tx", "blocks"))
    where = run(jobs.with_block_times(left, right), tmp_path, "out")
    assert {r.slot: r.block_time for r in spark.read.parquet(where).collect() if r.slot < 99} == {1: 100, 2: 200, 3: None}


def test_sliding_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("p", start + dt.timedelta(minutes=m), float(m)) for m in (0, 30, 59)] + [("p", start + dt.timedelta(days=1), 0.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "pool string, ts timestamp, active_tvl double").coalesce(1).write.parquet(source)
    where = run(jobs.sliding(jobs.landed(spark, source, spark.read.parquet(source).schema), "60 minutes", "30 minutes"), tmp_path, "out")
    assert {(r["window"].start.hour, r["window"].start.minute): r.n for r in spark.read.parquet(where).collect() if r["window"].start.day == 1} == {(0, 0): 3, (0, 30): 2}
