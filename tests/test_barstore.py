"""Stored bars: look-back refreshes, rebuilds of missed bars, and runs that break off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidepool.operators import barstore, rollup
from tidepool.sources import tables
from tidepool.sources.adapters import Tables
from tidepool.streaming import jobs


def bar(pool, bucket, volume, price=1.0):
    return (pool, bucket, volume, volume, 0.0, 0.0, 1, 1, 0.0, 0, 0, price, price, price, price, 5.0, 5.0, 1, 1)


FIELDS = "pool string, bucket long, volume double, buy_volume double, sell_volume double, fee_milli double, swap_count long, unique_traders long, net_deposit double, add_count long, remove_count long, open double, high double, low double, close double, tvl_close double, active_tvl_close double, va_close int, active_bin_close int"


def volumes(spark, where, name):
    return {(r.pool, r.bucket): r.volume for r in barstore.bars(spark, where, name).collect()}


def test_late_bars_count_within_the_look_back_only(spark, tmp_path):
    where, hour, day = str(tmp_path / "w"), 3600, 86_400
    frame = lambda rows: spark.createDataFrame(rows, FIELDS)
    now = 20 * day
    barstore.upsert(frame([bar("p", h * hour, 1.0) for h in range(17 * 24, 20 * 24)]), where, "10m")
    barstore.refresh(spark, where, 18 * day)
    barstore.refresh(spark, where, now)
    assert volumes(spark, where, "24h") == {("p", 17 * day): 24.0, ("p", 18 * day): 24.0, ("p", 19 * day): 24.0}
    late = [bar("p", now - 2 * hour + 600, 10.0), bar("p", now - 9 * hour + 600, 100.0), bar("p", now - 30 * hour + 600, 1000.0), bar("q", now - 9 * day, 7.0)]
    barstore.upsert(frame(late), where, "10m")
    barstore.refresh(spark, where, now)
    one, four = volumes(spark, where, "1h"), volumes(spark, where, "4h")
    assert one["p", now - 2 * hour] == 11.0 and one["p", now - 9 * hour] == 1.0 and ("q", now - 9 * day) not in one
    assert four["p", now - 4 * hour] == 14.0 and four["p", now - 12 * hour] == 4.0  # 9 hours back: too old for the 1h bars below
    assert volumes(spark, where, "10m")["p", now - 30 * hour + 600] == 1000.0


def test_a_stream_of_bars_refreshes_the_coarser_ones(spark, tmp_path):
    where, source = str(tmp_path / "w"), str(tmp_path / "in")
    parts = [[bar("p", h * 3600, 1.0) for h in range(48)], [bar("p", 47 * 3600 + 600, 5.0), bar("p", 47 * 3600, 2.0), bar("p", 3600 + 600, 50.0)]]
    for rows in parts:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(source)
        jobs.refreshing(jobs.landed(spark, source, spark.read.parquet(source).schema), where, str(tmp_path / "c")).awaitTermination()
    found = volumes(spark, where, "1h")
    assert found["p", 47 * 3600] == 7.0 and found["p", 46 * 3600] == 1.0 and found["p", 3600] == 1.0
    assert volumes(spark, where, "24h") == {("p", 0): 24.0, ("p", 86_400): 30.0}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).drop("day").collect()))


@pytest.mark.parametrize("breaks", [None, 1, 2, 3])
def test_rebuilt_bars_are_those_from_scratch(spark, tmp_path, monkeypatch, breaks):
    t, where = Tables(spark, SF), str(tmp_path / "w")
    raw = t.swaps(), t.snapshots(), t.liquidity()
    whole = rollup.frames(rollup.bars(*raw, 600).persist())
    missed = (F.col("bucket") / 600).cast("long") % 3 == 0
    barstore.upsert(whole["10m"].filter(~missed), where, "10m")
    for name, (width, below, _) in barstore.CHAIN.items():
        barstore.upsert(rollup.coarser(barstore.bars(spark, where, below).drop("day"), width), where, name)
    assert rows(barstore.bars(spark, where, "24h")) != rows(whole["24h"])
    if breaks:
        calls, replace = [], tables.replace

        def fails(*a):
            calls.append(1)
            if len(calls) == breaks:
                raise OSError("lost")
            replace(*a)

        with monkeypatch.context() as broken:
            broken.setattr(tables, "replace", fails)
            with pytest.raises(OSError, match="lost"):
                barstore.rebuild(*raw, where)
    barstore.rebuild(*raw, where)
    for name, frame in whole.items():
        assert rows(barstore.bars(spark, where, name)) == rows(frame), name
