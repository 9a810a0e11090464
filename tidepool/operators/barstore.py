"""Stored bars of all widths, by day: late and rebuilt bars are merged in, and coarser bars above them are made anew.

Tables are `bars_10m`, `bars_1h`, `bars_4h` and `bars_24h` under one folder, partitioned by day; only partitions that
get new bars are read and replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.scalar import bucket
from tidepool.operators import rollup
from tidepool.sources import tables

DAY = 86_400
#: Width, the bars below, and how far back each width is made anew as bars below come in late.
CHAIN = {"1h": (3600, "10m", 3 * 3600), "4h": (14_400, "1h", 12 * 3600), "24h": (DAY, "4h", 3 * DAY)}
BASE = 600


def _path(where: str, name: str) -> str:
    return f"{where.rstrip('/')}/bars_{name}"


def bars(spark: SparkSession, where: str, name: str) -> DataFrame | None:
    """The stored bars of one width, or None."""
    return tables.read(spark, _path(where, name))


def upsert(rows: DataFrame, where: str, name: str) -> None:
    """Puts bars (one row a pool and bucket) in the place of the stored ones of the same pool and bucket. Days that get
    no bar are not touched."""
    rows = rows.withColumn("day", F.floor(F.col("bucket") / DAY))
    days = [r.day for r in rows.select("day").distinct().collect()]
    if not days:
        return
    tables.recover(rows.sparkSession, _path(where, name), ["day"])
    there = bars(rows.sparkSession, where, name)
    if there is not None:
        kept = there.filter(F.col("day").isin(days)).join(rows.select("pool", "bucket"), ["pool", "bucket"], "left_anti")
        rows = rows.unionByName(kept)
    tables.replace(rows, _path(where, name), ["day"])


def newest(stored: DataFrame) -> int:
    """The last bucket of stored bars, of which only the last day is read."""
    day = stored.agg(F.max("day")).first()[0]
    return stored.filter(F.col("day") == day).agg(F.max("bucket")).first()[0]


def refresh(spark: SparkSession, where: str, now: int) -> None:
    """Makes the coarser bars of the look-back up to `now` anew from the bars below, and those since the last refresh if
    that is longer ago: late bars within it count, older ones change nothing. The first refresh makes all bars."""
    for name, (width, below, back) in CHAIN.items():
        source, stored = bars(spark, where, below), bars(spark, where, name)
        if source is None:
            continue
        source = source.filter(F.col("bucket") <= now)
        if stored is not None:
            start = min(now - back, newest(stored)) // width * width
            source = source.filter((F.col("day") >= start // DAY) & (F.col("bucket") >= start))
        upsert(rollup.coarser(source.drop("day"), width), where, name)


def rebuild(swaps: DataFrame, snapshots: DataFrame, liquidity: DataFrame, where: str) -> None:
    """Builds the 10-minute bars that raw state has and the store lacks, and then every coarser bar over them.

    The windows to make anew are stored before the first table changes and forgotten after the last one, so a run that
    breaks off anywhere is completed by the next.
    """
    spark = snapshots.sparkSession
    built = bars(spark, where, "10m")
    built = built if built is not None else snapshots.limit(0).select("pool", F.col("t").alias("bucket"))
    windows = rollup.touched_windows(rollup.touched(snapshots, built, BASE), [w for w, _, _ in CHAIN.values()])
    held = tables.newest(spark, f"{where}/windows")
    version = held[1] + 1 if held else 0
    tables.store(windows.union(held[0]).distinct() if held else windows, f"{where}/windows", version)
    windows = tables.newest(spark, f"{where}/windows")[0]
    upsert(rollup.rebuilt(swaps, snapshots, liquidity, built, BASE), where, "10m")
    for name, (width, below, _) in CHAIN.items():
        wanted = windows.filter(F.col("width") == width).select("pool", F.col("bucket").alias("window"))
        days = [r.day for r in wanted.select(F.floor(F.col("window") / DAY).alias("day")).distinct().collect()]
        source = bars(spark, where, below).filter(F.col("day").isin(days)).drop("day").withColumn("window", bucket(F.col("bucket"), width))
        upsert(rollup.coarser(source.join(wanted, ["pool", "window"], "left_semi").drop("window"), width), where, name)
    tables.store(windows.limit(0), f"{where}/windows", version + 1)
