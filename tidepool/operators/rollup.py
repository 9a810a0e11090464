"""Rollup bars: raw events to 5- and 10-minute bars, and on to 1, 4 and 24 hours.

A bar exists if and only if its pool has a state snapshot in the bucket. Flows of a bar without swaps are null, not
zero. Every aggregate is keyed by (pool, bucket), so the joins of a bar's parts reuse one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions.scalar import bucket

KEY = ["pool", "bucket"]


def _first(value: str) -> Column:
    """The first row's value, null included."""
    return F.min_by(F.struct(value), F.struct("t", "event_id"))[value]


def _last(value: str) -> Column:
    return F.max_by(F.struct(value), F.struct("t", "event_id"))[value]


def _sum_if(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)))


def swap_bars(swaps: DataFrame, width: int, traders: bool = True) -> DataFrame:
    """Volumes, fees, counts, exact distinct traders, and open, high, low, close of each bucket's swaps. Selling the
    base token (swap_for_y) is sell volume."""
    rows = swaps.withColumn("bucket", bucket(F.col("t"), width))
    out = [
        F.sum("volume_usd").alias("volume"), _sum_if(~F.col("swap_for_y"), "volume_usd").alias("buy_volume"), _sum_if(F.col("swap_for_y"), "volume_usd").alias("sell_volume"),
        F.sum("fee_milli").alias("fee_milli"), F.count("*").alias("swap_count"),
        _first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), _last("price").alias("close"),
    ]
    bars = rows.groupBy(*KEY).agg(*out)
    if not traders:
        return bars
    # distinct signers in two steps: a hot pool's signers are pre-aggregated before its bar is
    distinct = rows.select(*KEY, "signer").distinct().groupBy(*KEY).agg(F.count("*").alias("unique_traders"))
    return bars.join(distinct, KEY)


def state_bars(snapshots: DataFrame, width: int) -> DataFrame:
    """Closing state of each bucket, and its first and last active bin."""
    rows = snapshots.withColumn("bucket", bucket(F.col("t"), width))
    return rows.groupBy(*KEY).agg(_last("tvl").alias("tvl_close"), _last("active_tvl").alias("active_tvl_close"), _last("va").alias("va_close"), _first("active_bin").alias("active_bin_open"), _last("active_bin").alias("active_bin_close"))


def liquidity_bars(liquidity: DataFrame, width: int) -> DataFrame:
    """Net deposits and counts of adds and removes; a bucket with one kind has zero of the other."""
    rows = liquidity.withColumn("bucket", bucket(F.col("t"), width))
    signed = F.when(F.col("action") == 0, F.col("amount_usd")).otherwise(-F.col("amount_usd"))
    return rows.groupBy(*KEY).agg(F.sum(signed).alias("net_deposit"), F.count_if(F.col("action") == 0).alias("add_count"), F.count_if(F.col("action") == 1).alias("remove_count"))


def trailing_median(snapshots: DataFrame, width: int, span: int = 3600) -> DataFrame:
    """Exact decimal median of active liquidity over the `span` seconds up to each bucket's end. Nulls don't count;
    of an even number the middle two are averaged."""
    # equal values of a bucket are counted before they are spread over the windows that see them
    counts = snapshots.filter("active_tvl is not null").groupBy("pool", bucket(F.col("t"), width).alias("first"), "active_tvl").agg(F.count("*").alias("c"))
    rows = counts.select("pool", "active_tvl", "c", F.explode(F.sequence(F.col("first"), F.col("first") + span - width, F.lit(width))).alias("bucket"))
    by = W.partitionBy(*KEY)
    placed = rows.select(*KEY, "active_tvl", F.sum("c").over(by.orderBy("active_tvl")).alias("upto"), F.sum("c").over(by).alias("n"))
    nth = lambda k: F.min(F.when(F.col("upto") >= F.floor((F.col("n") + k) / 2), F.col("active_tvl")))
    return placed.groupBy(*KEY).agg(((nth(1) + nth(2)) / 2).cast("decimal(24,6)").alias("active_tvl_median"))


def bars(swaps: DataFrame, snapshots: DataFrame, liquidity: DataFrame, width: int) -> DataFrame:
    """The full bars of one width, driven by the snapshots. Wider base bars come from raw rows too, never from
    narrower bars, so that distinct traders stay exact."""
    out = state_bars(snapshots, width)
    for part in (swap_bars(swaps, width), liquidity_bars(liquidity, width), trailing_median(snapshots, width)):
        out = out.join(part, KEY, "left")
    return out


_SUMS = ("volume", "buy_volume", "sell_volume", "fee_milli", "swap_count", "unique_traders", "net_deposit", "add_count", "remove_count")


def coarser(narrow: DataFrame, width: int) -> DataFrame:
    """Bars of a multiple of their width. Flows add up (traders too: an upper bound); state is the last bar's, null
    included; open and close are the first and last bar's with a price, so a quiet bar doesn't hide the others'."""
    rows = narrow.withColumn("at", F.col("bucket")).withColumn("bucket", bucket(F.col("at"), width))
    last = lambda c: F.max_by(F.struct(c), F.col("at"))[c].alias(c)
    return rows.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("at"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("at"))).alias("close"),
        *[last(c) for c in ("tvl_close", "active_tvl_close", "va_close", "active_bin_close")],
    )


def chain(swaps: DataFrame, snapshots: DataFrame, liquidity: DataFrame, upto: str) -> DataFrame:
    """Bars of 1h, 4h or 24h by the chain 10m, 1h, 4h, 24h."""
    out = bars(swaps, snapshots, liquidity, 600)
    for name, width in (("1h", 3600), ("4h", 14400), ("24h", 86400)):
        out = coarser(out, width)
        if name == upto:
            break
    return out


def touched(raw: DataFrame, built: DataFrame, width: int) -> DataFrame:
    """Buckets with raw state but no bar: what a backfill has to build."""
    return raw.select("pool", bucket(F.col("t"), width).alias("bucket")).distinct().join(built.select(*KEY), KEY, "left_anti")


def rebuilt(swaps: DataFrame, snapshots: DataFrame, liquidity: DataFrame, built: DataFrame, width: int) -> DataFrame:
    """The bars of buckets that have raw state but none in `built`, from the raw rows that they need: the buckets' own,
    and for the median those of the hour before."""
    keys = touched(snapshots, built, width)
    own = lambda df: df.withColumn("bucket", bucket(F.col("t"), width)).join(keys, KEY, "left_semi").drop("bucket")
    out = state_bars(own(snapshots), width)
    near = keys.select("pool", F.explode(F.sequence(F.col("bucket") - 3600 + width, F.col("bucket"), F.lit(width))).alias("bucket")).distinct()
    seen = snapshots.withColumn("bucket", bucket(F.col("t"), width)).join(near, KEY, "left_semi").drop("bucket")
    for part in (swap_bars(own(swaps), width), liquidity_bars(own(liquidity), width), trailing_median(seen, width)):
        out = out.join(part, KEY, "left")
    return out


def touched_windows(bars: DataFrame, widths: Sequence[int]) -> DataFrame:
    """(width, pool, bucket) of the coarser bars over rebuilt ones, which have to be built again."""
    over = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), bucket(F.col("bucket"), w).alias("bucket")) for w in widths])).alias("w")
    return bars.select("pool", over).select("w.width", "pool", "w.bucket").distinct()


def frames(base: DataFrame, upto: str = "24h") -> dict[str, DataFrame]:
    """Bars of 10m, 1h, 4h and 24h from 10-minute ones, which every frame reads: write them first."""
    out = {"10m": base}
    for name, below, width in (("1h", "10m", 3600), ("4h", "1h", 14400), ("24h", "4h", 86400)):
        out[name] = coarser(out[below], width)
        if name == upto:
            break
    return out


def trader_concentration(swaps: DataFrame, width: int, top: int = 5) -> DataFrame:
    """Share of a bucket's volume that its `top` signers make, and the share of volume that signers trade back and
    forth: twice the smaller of a signer's buys and sells."""
    rows = swaps.withColumn("bucket", bucket(F.col("t"), width))
    own = rows.groupBy(*KEY, "signer").agg(F.sum("volume_usd").alias("volume"), F.coalesce(_sum_if(~F.col("swap_for_y"), "volume_usd"), F.lit(0)).alias("buy"), F.coalesce(_sum_if(F.col("swap_for_y"), "volume_usd"), F.lit(0)).alias("sell"))
    ranked = own.withColumn("rn", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("volume"), "signer")))
    total = F.sum("volume").cast("double")
    return ranked.groupBy(*KEY).agg((F.sum(F.when(F.col("rn") <= top, F.col("volume"))).cast("double") / total).alias("top_share"), (2 * F.sum(F.least("buy", "sell")).cast("double") / total).alias("round_trip"), F.count("*").alias("signers"))
