"""Queries of the rollup layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators import rollup
from tidepool.plans.registry import query
from tidepool.schemas import TIMEFRAMES
from tidepool.sources.adapters import Tables, sql

_USD = ("volume", "buy_volume", "sell_volume", "net_deposit", "tvl_close", "active_tvl_close", "active_tvl_median", "open", "high", "low", "close")


def shown(bars: DataFrame) -> DataFrame:
    """Decimals as doubles, fees in USD."""
    out = bars.withColumn("fee", F.col("fee_milli").cast("double") / 1000).drop("fee_milli") if "fee_milli" in bars.columns else bars
    return out.select(*[F.col(c).cast("double").alias(c) if c in _USD else F.col(c) for c in out.columns])


def swap_bars_sql(width: int, traders: bool = True) -> str:
    return f"""select pool, t - t % {width} as bucket, sum(volume_usd) as volume, sum(volume_usd) filter (not swap_for_y) as buy_volume,
      sum(volume_usd) filter (swap_for_y) as sell_volume, sum(fee_milli) as fee_milli, count(*) as swap_count, {"count(distinct signer) as unique_traders," if traders else ""}
      first(price order by t, event_id) as open, max(price) as high, min(price) as low, last(price order by t, event_id) as close
      from swaps group by pool, t - t % {width}"""


def state_bars_sql(width: int) -> str:
    return f"""select pool, t - t % {width} as bucket, last(tvl order by t, event_id) as tvl_close, last(active_tvl order by t, event_id) as active_tvl_close,
      last(va order by t, event_id) as va_close, first(active_bin order by t, event_id) as active_bin_open, last(active_bin order by t, event_id) as active_bin_close
      from snapshots group by pool, t - t % {width}"""


def liquidity_bars_sql(width: int) -> str:
    return f"""select pool, t - t % {width} as bucket, sum(case when action = 0 then amount_usd else -amount_usd end) as net_deposit,
      count(*) filter (action = 0) as add_count, count(*) filter (action = 1) as remove_count from liquidity group by pool, t - t % {width}"""


def median_sql(width: int) -> str:
    spread = f"""select pool, t, event_id, active_tvl, unnest(range(t - t % {width}, t - t % {width} + 3600, {width})) as bucket from snapshots"""
    ranked = f"select *, row_number() over (partition by pool, bucket order by active_tvl, t, event_id) as rn, count(*) over (partition by pool, bucket) as n from ({spread})"
    return f"select pool, bucket, cast(cast(sum(active_tvl) as double) / count(*) as decimal(24,6)) as active_tvl_median from ({ranked}) where rn in ((n + 1) // 2, (n + 2) // 2) group by pool, bucket"


def bars_ctes(width: int) -> dict[str, str]:
    return {
        f"sb{width}": swap_bars_sql(width), f"st{width}": state_bars_sql(width), f"lb{width}": liquidity_bars_sql(width), f"md{width}": median_sql(width),
        f"bars{width}": f"select * from st{width} left join sb{width} using (pool, bucket) left join lb{width} using (pool, bucket) left join md{width} using (pool, bucket)",
    }


_SHOWN = """volume::double as volume, buy_volume::double as buy_volume, sell_volume::double as sell_volume, fee_milli::double / 1000 as fee, swap_count,
  open::double as open, high::double as high, low::double as low, close::double as close"""
_BARS_SHOWN = f"""pool, bucket, {_SHOWN}, unique_traders, tvl_close::double as tvl_close, active_tvl_close::double as active_tvl_close, va_close, active_bin_close,
  net_deposit::double as net_deposit, add_count, remove_count"""
_TRIO = ("swaps", "snapshots", "liquidity")


def chain_ctes(upto: str) -> dict[str, str]:
    out, below = bars_ctes(600), "bars600"
    for name in ("1h", "4h", "24h"):
        w = TIMEFRAMES[name]
        sums = ", ".join(f"cast(sum({c}) as {'decimal(38,4)' if c in ('volume', 'buy_volume', 'sell_volume', 'fee_milli', 'net_deposit') else 'bigint'}) as {c}" for c in ("volume", "buy_volume", "sell_volume", "fee_milli", "swap_count", "unique_traders", "net_deposit", "add_count", "remove_count"))
        lasts = ", ".join(f"last({c} order by bucket) as {c}" for c in ("tvl_close", "active_tvl_close", "va_close", "active_bin_close"))
        out[f"c{name}"] = f"""select pool, bucket - bucket % {w} as bucket, {sums}, arg_min(open, bucket) as open, max(high) as high, min(low) as low,
          arg_max(close, bucket) as close, {lasts} from {below} group by pool, bucket - bucket % {w}"""
        below = f"c{name}"
        if name == upto:
            break
    return out


def _raw(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.swaps(), t.snapshots(), t.liquidity()


@query(sql(f"select {_BARS_SHOWN}, active_bin_open, active_tvl_median::double as active_tvl_median from bars300", *_TRIO, **bars_ctes(300)))
def rollup_5m(t: Tables) -> DataFrame:
    return shown(rollup.bars(*_raw(t), 300))


_TEN = f"{_BARS_SHOWN}, active_bin_open, active_tvl_median::double as active_tvl_median"


@query(sql(f"select {_TEN.replace('pool, bucket', 'b.pool, bucket')}, tier = 0 as native_resolution from bars600 b join pools p on b.pool = p.pool", *_TRIO, "pools", **bars_ctes(600)))
def rollup_10m(t: Tables) -> DataFrame:
    """Watched pools have 5-minute bars below; the others' 10-minute bars are native."""
    bars = rollup.bars(*_raw(t), 600)
    tiers = t.pools().select("pool", "tier")
    parts = [bars.join(tiers.filter(F.col("tier") == tier), "pool").withColumn("native_resolution", F.lit(tier == 0)).drop("tier") for tier in (1, 0)]
    return shown(parts[0].unionByName(parts[1]))


@query(sql(f"select {_BARS_SHOWN} from c1h", *_TRIO, **chain_ctes("1h")))
def rollup_1h(t: Tables) -> DataFrame:
    return shown(rollup.chain(*_raw(t), "1h"))


@query(sql(f"select {_BARS_SHOWN} from c4h", *_TRIO, **chain_ctes("4h")))
def rollup_4h(t: Tables) -> DataFrame:
    return shown(rollup.chain(*_raw(t), "4h"))


@query(sql(f"select {_BARS_SHOWN} from c24h", *_TRIO, **chain_ctes("24h")))
def rollup_24h(t: Tables) -> DataFrame:
    return shown(rollup.chain(*_raw(t), "24h"))


@query(sql(f"select pool, bucket, {_SHOWN}, unique_traders from ({swap_bars_sql(300)})", "swaps"))
def swap_bars_5m(t: Tables) -> DataFrame:
    return shown(rollup.swap_bars(t.swaps(), 300))


@query(sql(f"select pool, bucket, tvl_close::double as tvl_close, active_tvl_close::double as active_tvl_close, va_close, active_bin_open, active_bin_close from ({state_bars_sql(300)})", "snapshots"))
def state_bars_5m(t: Tables) -> DataFrame:
    return shown(rollup.state_bars(t.snapshots(), 300))


@query(sql(f"select pool, bucket, net_deposit::double as net_deposit, add_count, remove_count from ({liquidity_bars_sql(3600)})", "liquidity"))
def liquidity_bars_1h(t: Tables) -> DataFrame:
    return shown(rollup.liquidity_bars(t.liquidity(), 3600))


@query(sql(f"select pool, bucket, active_tvl_median::double as active_tvl_median from ({median_sql(300)})", "snapshots"))
def trailing_median_5m(t: Tables) -> DataFrame:
    return shown(rollup.trailing_median(t.snapshots(), 300))


@query(sql("select pool, t - t % 3600 as bucket, count(distinct signer) as traders from swaps group by all", "swaps"))
def exact_traders_1h(t: Tables) -> DataFrame:
    return rollup.swap_bars(t.swaps(), 3600).select("pool", "bucket", F.col("unique_traders").alias("traders"))


@query(sql("select distinct s.pool, s.t - s.t % 300 as bucket from snapshots s where not exists (select 1 from built b where b.pool = s.pool and b.bucket = s.t - s.t % 300)", *_TRIO, built="select distinct pool, t - t % 300 as bucket from snapshots where event_id % 3 = 0"))
def missed_buckets(t: Tables) -> DataFrame:
    """Buckets that have raw state but were not built, here where a third of the snapshots had arrived in time."""
    built = rollup.state_bars(t.snapshots().filter("event_id % 3 = 0"), 300)
    return rollup.touched(t.snapshots(), built, 300)


_BUILT = "select distinct pool, t - t % 300 as bucket from snapshots where event_id % 3 = 0"


@query(sql(f"select {_BARS_SHOWN}, active_bin_open, active_tvl_median::double as active_tvl_median from bars300 b where not exists (select 1 from built x where x.pool = b.pool and x.bucket = b.bucket)", *_TRIO, built=_BUILT, **bars_ctes(300)))
def rebuilt_bars_5m(t: Tables) -> DataFrame:
    """The bars of missed buckets, built from the raw rows that they need."""
    built = rollup.state_bars(t.snapshots().filter("event_id % 3 = 0"), 300)
    return shown(rollup.rebuilt(*_raw(t), built, 300))


@query(sql("select distinct w::integer as width, b.pool, b.bucket - b.bucket % w as bucket from (select distinct pool, t - t % 300 as bucket from snapshots) b, (values (3600), (14400), (86400)) ws(w) where not exists (select 1 from built x where x.pool = b.pool and x.bucket = b.bucket)", *_TRIO, built=_BUILT))
def windows_to_rebuild(t: Tables) -> DataFrame:
    """Coarser bars over rebuilt ones."""
    built = rollup.state_bars(t.snapshots().filter("event_id % 3 = 0"), 300)
    return rollup.touched_windows(rollup.touched(t.snapshots(), built, 300), (3600, 14400, 86400))


@query(sql(
    """select r.pool, r.top_volume::double / r.volume::double as top_share, 2 * r.back::double / r.volume::double as round_trip, r.signers, r.bucket from (
      select pool, bucket, sum(volume) as volume, sum(volume) filter (rn <= 5) as top_volume, sum(least(buy, sell)) as back, count(*) as signers from (
        select *, row_number() over (partition by pool, bucket order by volume desc, signer) as rn from (
          select pool, t - t % 86400 as bucket, signer, sum(volume_usd) as volume, coalesce(sum(volume_usd) filter (not swap_for_y), 0) as buy, coalesce(sum(volume_usd) filter (swap_for_y), 0) as sell
          from swaps group by pool, t - t % 86400, signer)) group by pool, bucket) r""", "swaps"))  # fmt: skip
def trader_concentration_24h(t: Tables) -> DataFrame:
    return rollup.trader_concentration(t.swaps(), 86400)


_RANKED = """select pool, bucket, volume::double as volume, (volume - previous)::double as volume_change from (
  select *, lag(volume) over (partition by pool order by bucket) as previous from c1h) where bucket = (select max(bucket) from c1h)"""


@query(sql(_RANKED, *_TRIO, **chain_ctes("1h")))
def volume_ranking(t: Tables) -> DataFrame:
    """The latest hour's pools by volume, with the change against the pool's bar before. The flagship query."""
    bars = rollup.chain(*_raw(t), "1h").select("pool", "bucket", "volume")
    changed = bars.withColumn("volume_change", F.col("volume") - F.lag("volume").over(W.partitionBy("pool").orderBy("bucket")))
    latest = bars.agg(F.max("bucket").alias("bucket"))
    top = changed.join(F.broadcast(latest), "bucket").orderBy(F.desc_nulls_last("volume"), "pool").limit(1000)
    return top.select("pool", "bucket", F.col("volume").cast("double").alias("volume"), F.col("volume_change").cast("double").alias("volume_change"))
