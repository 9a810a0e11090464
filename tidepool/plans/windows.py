"""Queries of windows over bars and of keyed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scalar import garman_klass
from tidepool.operators import rollup, windows
from tidepool.plans.registry import query
from tidepool.plans.rollup import chain_ctes, swap_bars_sql
from tidepool.sources.adapters import Tables, sql

_TRIO = ("swaps", "snapshots", "liquidity")
_P = "partition by pool order by bucket"


def hourly(t: Tables) -> DataFrame:
    """Hourly swap bars as doubles, without gaps filled."""
    bars = rollup.swap_bars(t.swaps(), 3600, traders=False)
    number = [F.col(c).cast("double").alias(c) for c in ("volume", "open", "high", "low", "close")]
    return bars.select("pool", "bucket", "swap_count", *number, (F.col("fee_milli").cast("double") / 1000).alias("fee"))


HOURLY = {"sb": swap_bars_sql(3600, traders=False), "h": "select pool, bucket, swap_count, volume::double as volume, open::double as open, high::double as high, low::double as low, close::double as close, fee_milli::double / 1000 as fee from sb"}
RETURNS = {"rr": f"select pool, bucket, close, lag(close) over ({_P}) as p from h where close is not null", "ret": "select pool, bucket, ln(close / p) as r from rr where p > 0 and close > 0"}


@query(sql(f"select pool, bucket, round(volume::double - lag(volume::double) over ({_P}), 6) as volume_change, round(tvl_close::double - lag(tvl_close::double) over ({_P}), 6) as tvl_change, round(close::double - lag(close::double) over ({_P}), 8) as price_change from c1h", *_TRIO, **chain_ctes("1h")))
def bar_changes_1h(t: Tables) -> DataFrame:
    bars = rollup.chain(t.swaps(), t.snapshots(), t.liquidity(), "1h").select("pool", "bucket", *[F.col(c).cast("double").alias(c) for c in ("volume", "tvl_close", "close")])
    out = windows.changes(bars, ["volume", "tvl_close", "close"])
    return out.select("pool", "bucket", F.round("volume_change", 6).alias("volume_change"), F.round("tvl_close_change", 6).alias("tvl_change"), F.round("close_change", 8).alias("price_change"))


@query(sql("select pool, bucket, round(r, 9) as r from ret", "swaps", **HOURLY, **RETURNS))
def log_returns_1h(t: Tables) -> DataFrame:
    return windows.log_returns(hourly(t)).select("pool", "bucket", F.round("r", 9).alias("r"))


@query(sql(
    f"""select pool, bucket, round(rv, 9) as rv, round(bv, 9) as bv, round(case when rv <= 0 then 0.05 else greatest((rv - bv) / rv, 0.05) end, 6) as jump_share from (
      select pool, bucket, sum(r * r) over ({_P} rows between 23 preceding and current row) as rv,
        pi() / 2 * coalesce(sum(pair) over ({_P} rows between 22 preceding and current row), 0) as bv
      from (select pool, bucket, r, abs(r) * abs(lag(r) over ({_P})) as pair from ret))""", "swaps", **HOURLY, **RETURNS))  # fmt: skip
def realised_variance_24h(t: Tables) -> DataFrame:
    out = windows.realised(windows.log_returns(hourly(t)), 24)
    return out.select("pool", "bucket", F.round("rv", 9).alias("rv"), F.round("bv", 9).alias("bv"), F.round("jump_share", 6).alias("jump_share"))


_LAGS = ", ".join(f"x * lag(x, {k}) over ({_P}) as x{k}" for k in range(1, 7))
_RHOS = ", ".join(f"round(case when count(*) >= 20 and avg(x * x) > 0 then sum(x{k}) / (count(*) - {k}) / avg(x * x) end, 6) as rho_{k}" for k in range(1, 7))


@query(sql(f"select pool, count(*) as returns, {_RHOS} from (select pool, x, {_LAGS} from (select pool, bucket, r - avg(r) over (partition by pool) as x from ret)) group by pool", "swaps", **HOURLY, **RETURNS))
def autocorrelation_1h(t: Tables) -> DataFrame:
    out = windows.autocorrelations(windows.log_returns(hourly(t)))
    return out.select("pool", "returns", *[F.round(f"rho_{k}", 6).alias(f"rho_{k}") for k in range(1, 7)])


def _full(column: str, k: int) -> str:
    return f"case when count(*) over ({_P} rows between {k - 1} preceding and current row) >= {k} then sum({column}) over ({_P} rows between {k - 1} preceding and current row) end"


@query(sql(
    f"""select pool, bucket, round(sum(volume) over ({_P} rows between 23 preceding and current row), 4) as volume_24h, round({_full("fee", 24)}, 6) as fee_24h, round({_full("fee", 168)}, 6) as fee_7d,
      round(case when count(*) over ({_P} rows between 47 preceding and current row) >= 48 and sum(volume) over ({_P} rows between 47 preceding and 24 preceding) > 0 then
        (coalesce({_full("volume", 24)}, 0) - sum(volume) over ({_P} rows between 47 preceding and 24 preceding)) / sum(volume) over ({_P} rows between 47 preceding and 24 preceding) else 0 end, 6) as volume_trend from h""",
    "swaps", **HOURLY))
def trailing_flows_1h(t: Tables) -> DataFrame:
    return hourly(t).select(
        "pool", "bucket", F.round(windows.trailing_sum("volume", 24), 4).alias("volume_24h"), F.round(windows.full_sum("fee", 24), 6).alias("fee_24h"),
        F.round(windows.full_sum("fee", 168), 6).alias("fee_7d"), F.round(windows.trend("volume", 24), 6).alias("volume_trend"),
    )


@query(sql(
    """select p.pool, coalesce(s.hours, 0.0)::double as hours from (select distinct pool from h) p left join (
      select pool, (max(last) - min(bucket)) / 3600 as hours from (
        select pool, bucket, max(bucket) over (partition by pool) as last, max(case when not coalesce(volume < 150, false) then bucket end) over (partition by pool) as broken from h)
      where broken is null or bucket > broken group by pool) s on s.pool = p.pool""", "swaps", **HOURLY))  # fmt: skip
def hours_below_1h(t: Tables) -> DataFrame:
    return windows.hours_below(hourly(t), "volume", 150.0)


_GK = "case when close is not null then 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) end"
_EWMA = """with recursive {ctes}, n as (select pool, bucket, x, row_number() over (partition by pool order by bucket) as i from g),
  f as (select pool, bucket, i, 0.03 * x as fast, 0.003 * x as slow from n where i = 1 union all select n.pool, n.bucket, n.i, 0.97 * f.fast + 0.03 * n.x, 0.997 * f.slow + 0.003 * n.x from f join n on n.pool = f.pool and n.i = f.i + 1)
  select pool, bucket, round(fast, 9) as fast, round(slow, 9) as slow from f"""


@query(sql("", "swaps", **HOURLY, g=f"select pool, bucket, {_GK} as x from h") and _EWMA.format(ctes=sql("", "swaps", **HOURLY, g=f"select pool, bucket, {_GK} as x from h").removeprefix("with ").strip()))
def ewma_variance_1h(t: Tables) -> DataFrame:
    rows = hourly(t).select("pool", "bucket", garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close")).alias("x"))
    out = windows.ewma(windows.ewma(rows, "x", 0.97, "fast"), "x", 0.997, "slow")
    return out.select("pool", "bucket", F.round("fast", 9).alias("fast"), F.round("slow", 9).alias("slow"))


@query(sql("select pool, t, event_id, sum(fee_milli) over (partition by pool order by t, event_id rows unbounded preceding)::double / 1000 as fees from swaps", "swaps"))
def cumulative_fees(t: Tables) -> DataFrame:
    out = windows.running_sum(t.swaps(), ["pool"], ["t", "event_id"], "fee_milli", "total")
    return out.select("pool", "t", "event_id", (F.col("total").cast("double") / 1000).alias("fees"))


_READS = {"reads": "select pool, t, event_id, active_bin // 40 as a, va // 500 as b from snapshots", "lagged": "select *, lag(a) over w as pa, lag(b) over w as pb, row_number() over w as rn from reads window w as (partition by pool order by t, event_id)"}


@query(sql("select pool, t, 'a' as field, pa::bigint as old_value, a::bigint as new_value from lagged where rn > 1 and a is distinct from pa union all select pool, t, 'b', pb::bigint, b::bigint from lagged where rn > 1 and b is distinct from pb", "snapshots", **_READS))
def fee_parameter_changes(t: Tables) -> DataFrame:
    """One row for each parameter that changed between a pool's reads."""
    reads = t.snapshots().select("pool", "t", "event_id", F.floor(F.col("active_bin") / 40).alias("a"), F.floor(F.col("va") / 500).alias("b"))
    return windows.field_changes(reads, ["a", "b"])


@query(sql("select pool, t, event_id, a, b from (select *, a is distinct from pa or b is distinct from pb as changed from lagged) where rn = 1 or changed", "snapshots", **{k: v.replace("active_bin // 40 as a, va // 500 as b", "(active_bin // 40)::bigint as a, (va // 500)::bigint as b") for k, v in _READS.items()}))
def changed_state_rows(t: Tables) -> DataFrame:
    """State rows are kept only where something changed."""
    reads = t.snapshots().select("pool", "t", "event_id", F.floor(F.col("active_bin") / 40).alias("a"), F.floor(F.col("va") / 500).alias("b"))
    return windows.changed_only(reads, ["pool"], ["t", "event_id"], ["a", "b"])


@query(sql("select pool, bucket, volume from (select *, row_number() over (partition by pool order by bucket desc) as rn from h where bucket <= 1705536000) where rn <= 48", "swaps", **HOURLY))
def recent_history(t: Tables) -> DataFrame:
    return windows.recent(hourly(t).select("pool", "bucket", "volume"), 48, 1705536000)


_SIGNALS = {"sig": "select pool, t, event_id, case when v >= 100 then 'big' else 'small' end as kind from e where event_type = 'purchase'"}
_COOLED = """with recursive {ctes}, k as (select pool, kind, t, min(event_id) as event_id from sig group by all),
  f as (select pool, kind, min(t) as t from k group by pool, kind union all
    select f.pool, f.kind, (select min(k.t) from k where k.pool = f.pool and k.kind = f.kind and k.t >= f.t + 3600) from f where f.t is not null)
  select k.pool, k.kind, k.t, k.event_id from f join k on k.pool = f.pool and k.kind = f.kind and k.t = f.t"""


@query(_COOLED.format(ctes=sql("", "e", **_SIGNALS).removeprefix("with ").strip()))
def signal_cooldown(t: Tables) -> DataFrame:
    """Signals that are sent with an hour's cooldown by pool and kind."""
    e = t.events().filter("event_type = 'purchase'")
    return windows.cooled(e.select("pool", F.when(F.col("v") >= 100, "big").otherwise("small").alias("kind"), "t", "event_id"), ["pool", "kind"], 3600).select("pool", "kind", "t", "event_id")


@query(sql(
    """select stream, high as from_slot, slot as to_slot, slot - high - 1 as missed from (
      select *, max(slot) over (partition by stream order by arrival rows between unbounded preceding and 1 preceding) as high from a) where slot > high + 1""",
    "e", a="select pool as stream, event_id as arrival, t // 60 + (event_id % 3) as slot from e"))
def slot_gaps(t: Tables) -> DataFrame:
    e = t.events().select(F.col("pool").alias("stream"), F.col("event_id").alias("arrival"), (F.floor(F.col("t") / 60) + F.col("event_id") % 3).alias("slot"))
    return windows.slot_gaps(e)


@query(sql("select pool, t, event_id, tvl::double as tvl from (select *, row_number() over (partition by pool order by t desc, event_id desc) as rn from snapshots) where rn = 1", "snapshots"))
def latest_snapshot(t: Tables) -> DataFrame:
    return windows.latest_per_key(t.snapshots().select("pool", "t", "event_id", F.col("tvl").cast("double").alias("tvl")), ["pool"], ["t", "event_id"])


