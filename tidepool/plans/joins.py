"""Queries of joins, rankings, set operations and the choice of watched pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators import enrich, ranking, rollup
from tidepool.operators.windows import latest_per_key
from tidepool.plans import trading
from tidepool.plans.registry import query
from tidepool.plans.rollup import bars_ctes, chain_ctes, state_bars_sql, swap_bars_sql
from tidepool.plans.scoring_sql import scored_sql, significant
from tidepool.session import written
from tidepool.sources.adapters import Tables, sql

_TRIO = ("swaps", "snapshots", "liquidity")



def indicators(t: Tables, tf: str) -> DataFrame:
    """The evaluated bars of one timeframe."""
    return trading.evaluated(t, tf).select("pool", "bucket", "quality", "regime", "r_org", "volume_change")


def _ranked_sql(tf: str, body: str, **more: str) -> str:
    """A query over `ind`, the evaluated bars of one timeframe, and `latest`, their last bucket."""
    return scored_sql(trading.CFG, tf, body, ind="select pool, bucket, quality, regime, r_org, volume_change from scored", latest="select max(bucket) as bucket from scored", **more)


_R = significant("r_org")


@query(sql("select p.pool, p.bin_step, x.symbol as symbol_x, x.decimals as decimals_x, y.symbol as symbol_y, y.decimals as decimals_y from pools p left join tokens x on x.mint = p.token_x left join tokens y on y.mint = p.token_y", "pools", "tokens"))
def scoring_universe(t: Tables) -> DataFrame:
    return ranking.scoring_universe(t.pools(), t.tokens()).select("pool", "bin_step", "symbol_x", "decimals_x", "symbol_y", "decimals_y")


@query(sql("select s.pool, s.t, s.event_id, s.tvl::double as tvl, d.va from snapshots s left join sat d on d.pool = s.pool and d.t = s.t and d.event_id = s.event_id", "snapshots", sat="select pool, t, event_id, va from snapshots where event_id % 4 <> 0"))
def snapshot_with_satellite(t: Tables) -> DataFrame:
    own = t.snapshots()
    satellite = own.filter("event_id % 4 <> 0").select("pool", "t", "event_id", "va")
    return own.select("pool", "t", "event_id", F.col("tvl").cast("double").alias("tvl")).join(satellite, ["pool", "t", "event_id"], "left")


@query(_ranked_sql("24h", f"select pool, {_R} as r_org, bin_step, tier from (select i.pool, i.r_org, p.bin_step, p.tier from ind i join pools p on p.pool = i.pool where bucket = (select bucket from latest) order by r_org desc nulls last, i.pool limit 5)"))
def top_pools(t: Tables) -> DataFrame:
    """The pools of the latest day by what they earn over their losses."""
    rows = ranking.latest_bucket(indicators(t, "24h")).join(t.pools().select("pool", "bin_step", "tier"), "pool")
    return ranking.top(rows, "r_org", 5).select("pool", trading.significant_column("r_org"), "bin_step", "tier")


@query(_ranked_sql("24h", f"select pool, bucket, {_R} as r_org from ind where bucket = (select bucket from latest) and quality = 'A' and r_org >= 0.0"))
def potential_pools(t: Tables) -> DataFrame:
    """Measured pools in the latest day, best first."""
    rows = ranking.wanted(ranking.latest_bucket(indicators(t, "24h")), least=0.0)
    return rows.orderBy(F.desc_nulls_last("r_org"), "pool").select("pool", "bucket", trading.significant_column("r_org"))


@query(_ranked_sql("1h", f"select pool, bucket, {_R} as r_org from ind where quality = 'A' and r_org >= 1.0 and regime = 'V2'"))
def potential_history(t: Tables) -> DataFrame:
    """The same screen over all hours and one regime."""
    return ranking.wanted(indicators(t, "1h"), regime="V2").select("pool", "bucket", trading.significant_column("r_org"))


@query(_ranked_sql(
    "24h", f"select pool, bucket, token_x, token_y, tier, quality, volume, volume_change, {_R} as r_org from (select b.pool, b.bucket, p.token_x, p.token_y, p.tier, i.quality, b.volume, i.volume_change, i.r_org from b join pools p on p.pool = b.pool join ind i on i.pool = b.pool and i.bucket = b.bucket where b.bucket = (select max(bucket) from b) order by b.volume desc nulls last, b.pool limit 20)"))
def volume_ranked_pools(t: Tables) -> DataFrame:
    """Metrics, pools and indicators of the latest day, by volume."""
    out = enrich.volume_ranked(trading.scoring_bars(t, "24h").select("pool", "bucket", "volume"), t.pools(), indicators(t, "24h").select("pool", "bucket", "quality", "r_org", "volume_change"), 20)
    return out.select("pool", "bucket", "token_x", "token_y", "tier", "quality", "volume", "volume_change", trading.significant_column("r_org"))


_QUOTES = {"T0": "sol", "T1": "usdc", "T5": "usdt"}
_DIMS = "select *, case when pool_key % 3 <> 0 then 1700000000 + pool_key end as first_liquidity_at, 1690000000 + pool_key as created_at, {0} as qx, {1} as qy from pools"
_CASE = "case {0} " + " ".join(f"when '{m}' then '{n}'" for m, n in _QUOTES.items()) + " end"


@query(sql("select pool, coalesce(case when qy is not null or qx is null then qy else qx end, 'other') as quote_asset, case when qy is not null or qx is null then token_x else token_y end as base_token, round((1706659200 - coalesce(first_liquidity_at, created_at)) / 86400.0, 6)::double as age_days from d", "pools", d=_DIMS.format(_CASE.format("token_x"), _CASE.format("token_y"))))
def pool_sides(t: Tables) -> DataFrame:
    """Quote asset, base token and age of every pool."""
    k = F.col("pool_key")
    pools = t.pools().withColumns({"first_liquidity_at": F.when(k % 3 != 0, 1700000000 + k), "created_at": 1690000000 + k})
    return enrich.base_side(pools, _QUOTES, F.lit(1706659200)).select("pool", "quote_asset", "base_token", F.round("age_days", 6).alias("age_days"))


_RAW = "select pool, t, event_id, event_id % 2 = 0 as swap_for_y, user_id * 1000 + 17 as amount_in_raw, user_id * 900 + event_id % 100 as amount_out_raw, event_id % 80 - 40 as start_bin, event_id % 80 - 40 + event_id % 3 as end_bin, 20 + event_id % 30 as fee_bps, 2 as protocol_bps from e where event_type in ('click', 'purchase')"
_PRICES = "select 'T' || (event_id % 3) as mint, t, max(1 + v::double / 100) as usd from e where event_type = 'view' and event_id % 9 = 0 group by all"
_ENRICHED = {
    "raw": _RAW, "quotes": _PRICES,
    "x": """select r.*, p.bin_step, tx.decimals as dx, ty.decimals as dy, p.token_y from raw r join pools p on p.pool = r.pool left join tokens tx on tx.mint = p.token_x left join tokens ty on ty.mint = p.token_y""",
    "y": "select x.*, q.usd from x asof left join quotes q on q.mint = x.token_y and q.t <= x.t",
    "z": """select *, pow(1 + bin_step / 10000.0, start_bin) * pow(10.0, dx - dy) as start_price, pow(1 + bin_step / 10000.0, end_bin) * pow(10.0, dx - dy) as end_price,
      amount_in_raw / pow(10, case when swap_for_y then dx else dy end) as amount_in, amount_out_raw / pow(10, case when swap_for_y then dy else dx end) as amount_out from y""",
    "u": "select *, case when swap_for_y then amount_out else amount_in end * usd as volume_usd from z",
}


@query(sql("select event_id, pool, round(start_price + 1e-12, 9) as start_price, round(end_price + 1e-12, 9) as end_price, round(amount_in + 1e-12, 9) as amount_in, round(amount_out + 1e-12, 9) as amount_out, round(volume_usd + 1e-12, 9) as volume_usd, round(volume_usd * (fee_bps - protocol_bps) / 10000.0 + 1e-12, 9) as fee_usd, round(volume_usd * protocol_bps / 10000.0 + 1e-12, 9) as protocol_fee_usd from u", "e", "pools", "tokens", **_ENRICHED))
def enriched_swaps(t: Tables) -> DataFrame:
    """Raw swaps with prices of their bins, amounts in units, and volume and fees in USD at the quote's last price."""
    e, i = t.events(), F.col("event_id")
    raw = e.filter(F.col("event_type").isin("click", "purchase")).select(
        "pool", "t", "event_id", (i % 2 == 0).alias("swap_for_y"), (F.col("user_id") * 1000 + 17).alias("amount_in_raw"), (F.col("user_id") * 900 + i % 100).alias("amount_out_raw"),
        (i % 80 - 40).alias("start_bin"), (i % 80 - 40 + i % 3).alias("end_bin"), (20 + i % 30).alias("fee_bps"), F.lit(2).alias("protocol_bps"),
    )
    quotes = e.filter("event_type = 'view' and event_id % 9 = 0").groupBy(F.concat(F.lit("T"), (i % 3).cast("string")).alias("mint"), "t").agg(F.max(1 + F.col("v").cast("double") / 100).alias("usd"))
    out = enrich.enriched_swaps(raw, t.pools(), t.tokens(), quotes)
    return out.select("event_id", "pool", *[F.round(F.col(c) + 1e-12, 9).alias(c) for c in ("start_price", "end_price", "amount_in", "amount_out", "volume_usd", "fee_usd", "protocol_fee_usd")])


@query(_ranked_sql("24h", f"select pool, bucket, {_R} as r_org, score from (select pool, bucket, r_org, score from (select pool, bucket, r_org, bucket // 86400 * substr(pool, 2)::bigint % 7 as score from ind where bucket = (select bucket from latest) order by r_org desc nulls last, pool limit 10) order by score desc nulls last, r_org desc nulls last, pool limit 2)"))
def over_fetched_top(t: Tables) -> DataFrame:
    rows = ranking.latest_bucket(indicators(t, "24h")).withColumn("score", F.floor(F.col("bucket") / 86400) * F.substring("pool", 2, 9).cast("long") % 7)
    return ranking.over_fetched(rows, 2, "r_org", "score").select("pool", "bucket", trading.significant_column("r_org"), "score")


@query(sql("select p.pool, p.pool_key from pools p where tier = 0 and not exists (select 1 from sb join st on st.pool = sb.pool and st.bucket = sb.bucket where sb.pool = p.pool) order by pool_key desc limit 20", "swaps", "snapshots", "pools", sb=swap_bars_sql(600, traders=False), st=state_bars_sql(600)))
def never_measured(t: Tables) -> DataFrame:
    """Pools without a 10-minute indicator: those without a bar, as every bar is evaluated."""
    fresh = t.pools().filter("tier = 0").join(trading.scoring_bars(t, "10m").select("pool"), "pool", "left_anti")
    return fresh.orderBy(F.desc("pool_key")).limit(20).select("pool", "pool_key")


@query(sql(
    """, ranks as (select pool, row_number() over (order by r desc nulls last, pool) as rn from rk), fresh as (select pool from pools p where tier = 0 and pool not in (select pool from rk) order by pool_key desc, pool limit 2),
    promote as (select pool from ranks where rn <= 18 union select pool from fresh), safe as (select pool from ranks where rn <= 23 union select pool from fresh union select pool from positions where not closed and position_id % 7 = 0)
    select pool, 'promote' as change from promote where pool not in (select pool from pools where tier = 1)
    union all select pool, 'demote' from pools where tier = 1 and pool not in (select pool from safe)""".replace(", ranks", "select * from (with ranks", 1) + ")",
    "trades", "pools", "positions", rk="select pool, sum(volume_usd) as r from trades where cast(substr(pool, 2) as integer) % 4 <> 0 group by pool"))
def tier_changes(t: Tables) -> DataFrame:
    """Promotions and demotions where a quarter of the pools is unmeasured, 20 pools are watched, two slots of them for exploration."""
    ranked = t.trades().filter("cast(substr(pool, 2) as int) % 4 <> 0").groupBy("pool").agg(F.sum("volume_usd").alias("r_org"))
    pools = t.pools().withColumn("age_key", F.col("pool_key"))
    return ranking.tier_changes(ranked, pools, ranked, t.positions().filter("not closed and position_id % 7 = 0"), cap=20, exploration=0.1, margin=5)


@query(sql(
    "select * from (select pool, '1h' as tf, arg_max(close::double, bucket) as c from c1h group by pool union all select pool, '4h', arg_max(close::double, bucket) from c4h group by pool union all select pool, '24h', arg_max(close::double, bucket) from c24h group by pool) pivot (first(c) for tf in ('1h', '4h', '24h'))"
    .replace("arg_max(close::double, bucket)", "last(close::double order by bucket)"), *_TRIO, **chain_ctes("24h")))
def pool_detail(t: Tables) -> DataFrame:
    base = written(rollup.bars(t.swaps(), t.snapshots(), t.liquidity(), 600), "bars_10m")
    every = rollup.frames(base)
    return ranking.pool_detail({tf: every[tf].select("pool", "bucket", F.col("close").cast("double").alias("close")) for tf in ("1h", "4h", "24h")}, "close")


_DETAIL = ("bucket", "volume", "buy_volume", "sell_volume", "swap_count", "unique_traders", "open", "high", "low", "close", "tvl_close", "active_tvl_close", "active_bin_close", "net_deposit", "add_count", "remove_count")
_EXACT = ("volume", "buy_volume", "sell_volume", "open", "high", "low", "close", "tvl_close", "active_tvl_close", "net_deposit")
_FRAMES = {"5m": "bars300", "10m": "bars600", "1h": "c1h", "4h": "c4h", "24h": "c24h"}
_DETAIL_SQL = ", ".join(f"l{tf}.{c}{'::double' if c in _EXACT else ''} as {c}_{tf}" for tf in _FRAMES for c in _DETAIL)
_DETAIL_JOINS = " ".join(f"left join (select * from {name} qualify row_number() over (partition by pool order by bucket desc) = 1) l{tf} on l{tf}.pool = p.pool" for tf, name in _FRAMES.items())


@query(sql(f"select p.pool, p.token_x, p.token_y, p.tier, p.bin_step, p.base_factor, p.blacklisted, {_DETAIL_SQL} from pools p {_DETAIL_JOINS}", *_TRIO, "pools", **bars_ctes(300), **chain_ctes("24h")))
def whole_pool_detail(t: Tables) -> DataFrame:
    """Every pool's summary with all columns of its latest bar of five timeframes."""
    raw = t.swaps(), t.snapshots(), t.liquidity()
    every = {"5m": rollup.bars(*raw, 300), **rollup.frames(written(rollup.bars(*raw, 600), "bars_10m"))}
    shown = [F.col(c).cast("double").alias(c) if c in _EXACT else F.col(c) for c in _DETAIL]
    summary = t.pools().select("pool", "token_x", "token_y", "tier", "bin_step", "base_factor", "blacklisted")
    return ranking.whole_pool_detail(summary, {tf: every[tf].select("pool", *shown) for tf in _FRAMES}, _DETAIL)


@query(sql("select s.pool, s.t, s.event_id as point_id, h.price::double as price, h.t as seen from snapshots s asof left join (select pool, t, max_by(price, event_id) as price from swaps group by pool, t) h on h.pool = s.pool and h.t <= s.t", *_TRIO[:2]))
def price_as_of(t: Tables) -> DataFrame:
    """The last swap price at or before each snapshot."""
    history = t.swaps().groupBy("pool", "t").agg(F.max_by("price", "event_id").cast("double").alias("price"))
    return ranking.as_of(t.snapshots().select("pool", "t", F.col("event_id").alias("point_id")), history, "price")


_BINS = {"bins": "select pool, (event_id % 90)::integer as bin_id, count(*) as n, sum(v) as amount from e group by pool, event_id % 90"}


@query(sql("select position_id, count(*) as bins, sum(amount)::double as amount from positions p join bins b on b.pool = p.pool and b.bin_id between p.lower_bin and p.upper_bin group by position_id", "positions", "e", **_BINS))
def pending_fees(t: Tables) -> DataFrame:
    """What a position's bins hold: an interval join by blocks of bins, then a sum."""
    bins = t.events().groupBy("pool", (F.col("event_id") % 90).cast("int").alias("bin_id")).agg(F.sum("v").alias("amount"))
    met = ranking.bins_in_range(t.positions(), bins)
    return met.groupBy("position_id").agg(F.count("*").alias("bins"), F.sum("amount").cast("double").alias("amount"))


@query(sql("select l.pool, latest, observed, observed - latest as gap from (select pool, max(t) as latest from snapshots group by pool) l join (select pool, max(t) as observed from (select pool, t from swaps union all select pool, t from liquidity union all select pool, t from snapshots where event_id % 2 = 0) group by pool) o on o.pool = l.pool where latest < observed", *_TRIO))
def stale_state(t: Tables) -> DataFrame:
    """Pools whose last state is older than their last event."""
    latest = latest_per_key(t.snapshots().select("pool", "t", "event_id"), ["pool"], ["t", "event_id"]).select("pool", F.col("t").alias("latest"))
    events = t.swaps().select("pool", "t").unionByName(t.liquidity().select("pool", "t")).unionByName(t.snapshots().filter("event_id % 2 = 0").select("pool", "t"))
    observed = events.groupBy("pool").agg(F.max("t").alias("observed"))
    out = latest.join(observed, "pool").filter("latest < observed").withColumn("gap", F.col("observed") - F.col("latest"))
    return out.orderBy(F.desc("gap"), "pool")


_FOUND = {
    "d": "select distinct pool from trades where order_key % 11 < 3", "k": "select pool from pools where pool_key % 3 <> 0", "mt": "select distinct pool from swaps",
    "s": "select coalesce(d.pool, k.pool) as pool, case when k.pool is null then 'new' when d.pool is null then 'missing' else 'known' end as status, k.pool is not null as is_known from d full join k on k.pool = d.pool",
}


@query(sql("select pool, status, case when status = 'new' then case when row_number() over (partition by status order by pool) <= 3 then 'onboard' else 'wait' end when is_known and pool in (select pool from mt) then 'refresh' end as action from s", "trades", "pools", "swaps", **_FOUND))
def discovery_diff(t: Tables) -> DataFrame:
    """Discovered against known pools, three onboarded a sweep; those with swaps have flow metrics."""
    return ranking.discovered(t.trades().filter("order_key % 11 < 3"), t.pools().filter("pool_key % 3 <> 0"), t.swaps(), 3)


@query(sql("select e.event_id, coalesce(b.block_time, 0) as block_time from e left join (select t // 7 as slot, min(t) as block_time from e where event_id % 2 = 0 group by 1) b on b.slot = e.t // 7", "e"))
def slot_times(t: Tables) -> DataFrame:
    """The block time of each event's slot; 0 where none is known."""
    e = t.events().withColumn("slot", F.floor(F.col("t") / 7))
    times = e.filter("event_id % 2 = 0").groupBy("slot").agg(F.min("t").alias("block_time"))
    return e.join(times, "slot", "left").select("event_id", F.coalesce("block_time", F.lit(0).cast("long")).alias("block_time"))


@query(sql("select pool, rank_short, rank_long, rank_long - rank_short as shift from (select pool, rank() over (order by volume desc nulls last) as rank_short from c1h where bucket = (select max(bucket) from c1h)) join (select pool, rank() over (order by volume desc nulls last) as rank_long from c24h where bucket = (select max(bucket) from c24h)) using (pool)", *_TRIO, **chain_ctes("24h")))
def rank_shift(t: Tables) -> DataFrame:
    every = rollup.frames(written(rollup.bars(t.swaps(), t.snapshots(), t.liquidity(), 600), "bars_10m"))
    return ranking.rank_shift(ranking.latest_bucket(every["1h"]), ranking.latest_bucket(every["24h"]), "volume")


_PARAMS = {"params": "select pool, bin_step, base_factor from pools where pool_key % 11 <> 0"}


@query(sql("select p.pool, p.tier, p.token_x, p.token_y, params.bin_step, params.base_factor from pools p join params on params.pool = p.pool where p.tier = 1 and p.pool in (select pool from trades)", "pools", "trades", **_PARAMS))
def watch_set(t: Tables) -> DataFrame:
    """Watched pools that trade, with their parameters; pools without parameters are left out."""
    watched = t.pools().filter("tier = 1").join(t.trades().select("pool"), "pool", "left_semi").select("pool", "tier", "token_x", "token_y")
    return ranking.with_params(watched, t.pools().filter("pool_key % 11 <> 0").select("pool", "bin_step", "base_factor"))


@query(sql("select position_id, x.pool, lower_bin, upper_bin, params.bin_step, params.base_factor from positions x join params on params.pool = x.pool where not closed", "positions", "pools", **_PARAMS))
def open_position_params(t: Tables) -> DataFrame:
    """Open positions with the parameters of their pools."""
    held = t.positions().filter("not closed").select("position_id", "pool", "lower_bin", "upper_bin")
    return ranking.with_params(held, t.pools().filter("pool_key % 11 <> 0").select("pool", "bin_step", "base_factor"))


@query(sql(
    """select s.event_id as point_id, s.pool, s.t, g.signal_id, g.kind, g.t as seen, case when g.signal_id is null then null when g.signal_id % 4 = 0 then '' else array_to_string(list_transform(range(g.signal_id % 3 + 1), lambda i: 'c' || i || '=' || ((g.signal_id + i) % 100)), ';') end as conditions
    from snapshots s asof left join (select pool, t, max(event_id) as signal_id, max_by(event_type, event_id) as kind from e where event_type in ('click', 'purchase') and event_id % 5 = 0 group by pool, t) g on g.pool = s.pool and g.t <= s.t""", "snapshots"))  # fmt: skip
def latest_rationale(t: Tables) -> DataFrame:
    """The last signal at or before each snapshot, with its conditions as text; every fourth signal has none."""
    signals = t.events().filter("event_type in ('click', 'purchase') and event_id % 5 = 0").select("pool", "t", F.col("event_id").alias("signal_id"), F.col("event_type").alias("kind"))
    own = signals.filter("signal_id % 4 <> 0").select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("signal_id") % 3)).alias("seq"))
    items = own.select("signal_id", "seq", F.concat(F.lit("c"), F.col("seq").cast("string")).alias("signal"), ((F.col("signal_id") + F.col("seq")) % 100).alias("observed"))
    out = ranking.explained(t.snapshots().select("pool", "t", F.col("event_id").alias("point_id")), signals, items)
    text = F.array_join(F.transform("conditions", lambda x: F.concat(x["signal"], F.lit("="), x["observed"].cast("string"))), ";")
    return out.select("point_id", "pool", "t", "signal_id", "kind", "seen", text.alias("conditions"))


@query(sql("select position_id, horizon from positions, (values (24), (72)) h(horizon) where not exists (select 1 from done d where d.position_id = positions.position_id and d.horizon = h.horizon) and 1704067200 + (position_id % 20) * 86400 <= 1705500000 - horizon * 3600", "positions", done="select position_id, 24 as horizon from positions where closed"))
def due_for_outcome(t: Tables) -> DataFrame:
    """Positions old enough for a horizon whose outcome isn't there yet."""
    p = t.positions()
    done = p.filter("closed").select("position_id", F.lit(24).alias("horizon"))
    asked = p.select("position_id", F.explode(F.array(F.lit(24), F.lit(72))).alias("horizon"))
    opened = F.lit(1704067200) + (F.col("position_id") % 20) * 86400
    asked = asked.filter(opened <= 1705500000 - F.col("horizon") * 3600)
    return asked.join(done, ["position_id", "horizon"], "left_anti")


@query(sql("select x.position_id, x.wallet, t1.symbol as symbol_x, t2.symbol as symbol_y from positions x left join pools p on p.pool = x.pool left join tokens t1 on t1.mint = p.token_x left join tokens t2 on t2.mint = p.token_y where x.wallet in (select c_custkey from customer where c_custkey < 25)", "positions", "pools", "tokens"))
def position_pairs(t: Tables) -> DataFrame:
    """Positions of registered wallets with the symbols of their pools' tokens."""
    registered = t.raw("customer").filter("c_custkey < 25").select(F.col("c_custkey").alias("wallet"))
    owned = t.positions().join(registered, "wallet", "left_semi")
    pairs = ranking.scoring_universe(t.pools(), t.tokens()).select("pool", "symbol_x", "symbol_y")
    return owned.join(pairs, "pool", "left").select("position_id", "wallet", "symbol_x", "symbol_y")


@query(sql("select pool from pools where tier = 1 intersect select distinct pool from trades where volume_usd >= 90000", "pools", "trades"))
def known_and_requested(t: Tables) -> DataFrame:
    return t.pools().filter("tier = 1").select("pool").intersect(t.trades().filter("volume_usd >= 90000").select("pool"))


@query(sql("select flow_id, position_id, amount::double as amount, place from (select *, row_number() over (partition by position_id order by t desc, flow_id desc) as place from cash_flows) where place <= 3", "cash_flows"))
def newest_flows(t: Tables) -> DataFrame:
    """The three newest cash flows of every position, in order."""
    place = F.row_number().over(W.partitionBy("position_id").orderBy(F.desc("t"), F.desc("flow_id"))).cast("long")
    return t.cash_flows().withColumn("place", place).filter("place <= 3").select("flow_id", "position_id", F.col("amount").cast("double").alias("amount"), "place")
