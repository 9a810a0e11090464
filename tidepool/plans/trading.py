"""Queries of the indicator pipeline, paper positions, the ledger and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import scalar
from tidepool.functions.checks import as_text
from tidepool.operators import incremental, ledger, mixture, ops, pipeline, ranking, rollup, windows
from tidepool.plans.registry import query
from tidepool.plans.rollup import chain_ctes, state_bars_sql
from tidepool.plans.scoring_sql import SCREENED, fit_sql, scored_sql, significant
from tidepool.plans.windows import HOURLY, hourly
from tidepool.schemas import TIMEFRAMES, bars_a_day
from tidepool.session import written
from tidepool.sources.adapters import Tables, exact_price_ctes, sql

CFG = pipeline.Config()


def _before(rows: DataFrame) -> DataFrame:
    """Daily figures (pool, bucket) as those of the day after, so that a bar only sees days that are over."""
    return rows.withColumn("day", F.col("bucket") + 86400).drop("bucket")


def scoring_bars(t: Tables, tf: str) -> DataFrame:
    """The bars that are scored, as doubles in the pools' usual magnitudes."""
    width = TIMEFRAMES[tf]
    state = rollup.state_bars(t.snapshots(), width)
    state = state.select("pool", "bucket", (F.col("tvl_close").cast("double") * 100).alias("tvl"), (F.col("active_tvl_close").cast("double") * 10).alias("active_tvl"), F.col("active_bin_close").alias("active_bin"))
    flows = rollup.swap_bars(t.swaps(), width, traders=False).select("pool", "bucket", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], (F.col("volume").cast("double") * 10_000).alias("volume"), (F.col("fee_milli").cast("double") * 10).alias("fee"), F.col("swap_count").alias("trades"))
    return flows.join(state, ["pool", "bucket"])


def described(t: Tables, rows: DataFrame) -> DataFrame:
    """Bars with what the stages need to know of their pools: every second pool is measured, every third is a major
    token's; wash screens and the mixture fit are those of the day before. A day of few signers says nothing of wash
    trading and gives no screen."""
    dims = t.pools().select("pool", "pool_key", "bin_step", "base_factor", "base_power", "vfc", "tier", "blacklisted")
    rows = rows.join(ranking.small(dims, dims.count()), "pool")
    sizes = t.swaps().select("pool", (F.col("t") - F.col("t") % 86400).alias("bucket"), F.col("volume_usd").cast("double").alias("size"))
    wash = _before(rollup.trader_concentration(t.swaps(), 86400).filter(F.col("signers") >= SCREENED).drop("signers"))
    organic = _before(mixture.organic_share(sizes, ("pool", "bucket")).drop("trades"))
    rows = rows.withColumn("day", F.col("bucket") - F.col("bucket") % 86400).join(wash, ["pool", "day"], "left").join(organic, ["pool", "day"], "left").drop("day")
    return rows.withColumns({
        "dev_peg": F.when(F.col("pool_key") % 4 == 0, F.abs(F.col("close") - 1) / 1000), "age_days": F.col("history_days") + F.when(F.col("pool_key") % 3 == 0, 60).otherwise(25), "pegged": F.col("pool_key") % 4 == 0,
        "major": F.col("pool_key") % 3 == 0, "kill": F.lit(False), "quality": F.when(F.col("tier") == 1, "A").otherwise("B"), "active_liquidity": F.col("active_tvl"), "protocol_share": F.lit(0.1), "disabled": F.col("blacklisted").cast("double"),
    })


def evaluated_bars(t: Tables, tf: str, bars: DataFrame, states: DataFrame, since: int | None) -> DataFrame:
    """The pipeline over the bars after `since`, from the states before."""
    described_ = lambda rows: written(described(t, rows), f"rows_{tf}")
    return incremental.evaluated(bars, states, described_, CFG, bars_a_day(tf), TIMEFRAMES[tf], since, correlated=tf == "5m")


def evaluated(t: Tables, tf: str = "1h") -> DataFrame:
    """The pipeline over all bars of one timeframe, as one run from no state. The bars are written once, as every stage
    reads them."""
    return evaluated_bars(t, tf, written(scoring_bars(t, tf), f"bars_{tf}"), incremental.no_states(t.spark), None)


_INDICATORS = ("sigma_gk", "sigma_fast", "sigma_slow", "sigma_d", "phi_mech", "phi_org", "f_hat", "tau_a", "r_gross", "r_org", "y_fee", "vol_tvl", "fee_tvl", "fee_active_tvl", "ranking_key", "v_star")


def significant_column(name: str, digits: int = 6) -> Column:
    """Digits after the first one."""
    x = F.col(name)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).when(x.isNotNull(), F.round(x / power, digits) * power).alias(name)


def _indicators(t: Tables, tf: str) -> DataFrame:
    return evaluated(t, tf).select("pool", "bucket", "quality", "regime", "gated", "attractive", *[significant_column(c) for c in _INDICATORS])


def _indicators_sql(tf: str) -> str:
    return scored_sql(CFG, tf, f"select pool, bucket, quality, regime, gated, attractive, {', '.join(f'{significant(c)} as {c}' for c in _INDICATORS)} from scored")


@query(_indicators_sql("5m"))
def indicators_5m(t: Tables) -> DataFrame:
    """Indicators of every pool and five minutes, the daily volatility corrected for autocorrelation."""
    return _indicators(t, "5m")


@query(_indicators_sql("10m"))
def indicators_10m(t: Tables) -> DataFrame:
    return _indicators(t, "10m")


@query(_indicators_sql("1h"))
def indicators_1h(t: Tables) -> DataFrame:
    """Indicators of every pool and hour."""
    return _indicators(t, "1h")


@query(_indicators_sql("4h"))
def indicators_4h(t: Tables) -> DataFrame:
    return _indicators(t, "4h")


@query(_indicators_sql("24h"))
def indicators_24h(t: Tables) -> DataFrame:
    return _indicators(t, "24h")


@query()
def rationale_1h(t: Tables) -> DataFrame:
    """Every check of every pool and hour, in order."""
    return pipeline.rationale_rows(evaluated(t)).withColumn("observed", F.round("observed", 9))


def _signals(t: Tables, tf: str, cooldown: int = 3600) -> DataFrame:
    """Signals that pass the cooldown, with their rationale as text. Volume decay is not judged again here: it counts
    as 1."""
    rows = pipeline.exits(evaluated(t, tf).withColumn("volume_trend", F.lit(1.0)), CFG)
    rows = written(rows.select("pool", "bucket", "quality", "regime", "r_org", "exit", F.transform(F.concat("rationale", "exit_items"), as_text).alias("why")), f"signals_{tf}")
    due = windows.cooled(pipeline.signals(rows, CFG).select("pool", "bucket", "kind", F.col("bucket").alias("t"), F.lit(0).alias("event_id")), ["pool", "kind"], cooldown)
    return due.select("pool", "bucket", "kind").join(rows, ["pool", "bucket"]).select("pool", "bucket", "kind", "regime", F.round("r_org", 9).alias("r_org"), "why")


@query()
def signals_1h(t: Tables) -> DataFrame:
    """Hourly signals."""
    return _signals(t, "1h")


@query()
def signals_5m(t: Tables) -> DataFrame:
    """Signals of five-minute bars, of which the cooldown lets one an hour and kind through."""
    return _signals(t, "5m")


_POOLS_F = "select pool, pool_key, bin_step / 10000.0 as s, base_factor::bigint * bin_step * 10 * case base_power when 1 then 10 else 1 end as base, 0.01 + (pool_key % 30) / 1000.0 as sd, 10000 + reserve::double * 10 as l, 50000 + pool_key * 1000.0 as vol from pools"


@query(sql(
    """select pool, round(greatest(0, least(1, 1 - pow(sd / s, 2) * l * 0.5 / vol)), 9) as phi_mech, round(coalesce(2 * (base / 1e9) * (vol / l) * s * 0.9 / (sd * sd), 0), 9) as r_gross,
      round(0.9 * (base / 1e9) * (vol / l) * 0.85, 9) as y_fee, greatest(ceil(1.5 * sd * sqrt(0.5) / s), 10)::bigint as bins, round(l * (sqrt(0.9 * (base / 1e9) * (vol / l) / (0.2 / 365)) - 1), 4) as m_dilution,
      round((0.001 - 0.0002) / pow(0.5 * 1.3 * sd, 2) / 4, 9) as quarter_kelly, round(sd * sd * 1000 / (2 * s), 9) as lvr, round(sd * sqrt(600 / 86400.0) * 10000, 6) as sigma_bps from x""", "pools", x=_POOLS_F))  # fmt: skip
def ranking_formulas(t: Tables) -> DataFrame:
    """The closed formulas on the pool dimension."""
    k = F.col("pool_key")
    rows = t.pools().select("pool", (F.col("bin_step") / 10000.0).alias("s"), scalar.base_fee_rate(F.col("base_factor"), F.col("bin_step"), F.col("base_power")).cast("double").alias("base"), (0.01 + (k % 30) / 1000.0).alias("sd"), (10000 + F.col("reserve").cast("double") * 10).alias("l"), (50000 + k * 1000.0).alias("vol"))
    s, sd, l, vol, fee = F.col("s"), F.col("sd"), F.col("l"), F.col("vol"), F.col("base") / 1e9  # noqa: E741
    share, turnover = F.lit(0.1), F.col("vol") / F.col("l")
    return rows.select(
        "pool", F.round(scalar.phi_mechanical(sd, s, l, F.lit(0.5), vol), 9).alias("phi_mech"), F.round(scalar.r_ratio(fee, turnover, s, share, sd), 9).alias("r_gross"), F.round(scalar.fee_yield(share, fee, turnover, F.lit(0.15)), 9).alias("y_fee"),
        scalar.range_bins(scalar.range_width(sd, F.lit(0.5)), s).alias("bins"), F.round(scalar.self_dilution_cap(l, share, fee, turnover, 0.2), 4).alias("m_dilution"), F.round(scalar.quarter_kelly(F.lit(0.001), F.lit(0.0002), sd), 9).alias("quarter_kelly"),
        F.round(scalar.lvr(sd, F.lit(1000.0), s), 9).alias("lvr"), F.round(scalar.decay_window_bps(sd, 600), 6).alias("sigma_bps"),
    )


@query(fit_sql("select pool, 0 as bucket, volume_usd from trades", "select pool, round(case when small >= large * (1 - {alike}) then share else 1 - share end, 6) as phi_size, trades from (select pool, count(*) as trades from trades group by pool) left join (select * from fit where k = {rounds}) using (pool)", "trades"))
def organic_share(t: Tables) -> DataFrame:
    """The mixture fit of each pool's trade sizes."""
    out = mixture.organic_share(t.trades().select("pool", F.col("volume_usd").cast("double").alias("size")))
    return out.select("pool", F.round("phi_size", 6).alias("phi_size"), "trades")


_POSITIONS = "select c_custkey as position_id, 'P' || (c_custkey % 100) as pool, 1704067200 + (c_custkey % 20) * 86400 as opened_at, case when c_custkey % 5 = 0 then 1704067200 + (c_custkey % 20 + 3) * 86400 end as closed_at, c_custkey % 40 as lower_bin, c_custkey % 40 + 30 as upper_bin, 100 as bin_step, 1000.0::double as size, 200.0::double as size_per_bin, 1.5::double as entry_price from customer"
_MARK_CTES = {
    "sp": _POSITIONS, **HOURLY, "st": state_bars_sql(3600),
    "b": "select h.pool, h.bucket, h.close, h.fee, st.active_bin_close as active_bin, st.active_tvl_close::double as liquidity from h join st on st.pool = h.pool and st.bucket = h.bucket",
    "m0": """select position_id, sp.pool, opened_at, bucket as t, size, active_bin between lower_bin and upper_bin as in_range,
      case when active_bin between lower_bin and upper_bin and fee > 0 then fee * size_per_bin / (size_per_bin + liquidity) else 0 end as fees,
      size * pow(greatest(-(upper_bin - lower_bin) * 0.01 / 2, least((upper_bin - lower_bin) * 0.01 / 2, (close - entry_price) / entry_price)), 2) / (2 * (upper_bin - lower_bin) * 0.01) as loss
      from sp join b on b.pool = sp.pool and bucket >= opened_at and (closed_at is null or bucket < closed_at)""",
    "m": "select *, size + sum(fees) over (partition by position_id order by t rows unbounded preceding) - loss as value from m0",
}


def _marks(t: Tables) -> DataFrame:
    k = F.col("position_id")
    own = t.positions().select(
        "position_id", "pool", (F.lit(1704067200) + (k % 20) * 86400).alias("opened_at"), F.when(F.col("closed"), F.lit(1704067200) + (k % 20 + 3) * 86400).alias("closed_at"), (k % 40).alias("lower_bin"), (k % 40 + 30).alias("upper_bin"), F.lit(100).alias("bin_step"),
        F.lit(1000.0).alias("size"), F.lit(200.0).alias("size_per_bin"), F.lit(1.5).alias("entry_price"),
    )
    state = rollup.state_bars(t.snapshots(), 3600).select("pool", "bucket", F.col("active_bin_close").alias("active_bin"), F.col("active_tvl_close").cast("double").alias("liquidity"))
    return ledger.marks(own, hourly(t).select("pool", "bucket", "close", "fee").join(state, ["pool", "bucket"]))


@query(sql("select position_id, t, in_range, round(fees, 6) as fees, round(loss, 6) as loss, round(value, 6) as value from m", "swaps", "snapshots", **_MARK_CTES))
def position_marks(t: Tables) -> DataFrame:
    return _marks(t).select("position_id", "t", "in_range", *[F.round(c, 6).alias(c) for c in ("fees", "loss", "value")])


def _outcomes(t: Tables) -> DataFrame:
    """Outcomes of positions, of which every tenth has no predicted ratio."""
    k = F.col("position_id")
    return ledger.outcomes(_marks(t), t.positions().select("position_id", F.lit(0.001).alias("y_fee"), F.when(k % 10 != 0, 1.25 + k % 7).alias("r_org")))


_OUTCOMES = {
    **_MARK_CTES,
    "oc": """select position_id, horizon, max(opened_at) + horizon * 3600 as finalized_at, sum(fees) as fees_real, last(loss order by t) as loss, avg(in_range::integer) as time_in_range from m, (values (24), (72)) hz(horizon) where t <= opened_at + horizon * 3600 group by position_id, horizon""",
}


@query(sql("select position_id, horizon::integer as horizon, round(fees_real, 6) as fees_real, round(0.001 * 1000 * horizon / 24.0, 6)::double as fees_predicted, round(loss, 6) as loss, round(case when abs(loss) > 1e-9 then fees_real / loss end, 5) as r_real, round(time_in_range, 6) as time_in_range, case when abs(loss) > 1e-9 then fees_real / loss >= 1 end as hit from oc", "swaps", "snapshots", **_OUTCOMES))
def position_outcomes(t: Tables) -> DataFrame:
    out = _outcomes(t)
    return out.select("position_id", "horizon", "hit", *[F.round(c, 5 if c == "r_real" else 6).alias(c) for c in ("fees_real", "fees_predicted", "loss", "r_real", "time_in_range")])


@query(sql("select horizon::integer as horizon, count(*) as outcomes, count(*) filter (coalesce(fees_real / loss >= 1, false) and abs(loss) > 1e-9) as hits, round(avg(case when abs(loss) > 1e-9 and fees_real / loss >= 1 then 1.0 else 0.0 end), 6)::double as hit_rate, round(avg(case when position_id % 10 <> 0 then 1.25 + position_id % 7 end), 6)::double as r_predicted, round(avg(time_in_range), 6) as time_in_range from oc where finalized_at >= 1704240000 and finalized_at < 1705536000 group by horizon", "swaps", "snapshots", **_OUTCOMES))
def outcome_scorecard(t: Tables) -> DataFrame:
    """The scorecard of outcomes that were final within fifteen days."""
    out = ledger.scorecard(_outcomes(t), since=1704240000, until=1705536000)
    return out.select("horizon", "outcomes", "hits", *[F.round(c, 6).alias(c) for c in ("hit_rate", "r_predicted", "time_in_range")])


_SUMS = "select position_id, coalesce(sum(amount) filter (kind = 0), 0)::double as deposited, coalesce(sum(amount) filter (kind = 1), 0)::double as withdrawn, coalesce(sum(amount) filter (kind = 2), 0)::double as claimed from cash_flows group by position_id"


@query(sql("select s.position_id, deposited, withdrawn, claimed, round(value::double + withdrawn + claimed - deposited, 2) as profit from s left join (select position_id as vp, value from positions where position_id % 3 <> 0) v on v.vp = s.position_id", "cash_flows", "positions", s=_SUMS))
def position_profits(t: Tables) -> DataFrame:
    out = ledger.profits(t.cash_flows(), t.positions().filter("position_id % 3 <> 0").select("position_id", "value"))
    return out.select("position_id", *[F.col(c).cast("double").alias(c) for c in ("deposited", "withdrawn", "claimed")], F.round(F.col("profit").cast("double"), 2).alias("profit"))


@query(sql(
    """select p.position_id, s.t, s.price::double as price, s.bin between p.lower_bin and p.upper_bin as in_range, cast(coalesce((select sum(amount) from cash_flows c where c.kind = 0 and c.position_id = p.position_id and c.t <= s.t), 0)::decimal(18,2) * s.price as decimal(18,6))::double as hold_value
    from positions p join (select pool, t, min(event_id % 90)::integer as bin, min(price) as price from swaps group by pool, t) s on s.pool = p.pool""", "positions", "swaps", "cash_flows"))  # fmt: skip
def position_valuations(t: Tables) -> DataFrame:
    prices = t.swaps().groupBy("pool", "t").agg(F.min(F.col("event_id") % 90).cast("int").alias("bin_id"), F.min("price").alias("price"))
    out = ledger.valuations(t.positions(), t.cash_flows().filter("kind = 0"), prices)
    return out.select("position_id", "t", F.col("price").cast("double").alias("price"), "in_range", F.col("hold_value").cast("decimal(18,6)").cast("double").alias("hold_value"))


@query(sql("select user_id as intent, case when bool_or(s = 2) then 2 else last(s order by t, event_id) end::integer as status, min(t) as created_at, min(t) filter (s = 2) as confirmed_at from (select *, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then case when event_id % 40 = 0 then 2 else 1 end when 'error' then 3 else 4 end as s from e) group by user_id", "e"))
def intent_states(t: Tables) -> DataFrame:
    """Intents folded from their events; a confirmation is final."""
    kind = F.col("event_type")
    status = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", F.when(F.col("event_id") % 40 == 0, 2).otherwise(1)).when(kind == "error", 3).otherwise(4)
    return ledger.intents(t.events().select(F.col("user_id").alias("intent"), "t", F.col("event_id").alias("seq"), status.cast("int").alias("status")))


_CONFIRMED = {
    "cf": "select event_id // 2 as intent, t, event_id as seq, (['open', 'add', 'remove', 'claim', 'close', 'swap'])[event_id // 2 % 6 + 1] as action, user_id as position_id, v as amount, case when event_id % 4 = 0 then 'r' || (event_id % 3) end as reason from e",
    "c1": "select * from cf qualify row_number() over (partition by intent order by t, seq) = 1",
}


def _confirmed(t: Tables) -> DataFrame:
    """Confirmations of intents, two of each."""
    i, n = F.col("event_id"), F.floor(F.col("event_id") / 2)
    action = F.element_at(F.array(*[F.lit(a) for a in ("open", "add", "remove", "claim", "close", "swap")]), (n % 6 + 1).cast("int"))
    return t.events().select(n.alias("intent"), "t", i.alias("seq"), action.alias("action"), F.col("user_id").alias("position_id"), F.col("v").alias("amount"), F.when(i % 4 == 0, F.concat(F.lit("r"), (i % 3).cast("string"))).alias("reason"))


@query(sql("select intent, position_id, case action when 'open' then 0 when 'add' then 0 when 'remove' then 1 when 'close' then 1 when 'claim' then 2 end::integer as kind, t, amount::double as amount from c1", "e", **_CONFIRMED))
def intent_flows(t: Tables) -> DataFrame:
    """One cash flow for each confirmed intent, however often it was confirmed."""
    return ledger.intent_flows(_confirmed(t)).withColumn("amount", F.col("amount").cast("double"))


@query(sql("select position_id, first(intent order by t, seq, intent) filter (action = 'open') as opened_by, min(t) filter (action = 'open') as opened_at, min(t) filter (action = 'close') as closed_at, first(reason order by t, seq, intent) filter (action = 'close' and reason is not null) as reason from c1 where action in ('open', 'close') group by position_id having count(*) filter (action = 'open') > 0", "e", **_CONFIRMED))
def intent_positions(t: Tables) -> DataFrame:
    """Positions that confirmed intents opened and closed."""
    return ledger.intent_positions(_confirmed(t))


_REGISTRY = {
    "k": "select position_id as kw, position_id + 50 as known, position_id % 2 = 0 as revoked from positions where position_id < 20",
    "r": "select user_id % 50 as wallet, user_id as owner, t, known, revoked from e left join k on kw = user_id % 50 where event_type = 'signup'",
    "f": "select wallet as fw, first(t order by t, owner) as ft, first(owner order by t, owner) as fo from r where known is null or owner = known group by wallet",
}


@query(sql("select wallet, owner, t, case when known is null and t = ft and owner = fo then 'registered' when revoked and t = ft and owner = fo then 'restored' when owner = coalesce(known, fo) then 'relabelled' else 'refused' end as outcome from r left join f on fw = wallet", "e", "positions", **_REGISTRY))
def wallet_registrations(t: Tables) -> DataFrame:
    """Registrations against twenty known wallets, of which every second was revoked."""
    asked = t.events().filter("event_type = 'signup'").select((F.col("user_id") % 50).alias("wallet"), F.col("user_id").alias("owner"), "t")
    known = t.positions().filter("position_id < 20").select(F.col("position_id").alias("wallet"), (F.col("position_id") + 50).alias("owner"), (F.col("position_id") % 2 == 0).alias("revoked"))
    return ledger.registrations(asked, known)


_PROPOSED = "select pool, bin_step, case when pool_key % 23 <> 0 then pool_key * 97 % 9000 - 4500 end as active, case when pool_key % 19 <> 0 then pool_key % 75 end as width, 0.01 + pool_key % 40 / 1000.0 as sd from pools"


@query(sql(
    """select pool, refusal, case when refusal is null then lo end as lower_bin, case when refusal is null then lo + width - 1 end as upper_bin, round(case when refusal is null then ln(low_price) end, 6) as log_lower, round(case when refusal is null then ln(high_price) end, 6) as log_upper,
      round(pow(width * bin_step / 20000.0, 2) / (sd * sd), 6) as exit_days, round(pow(0.8 * width * bin_step / 20000.0, 2) / (sd * sd), 6) as trigger_days
    from (select *, case when width is null or width not between 1 and 70 then 'width' when active is null then 'active' when abs(lo * ln(1 + bin_step / 10000.0)) > 35 or abs((lo + width - 1) * ln(1 + bin_step / 10000.0)) > 35 then 'range' end as refusal from lows) left join (select pool, price as low_price from low) using (pool) left join (select pool, price as high_price from high) using (pool)""", "pools", pr=_PROPOSED, lows="select *, active - (width - 1) // 2 as lo from pr",
    **exact_price_ctes("low", "select pool, lo as bin_id, bin_step from lows where lo is not null", 13), **exact_price_ctes("high", "select pool, lo + width - 1 as bin_id, bin_step from lows where lo is not null", 13)))
def proposed_ranges(t: Tables) -> DataFrame:
    """Ranges around the active bins of pools, with how long a price is expected to stay in them or to take to four
    fifths of their half-width."""
    k = F.col("pool_key")
    rows = t.pools().select("pool", "bin_step", F.when(k % 23 != 0, k * 97 % 9000 - 4500).alias("active"), F.when(k % 19 != 0, k % 75).alias("width"), (0.01 + k % 40 / 1000.0).alias("sd"))
    half = F.col("width") * F.col("bin_step") / 20000.0
    out = ledger.proposed_ranges(rows)
    logs = [F.round(F.ln(F.col(f"r.price_{side}")), 6).alias(f"log_{side}") for side in ("lower", "upper")]
    return out.select("pool", "r.refusal", "r.lower_bin", "r.upper_bin", *logs, F.round(scalar.exit_time(half, F.col("sd")), 6).alias("exit_days"), F.round(scalar.exit_time(half, F.col("sd"), 0.8), 6).alias("trigger_days"))


@query(sql("select f.flow_id, f.position_id, f.kind as action, coalesce(case when f.flow_id % 3 <> 0 then f.amount + 1 end, case when f.kind = 0 then f.amount end)::double as final from cash_flows f", "cash_flows"))
def recovered_amounts(t: Tables) -> DataFrame:
    """Confirmed intents with the amounts of their chain events, of which a third are missing."""
    asked = t.cash_flows().select(F.col("flow_id").alias("signature"), "position_id", F.col("kind").alias("action"), F.col("amount").alias("requested"))
    found = t.cash_flows().filter("flow_id % 3 <> 0").select(F.col("flow_id").alias("signature"), "position_id", (F.col("amount") + 1).alias("amount"))
    return ledger.recovered(asked, found).select(F.col("signature").alias("flow_id"), "position_id", "action", F.col("final").cast("double").alias("final"))


@query(sql("select position_id, sum(growth * (position_id % 7 + 1))::double as fees from positions p join (select pool, (event_id % 90)::integer as bin_id, last(g order by t, event_id) - first(g order by t, event_id) as growth from (select pool, t, event_id, sum(v) over (partition by pool, event_id % 90 order by t, event_id) as g from e) group by 1, 2) b on b.pool = p.pool and b.bin_id between p.lower_bin and p.upper_bin group by position_id", "positions", "e"))
def true_fees(t: Tables) -> DataFrame:
    """Fees by the growth of the bins' fees per share."""
    bins = t.events().select("pool", "t", "event_id", "v", (F.col("event_id") % 90).cast("int").alias("bin_id"))
    states = windows.running_sum(bins, ["pool", "bin_id"], ["t", "event_id"], "v", "fee_per_share").select("pool", "bin_id", F.struct("t", "event_id").alias("t"), "fee_per_share")
    out = ledger.true_fees(t.positions().withColumn("shares", F.col("position_id") % 7 + 1), states)
    return out.select("position_id", F.col("fees").cast("double").alias("fees"))


@query(sql("select wallet, position_id, value::double as value from (select *, row_number() over (partition by wallet order by position_id desc) as rn from positions where not closed) where rn = 1", "positions"))
def latest_position(t: Tables) -> DataFrame:
    """Each wallet's newest open position."""
    rows = t.positions().filter("not closed").select("wallet", "position_id", F.col("value").cast("double").alias("value"))
    return windows.latest_per_key(rows.withColumn("o", F.col("position_id")), ["wallet"], ["o"]).drop("o")


@query(sql("select tier, count(*) as pools from pools group by tier", "pools"))
def tier_counts(t: Tables) -> DataFrame:
    return t.pools().groupBy("tier").agg(F.count("*").alias("pools"))


@query(sql("select 1706659200 - max(bucket) as age from c1h", "swaps", "snapshots", "liquidity", **chain_ctes("1h")))
def bar_freshness(t: Tables) -> DataFrame:
    return ops.freshness(rollup.chain(t.swaps(), t.snapshots(), t.liquidity(), "1h"), 1706659200)


@query(sql("select t - t % 900 as bucket, event_type as kind, count(*) as signals from e where t >= 1706486400 group by all", "e"))
def signal_activity(t: Tables) -> DataFrame:
    return ops.activity(t.events().filter("t >= 1706486400").select("t", F.col("event_type").alias("kind")))


@query(sql("select count(distinct pool) as pools from e where t >= 1706655600", "e"))
def active_pools(t: Tables) -> DataFrame:
    return t.events().filter("t >= 1706655600").agg(F.count_distinct("pool").alias("pools"))


_TICKS = {
    "ticks": "select event_type as source, t, event_id, t - user_id % 400 as last_block_time, count(*) filter (event_id % 3 = 0) over (partition by event_type order by t, event_id) as total_rows from e",
    "lagged": "select source, t, event_id, round(greatest(t - last_block_time, 0) / 0.4)::bigint as lag_slots, total_rows - lag(total_rows) over (partition by source order by t, event_id) as new_rows from ticks",
}


@query(sql("select source, t, lag_slots, new_rows, lag_slots <= 750 and coalesce(new_rows, 0) > 0 as healthy from lagged", "e", **{k: v.replace("order by t, event_id", "order by t") for k, v in _TICKS.items()} | {"e": "select max(event_id) as event_id, cast(floor(epoch(ts)) as bigint) as t, max(user_id) as user_id, event_type from events group by 2, 4"}))
def ingest_lag(t: Tables) -> DataFrame:
    e = t.events().groupBy("t", "event_type").agg(F.max("event_id").alias("event_id"), F.max("user_id").alias("user_id"))
    running = F.count_if(F.col("event_id") % 3 == 0).over(W.partitionBy("event_type").orderBy("t"))
    ticks = e.select(F.col("event_type").alias("source"), "t", (F.col("t") - F.col("user_id") % 400).alias("last_block_time"), running.alias("total_rows"))
    return ops.ingest_lag(ticks).select("source", "t", "lag_slots", "new_rows", "healthy")


_OVER = "over (partition by {0} order by t range between {1} preceding and current row)"
_ALERTS = {
    "e2": "select max(event_id) as event_id, cast(floor(epoch(ts)) as bigint) as t, max(user_id) as user_id, event_type from events group by 2, 4",
    "tel": "select event_type as source, t, user_id * 31 % 4000 as lag_slots, t // 7200 as slot, count(*) filter (event_id % 5 = 0) over (partition by event_type order by t) as reconnects from e2",
    "err": "select event_type as source, 'k' || (user_id % 2) as event_type, t, sum(event_id % 60) over (partition by event_type, user_id % 2 order by t) as errors from e2",
    "conditions": f"""select source, '' as part, t, 'lag_warning' as alert, lag_slots > 750 as cond, 300 as hold from tel
      union all select source, '', t, 'lag_critical', lag_slots > 3000, 300 from tel
      union all select source, '', t, 'no_progress', max(slot) {_OVER.format("source", 600)} = min(slot) {_OVER.format("source", 600)} and t - min(t) over (partition by source) >= 600, 300 from tel
      union all select source, '', t, 'reconnects', reconnects - min(reconnects) {_OVER.format("source", 900)} > 5, 300 from tel
      union all select source, event_type, t, 'decode_errors:' || event_type, (errors - min(errors) {_OVER.format("source, event_type", 300)}) / 300.0 > 0.1, 600 from err""",
    "runs": "select *, count(*) filter (not cond) over (partition by source, part, alert order by t) as run from conditions",
    "since": "select *, min(t) filter (cond) over (partition by source, part, alert, run) as begun from runs",
}


@query(sql("select source, t, alert from since where cond and t - begun >= hold", **_ALERTS))
def health_alerts(t: Tables) -> DataFrame:
    """Alerts on telemetry derived from the event stream."""
    e = t.events().groupBy("t", "event_type").agg(F.max("event_id").alias("event_id"), F.max("user_id").alias("user_id"))
    w, part = W.partitionBy("event_type").orderBy("t"), F.concat(F.lit("k"), (F.col("user_id") % 2).cast("string"))
    rows = e.select(F.col("event_type").alias("source"), "t", (F.col("user_id") * 31 % 4000).alias("lag_slots"), F.floor(F.col("t") / 7200).alias("slot"), F.count_if(F.col("event_id") % 5 == 0).over(w).alias("reconnects"))
    errors = e.select(F.col("event_type").alias("source"), part.alias("event_type"), "t", F.sum(F.col("event_id") % 60).over(W.partitionBy("event_type", F.col("user_id") % 2).orderBy("t")).alias("errors"))
    return ops.alerts(rows, errors)


@query(sql("select position_id, json_object('r_org', value::double, 'y_fee', null) as numbers, value::double as r_org from positions", "positions").replace("json_object('r_org', value::double, 'y_fee', null)", "'{\"r_org\":' || value::double || ',\"y_fee\":null}'"))
def predicted_numbers(t: Tables) -> DataFrame:
    """JSON numbers with nulls kept, and read back."""
    rows = t.positions().select("position_id", ledger.as_json(r_org=F.col("value").cast("double"), y_fee=F.lit(None).cast("double")).alias("numbers"))
    return rows.withColumn("r_org", F.get_json_object("numbers", "$.r_org").cast("double"))


@query(sql("select sha256('{\"cap\":' || 100 || ',\"pools\":' || count(*) || '}') as config_hash from pools", "pools"))
def config_hash(t: Tables) -> DataFrame:
    """The hash of a configuration as it is stamped on signals."""
    return t.pools().agg(F.count("*").alias("pools")).select(F.sha2(F.to_json(F.struct(F.lit(100).alias("cap"), "pools")), 256).alias("config_hash"))


_OPEN = """select p.pool, p.pool_key, p.bin_step, (p.pool_key % 500 - 250)::bigint as active_bin, 0.01 + (p.pool_key % 40) / 1000.0 as sd, case when p.pool_key % 3 = 0 then 'V2' else 'V1' end as regime, 1000.0 + p.pool_key as v_star
  from pools p where p.pool_key % 4 <> 0 and not exists (select 1 from positions x where x.pool = p.pool and x.position_id % 211 = 0)"""


@query(sql(
    """select pool, regime, case when regime = 'V2' then 0.5 else 1.0 end::double as horizon_days, bins, active_bin - (bins - 1) // 2 as lower_bin, active_bin - (bins - 1) // 2 + bins - 1 as upper_bin, v_star::double as size, (v_star / 5)::double as size_per_bin
      from (select *, greatest(ceil(1.5 * sd * sqrt(case when regime = 'V2' then 0.5 else 1.0 end) / (bin_step / 10000.0)), 10)::bigint as bins from o)""", "pools", "positions", o=_OPEN))  # fmt: skip
def open_paper_positions(t: Tables) -> DataFrame:
    """New paper positions of POTENTIAL signals on pools that hold none."""
    k = F.col("pool_key")
    rows = t.pools().select("pool", F.lit(0).cast("long").alias("bucket"), "bin_step", (k % 500 - 250).alias("active_bin"), (0.01 + (k % 40) / 1000.0).alias("sigma_d"), F.when(k % 3 == 0, "V2").otherwise("V1").alias("regime"), (1000.0 + k).alias("v_star"))
    found = t.pools().filter("pool_key % 4 <> 0").select("pool", F.lit(0).cast("long").alias("bucket"), F.lit("POTENTIAL").alias("kind"))
    return ledger.open_positions(found, rows, t.positions().filter("position_id % 211 = 0")).drop("opened_at")
