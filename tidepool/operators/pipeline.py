"""From bars to indicators, gates, sizes and exits: stages as columns of one plan, partitioned by pool.

The stages stop one after another for a pool that fails them; here a stop makes the later stages' columns null and
leaves out their rationale items.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import scalar
from tidepool.functions.checks import ITEM, check, info, optional, passed
from tidepool.operators.windows import by_pool, ewma, full_sum, log_returns, realised, trailing_autocorrelations, trailing_sum, trend

REGIMES = ("S", "V1", "V2")


@dataclass(frozen=True)
class Config:
    """Thresholds; three numbers are for the regimes S, V1 and V2."""

    # The defaults of the gates.
    fast: float = 0.97
    slow: float = 0.997
    history_days: float = 3.0
    persistence: int = 30 * 60
    cooldown: int = 2 * 3600
    s_enter_sigma: float = 0.005
    s_enter_peg: float = 0.003
    s_exit_sigma: float = 0.01
    s_exit_peg: float = 0.005
    v2_enter_sigma: float = 0.08
    v2_enter_age: float = 30.0
    v2_exit_sigma: float = 0.05
    v2_exit_age: float = 30.0
    r_min: tuple = (1.5, 2.0, 3.0)
    vol_tvl_min: tuple = (1.0, 1.5, 4.0)
    phi_min: tuple = (0.5, 0.4, 0.5)
    y_fee_min: tuple = (0.08, 0.25, 1.5)
    tvl_min: tuple = (1e6, 5e5, 1.5e5)
    vol_min: tuple = (2e6, 1e6, 5e5)
    trend_min: tuple = (-0.5, -0.5, 0.5)
    trend_min_young: float = 0.35
    h_jit: tuple = (0.05, 0.10, 0.15)
    hurdle: float = 0.20
    consistency: float = 0.5
    theta: tuple = (0.15, 0.10, 0.08)
    tvl_share: tuple = (0.10, 0.05, 0.03)
    capital_share: tuple = (0.40, 0.20, 0.10)
    v_min: tuple = (5000.0, 3000.0, 1000.0)
    positions: int = 5
    capital: float = 1e6
    free: float = 2e5
    mu_fee: float = 1e-3
    mu_arb: float = 2e-4
    kappa: float = 3.0
    decay_window: int = 600
    prior: float = 0.6
    prior_variance: float = 0.05
    sample_variance: float = 0.05
    phi_shape: tuple = (0.16, 0.04, 0.02)
    exit_r: tuple = (1.0, 1.5, 2.0)
    exit_r_hours: tuple = (24.0, 6.0, 3.0)
    exit_vol_tvl: tuple = (0.5, 0.75, 2.0)
    exit_vol_tvl_hours: tuple = (48.0, 12.0, 6.0)
    exit_decay: tuple = (-0.5, 0.4, 0.5)
    exit_decay_young: float = 0.35
    fee_jack: float = 2.0
    risk: dict = field(default_factory=lambda: {"transfer_fee": 100.0, "top10": 0.35, "top1": 0.15, "elsewhere": 0.20, "fee_change_days": 7.0, "signers": 0.40, "round_trip": 0.30, "v2_age_hours": 72.0})


def by_regime(values: tuple) -> Column:
    s, v1, v2 = (F.lit(float(v)) for v in values)
    return F.when(F.col("regime") == "S", s).when(F.col("regime") == "V1", v1).when(F.col("regime") == "V2", v2)


def history(bars: DataFrame, bars_day: int, lookback: int) -> DataFrame:
    """Bars with what the stages need of the past: changes, returns, trailing volume, fees over windows, trend, and the
    autocorrelation of the last `lookback` bars' returns. Nothing looks further back, so the bars of a run and as many
    before them give the same as all bars; only the history's length needs each pool's `first_seen`.

    bars: pool, bucket, volume, fee, open, high, low, close, tvl, active_tvl, as doubles, and first_seen (null where
    the bars begin with the pool's first). All windows share one partitioning and order by pool and bucket.
    """
    hour, week = round(bars_day / 24), 7 * bars_day
    diff = lambda c: (F.col(c) - F.lag(c).over(by_pool())).alias(f"{c}_change")
    ratio = lambda k: F.try_divide(full_sum("fee", k), F.when(F.col("tvl") > 0, F.col("tvl"))) if k else F.lit(None).cast("double")
    rows = bars.select(
        "*", diff("volume"), diff("fee"), diff("tvl"), diff("close"), diff("active_tvl"), F.coalesce(trailing_sum("volume", bars_day), F.lit(0.0)).alias("vol_24h"),
        ratio(hour).alias("fee_tvl_1h"), ratio(bars_day).alias("fee_tvl_24h"), ratio(week).alias("fee_tvl_7d"), trend("volume", bars_day).alias("volume_trend"),
        ((F.col("bucket") - F.coalesce("first_seen", F.first("bucket").over(by_pool()))) / 86400).alias("history_days"),
    )
    returns = trailing_autocorrelations(realised(log_returns(bars), bars_day).drop("rv", "bv"), lookback)
    return rows.join(returns.drop("r"), ["pool", "bucket"], "left").withColumn("jump_share", F.coalesce("jump_share", F.lit(0.05)))


def daily_volatility(rows: DataFrame, cfg: Config, correlated: bool = False, lags: int = 6) -> DataFrame:
    """Adds sigma_d and sigma_d_bps to rows with sigma_fast. Autocorrelation corrects the daily value of 5-minute bars
    only (`correlated`)."""
    rho = [F.coalesce(f"rho_{k}", F.lit(0.0)) for k in range(1, lags + 1)] if correlated else []
    out = rows.withColumn("sigma_d", F.sqrt(scalar.daily_variance(F.col("sigma_fast") * F.col("sigma_fast"), rho)))
    return out.withColumn("sigma_d_bps", scalar.decay_window_bps(F.col("sigma_fast"), cfg.decay_window))


def volatility(rows: DataFrame, cfg: Config, correlated: bool = False, lags: int = 6) -> DataFrame:
    """Adds sigma_gk (a variance), sigma_fast, sigma_slow, sigma_d, sigma_d_bps and sufficient. Each bar is folded
    into the averages once. Autocorrelation corrects the daily value of 5-minute bars only (`correlated`)."""
    gk = rows.withColumn("sigma_gk", scalar.garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close")))
    averaged = ewma(ewma(gk, "sigma_gk", cfg.fast, "__fast"), "sigma_gk", cfg.slow, "__slow")
    rho = [F.coalesce(f"rho_{k}", F.lit(0.0)) for k in range(1, lags + 1)] if correlated else []
    positive = lambda c: F.greatest(F.col(c), F.lit(0.0))
    out = averaged.withColumn("sigma_fast", F.sqrt(positive("__fast"))).withColumn("sigma_slow", F.sqrt(positive("__slow")))
    out = out.withColumn("sigma_d", F.sqrt(scalar.daily_variance(positive("__fast"), rho)))
    out = out.withColumn("sigma_d_bps", scalar.decay_window_bps(F.col("sigma_fast"), cfg.decay_window))
    return out.withColumn("sufficient", F.col("history_days") >= cfg.history_days).drop("__fast", "__slow")


def _candidate(current: Column, x: Column, cfg: Config) -> Column:
    """The regime that one observation suggests, with different bounds for entering and leaving."""
    s_enter = x["pegged"] & (x["slow"] < cfg.s_enter_sigma) & F.coalesce(x["peg"] < cfg.s_enter_peg, F.lit(False))
    v2_enter = (x["slow"] > cfg.v2_enter_sigma) | (x["age"] < cfg.v2_enter_age) | ~x["major"]
    s_exit = (x["fast"] > cfg.s_exit_sigma) | F.coalesce(x["peg"] > cfg.s_exit_peg, F.lit(False))
    v2_exit = (x["slow"] < cfg.v2_exit_sigma) & (x["age"] >= cfg.v2_exit_age) & x["major"]
    from_s = F.when(~s_exit, "S").otherwise(F.when(v2_enter, "V2").otherwise("V1"))
    from_v2 = F.when(~v2_exit, "V2").otherwise(F.when(s_enter, "S").otherwise("V1"))
    fresh = F.when(s_enter, "S").when(v2_enter, "V2").otherwise("V1")
    found = F.when(current == "S", from_s).when(current == "V2", from_v2).otherwise(fresh)
    return F.when(x["sufficient"], found)


def suggested(current: str | None, x, cfg: Config) -> str | None:
    """The regime that an observation suggests; a missing number (NaN) meets no bound."""
    if not x.sufficient:
        return None
    minor = x.major is not None and not x.major
    calm = bool(x.pegged) and x.sigma_slow < cfg.s_enter_sigma and x.dev_peg < cfg.s_enter_peg
    wild = x.sigma_slow > cfg.v2_enter_sigma or x.age_days < cfg.v2_enter_age or minor
    if current == "S":
        stays = x.sigma_fast <= cfg.s_exit_sigma and not x.dev_peg > cfg.s_exit_peg
        return "S" if stays else "V2" if wild else "V1"
    if current == "V2":
        stays = x.sigma_slow >= cfg.v2_exit_sigma or x.age_days < cfg.v2_exit_age or minor
        return "V2" if stays else "S" if calm else "V1"
    return "S" if calm else "V2" if wild else "V1"


_STATE = "struct<regime: string, since: bigint, pending: string, pending_since: bigint, last: bigint>"
_STEP = "struct<t: bigint, regime: string, item: " + ITEM + ">"


def regimes(rows: DataFrame, cfg: Config, width: int) -> DataFrame:
    """pool, bucket, regime, regime_item: the committed regime after each bar, by a fold over the pool's history.

    A candidate is committed once it has lasted for the persistence and the cooldown since the last change is over;
    a kill switch commits at once. A null candidate (too little history) never commits by itself from a calm state.
    The clock is the bar's end. A pool's observations are bounded by the history
    given, so its sorted array stays small.

    rows: pool, bucket, sigma_slow, sigma_fast, sufficient, and dev_peg, age_days, pegged, major, kill.
    """
    one = F.struct(
        (F.col("bucket") + width).alias("t"), F.col("sigma_slow").alias("slow"), F.col("sigma_fast").alias("fast"), F.col("dev_peg").alias("peg"), F.col("age_days").alias("age"),
        F.col("pegged").alias("pegged"), F.col("major").alias("major"), F.col("kill").alias("kill"), F.col("sufficient").alias("sufficient"),
    )
    pools = rows.groupBy("pool").agg(F.array_sort(F.collect_list(one)).alias("xs"), F.min(F.col("bucket") + width).alias("t0"))

    def state(regime: Column, since: Column, pending: Column, pending_since: Column, last: Column) -> Column:
        return F.struct(regime.alias("regime"), since.alias("since"), pending.alias("pending"), pending_since.alias("pending_since"), last.alias("last"))

    none, never = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        s, t = acc["s"], x["t"]
        cand = _candidate(s["regime"], x, cfg)
        same = cand.eqNullSafe(s["regime"])
        # a null candidate equals no pending one, so its waiting time is only set where another was pending before
        waiting_since = F.when(~cand.eqNullSafe(s["pending"]), t).otherwise(s["pending_since"])
        waited, rested = (t - F.coalesce(waiting_since, t)) / 60.0, (t - s["last"]) / 60.0
        early, cooling = waited < cfg.persistence / 60.0, F.coalesce(rested < cfg.cooldown / 60.0, F.lit(False))
        commit = state(cand, t, none, never, t)
        calm = state(s["regime"], s["since"], none, never, s["last"])
        wait = state(s["regime"], s["since"], cand, waiting_since, s["last"])
        after = F.when(x["kill"], commit).when(same, calm).when(early | cooling, wait).otherwise(commit)
        item = (
            F.when(x["kill"], info("regime_kill_switch", F.lit(1.0)))
            .when(same, info("regime_stable_minutes", (t - s["since"]) / 60.0))
            .when(early | ~cooling, check("regime_persistence_minutes", waited, ">=", cfg.persistence / 60.0))
            .otherwise(check("regime_cooldown_minutes", rested, ">=", cfg.cooldown / 60.0))
        )
        done = F.struct(t.alias("t"), after["regime"].alias("regime"), item.alias("item"))
        return F.struct(after.cast(_STATE).alias("s"), F.concat(acc["out"], F.array(done.cast(_STEP))).alias("out"))

    start = F.struct(state(none, F.col("t0"), none, never, never).cast(_STATE).alias("s"), F.array().cast(f"array<{_STEP}>").alias("out"))
    folded = pools.select("pool", F.explode(F.aggregate("xs", start, step)["out"]).alias("o"))
    return folded.select("pool", (F.col("o.t") - width).alias("bucket"), F.col("o.regime").alias("regime"), F.col("o.item").alias("regime_item"))


def risk_items(cfg: Config) -> Column:
    """Sixteen checks, all of them recorded; inputs are nullable columns, and a null one passes as unavailable."""
    c, r = lambda name: F.col(name).cast("double"), cfg.risk
    elsewhere = F.when(F.coalesce(F.col("cex_listed"), F.lit(False)), F.greatest(F.coalesce(c("elsewhere"), F.lit(0.0)), F.lit(r["elsewhere"]))).otherwise(c("elsewhere"))
    items = [
        optional("mint_authority_null", c("mint_authority"), "<=", 0.0), optional("freeze_authority_null_or_documented", c("freeze_authority"), "<=", 0.0),
        optional("token2022_no_permanent_delegate", c("permanent_delegate"), "<=", 0.0), optional("token2022_no_transfer_hook", c("transfer_hook"), "<=", 0.0),
        optional("token2022_transfer_fee_bps", c("transfer_fee_bps"), "<=", r["transfer_fee"]), optional("top10_holder_share", c("top10_share"), "<", r["top10"]),
        optional("top1_holder_share", c("top1_share"), "<", r["top1"]), optional("insider_bundle_below_danger_tier", c("insider_bundle"), "<=", 0.0),
        optional("liquidity_elsewhere", elsewhere, ">=", r["elsewhere"]), optional("creator_no_recent_fee_change", c("fee_change_days"), ">=", r["fee_change_days"]),
        optional("creator_status_enabled", c("disabled"), "<=", 0.0), optional("creator_activation_passed", c("not_activated"), "<=", 0.0),
        optional("quote_asset_allowed", c("quote_refused"), "<=", 0.0), optional("wash_signer_volume_share", c("top_share"), "<=", r["signers"]),
        optional("wash_round_trip_ratio", c("round_trip"), "<", r["round_trip"]),
    ]
    young = check("v2_minimum_age_hours", F.col("age_days") * 24, ">=", r["v2_age_hours"])
    return F.concat(F.array(*items), F.when(F.col("regime") == "V2", F.array(young)).otherwise(F.array().cast(f"array<{ITEM}>")))


#: Inputs of the risk gate that a caller may have; missing columns count as unavailable.
RISK_INPUTS = ("mint_authority", "freeze_authority", "permanent_delegate", "transfer_hook", "transfer_fee_bps", "top10_share", "top1_share", "insider_bundle", "elsewhere", "fee_change_days", "disabled", "not_activated", "quote_refused", "top_share", "round_trip", "phi_time", "phi_size")


def with_risk_inputs(rows: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("double") for c in RISK_INPUTS if c not in rows.columns}
    if "cex_listed" not in rows.columns:
        missing["cex_listed"] = F.lit(None).cast("boolean")
    return rows.withColumns(missing) if missing else rows


def evaluate(rows: DataFrame, cfg: Config) -> DataFrame:
    """The stages after the regime: gate, organic flow, fee forecast, ranking, sizing. Adds the indicators, `rationale`
    and the flags gated, attractive.

    rows: output of history, volatility and regimes, with bin_step, base_factor, base_power, vfc, protocol_share,
    quality, active_liquidity (measured, nullable), trades, c_fill, and the risk inputs.
    """
    empty = F.array().cast(f"array<{ITEM}>")
    when = lambda flag, items: F.when(flag, items).otherwise(empty)
    step = F.col("bin_step") / 10_000.0
    added: dict[str, Column] = {}  # in order: later ones refer to earlier ones, and one projection adds them all
    added["vol_items"] = F.array(
        check("sufficient_volatility_history_days", F.col("history_days"), ">=", cfg.history_days), info("sigma_gk", F.col("sigma_gk")), info("sigma_fast", F.col("sigma_fast")),
        info("sigma_slow", F.col("sigma_slow")), info("sigma_d", F.col("sigma_d")), info("sigma_jump", F.col("jump_share")), F.col("regime_item"),
    )
    added["has_regime"] = F.col("regime").isNotNull()
    added["risk"] = risk_items(cfg)
    added["gated"] = F.col("has_regime") & passed(F.col("risk"))
    estimated = F.col("tvl") * by_regime(cfg.phi_shape)
    live = lambda c: F.when(F.col("gated"), c)
    added["l_a"] = live(F.when(F.col("quality") == "A", F.coalesce("active_liquidity", estimated)).otherwise(estimated))
    mech = scalar.phi_mechanical(F.col("sigma_d"), step, F.col("l_a"), F.col("c_fill"), F.col("vol_24h"))
    added["phi_mech"] = live(mech)
    blended = scalar.phi_blend(F.col("phi_time"), F.col("trades"), F.col("phi_mech"), F.coalesce("phi_size", "phi_mech"))
    added["phi_observed"] = blended
    added["phi_org"] = live(scalar.shrink(F.col("phi_observed"), F.col("trades"), cfg.sample_variance, cfg.prior, cfg.prior_variance))
    base = scalar.base_fee_rate(F.col("base_factor"), F.col("bin_step"), F.col("base_power"))
    added["fee_current"] = live(base.cast("double") / scalar.FEE_UNIT)
    added["f_hat"] = live(scalar.forecast_fee(base, F.col("vfc"), F.col("bin_step"), F.col("sigma_d_bps"), cfg.kappa))
    added["tau_a"] = live(F.when(F.col("l_a") > 0, F.col("vol_24h") / F.col("l_a")).otherwise(0.0))
    added["r_gross"] = live(scalar.r_ratio(F.col("f_hat"), F.col("tau_a"), step, F.col("protocol_share"), F.col("sigma_d")))
    added["r_org"] = F.col("r_gross") * F.col("phi_org") * (1 - by_regime(cfg.h_jit))
    added["y_fee"] = scalar.fee_yield(F.col("protocol_share"), F.col("f_hat"), F.col("tau_a"), by_regime(cfg.h_jit))
    added["vol_tvl"] = live(F.when(F.col("tvl") > 0, F.col("vol_24h") / F.col("tvl")).otherwise(0.0))
    added["fee_tvl"] = F.when(F.col("tvl") > 0, F.col("fee_current") * F.col("tau_a"))
    added["fee_active_tvl"] = F.col("fee_tvl") * F.col("tvl") / F.greatest("l_a", F.lit(1.0))
    young = (F.col("regime") == "V2") & (F.col("age_days") < cfg.v2_enter_age)
    trend_min = F.when(young, F.lit(cfg.trend_min_young)).otherwise(by_regime(cfg.trend_min))
    flow = F.array(info("phi_mech", F.col("phi_mech")), info("phi_size_fit_available", F.col("phi_size").isNotNull().cast("double")), info("phi_time_available", F.col("phi_time").isNotNull().cast("double")), info("phi_org_observed", F.col("phi_observed")), info("phi_org_shrunk", F.col("phi_org")))
    fee = F.array(info("fee_current", F.col("fee_current")), check("fee_forecast_within_cap", F.col("f_hat"), "<=", 0.10))
    ranks = F.array(
        check("r_org", F.col("r_org"), ">=", by_regime(cfg.r_min)), check("vol_tvl_24h", F.col("vol_tvl"), ">=", by_regime(cfg.vol_tvl_min)), check("phi_org", F.col("phi_org"), ">=", by_regime(cfg.phi_min)),
        check("y_fee_annual", F.col("y_fee") * 365, ">=", by_regime(cfg.y_fee_min)), check("tvl_usd", F.col("tvl"), ">=", by_regime(cfg.tvl_min)), check("vol_24h", F.col("vol_24h"), ">=", by_regime(cfg.vol_min)),
        check("volume_trend", F.col("volume_trend"), ">=", trend_min),
    )
    known = F.col("fee_tvl_1h").isNotNull() & F.col("fee_tvl_24h").isNotNull() & F.col("fee_tvl_7d").isNotNull()
    steady = check("multi_window_consistency", F.least(F.col("fee_tvl_1h") * 24, F.col("fee_tvl_24h"), F.col("fee_tvl_7d") / 7), ">=", F.col("fee_tvl_24h") * cfg.consistency)
    added["rank_items"] = when(F.col("gated"), F.concat(ranks, when(known, F.array(steady))))
    added["attractive"] = F.col("gated") & passed(F.col("rank_items"))
    added["eligible"] = F.col("attractive") & (F.col("quality") == "A")
    m_star = scalar.self_dilution_cap(F.col("l_a"), F.col("protocol_share"), F.col("f_hat"), F.col("tau_a"), cfg.hurdle)
    added["m_dilution"] = m_star
    added["ranking_key"] = F.when(F.col("m_dilution") > 0, F.col("r_org") * F.least(F.try_divide(F.col("vol_24h"), 5 * F.col("m_dilution")), F.lit(1.0))).otherwise(F.col("r_org"))
    share, kelly = by_regime(cfg.theta) * F.col("l_a"), scalar.quarter_kelly(F.lit(cfg.mu_fee), F.lit(cfg.mu_arb), F.col("sigma_d"))
    caps = [cfg.positions * share, by_regime(cfg.tvl_share) * F.col("tvl"), by_regime(cfg.capital_share) * cfg.capital, F.greatest(kelly * cfg.capital, F.lit(0.0)), F.lit(cfg.free)]
    added["size_cap"] = F.least(*caps)
    added["v_star"] = F.when(F.col("eligible"), scalar.capped_size(caps, by_regime(cfg.v_min)))
    sizes = F.array(info("m_dilution", F.col("m_dilution")), info("m_share_per_bin", share), info("v_tvl_cap", caps[1]), info("v_car_cap", caps[2]), info("quarter_kelly_fraction", kelly), check("position_size", F.col("size_cap"), ">=", by_regime(cfg.v_min)))
    items = F.concat("vol_items", when(F.col("has_regime"), F.col("risk")), when(F.col("gated"), F.concat(flow, fee)), "rank_items", when(F.col("eligible"), sizes))
    added["rationale"] = items
    out = rows.drop(*added).select("*", *[c.alias(name) for name, c in added.items()])
    return out.drop("vol_items", "risk", "rank_items", "size_cap", "phi_observed", "regime_item", "has_regime")


#: Hours of a pool's history that exits look back on.
EXIT_HOURS = 96


def exits(rows: DataFrame, cfg: Config) -> DataFrame:
    """Adds `exit_items` and `exit` to evaluated rows: how long r_org and vol/TVL have been below their exit bounds
    (twice as long at weekends), volume decay, and a jump in the fee (column fee_multiplier, nullable). Nothing looks
    back further than EXIT_HOURS, which no bound exceeds."""
    earliest = F.min("bucket").over(by_pool().rangeBetween(-EXIT_HOURS * 3600, 0))

    def hours(df: DataFrame, value: str, bound: Column, out: str) -> DataFrame:
        """Hours since the first of the unbroken run of bars below the bound within the look-back; 0 where it isn't
        below."""
        below = F.coalesce(F.col(value) < bound, F.lit(False))
        runs = df.withColumn("__run", F.count_if(~below).over(by_pool()))
        first = F.min(F.when(below, F.col("bucket"))).over(W.partitionBy("pool", "__run"))
        return runs.withColumn(out, F.when(below, (F.col("bucket") - F.greatest(first, earliest)) / 3600.0).otherwise(F.lit(0.0))).drop("__run")

    weekend = F.when(scalar.is_weekend(F.col("bucket")), 2.0).otherwise(1.0)
    young = (F.col("regime") == "V2") & (F.col("age_days") < cfg.v2_enter_age)
    decay = F.when(young, F.lit(cfg.exit_decay_young)).otherwise(by_regime(cfg.exit_decay))
    jack = F.col("fee_multiplier") if "fee_multiplier" in rows.columns else F.lit(None).cast("double")
    timed = hours(hours(rows, "r_org", by_regime(cfg.exit_r), "__r"), "vol_tvl", by_regime(cfg.exit_vol_tvl), "__v")
    items = F.array(
        check("r_org_exit_persistence_hours", F.col("__r"), "<", by_regime(cfg.exit_r_hours) * weekend), check("vol_tvl_exit_persistence_hours", F.col("__v"), "<", by_regime(cfg.exit_vol_tvl_hours) * weekend),
        check("volume_decay", F.col("volume_trend"), ">=", decay), F.when(jack.isNull(), info("fee_jack_kill", F.lit(0.0))).otherwise(check("fee_jack_kill", jack, "<", cfg.fee_jack)),
    )
    return timed.withColumn("exit_items", items).withColumn("exit", ~passed(F.col("exit_items"))).drop("__r", "__v")


def signals(rows: DataFrame, cfg: Config) -> DataFrame:
    """pool, bucket, kind of evaluated rows with exits: none for estimated rows and rows without a regime; GATE_FAIL
    without r_org, DEGRADING on an exit, POTENTIAL at r_min or above. `windows.cooled` decides which are sent."""
    kind = F.when((F.col("quality") != "A") | F.col("regime").isNull(), F.lit(None).cast("string")).when(F.col("r_org").isNull(), "GATE_FAIL").when(F.col("exit"), "DEGRADING").when(F.col("r_org") >= by_regime(cfg.r_min), "POTENTIAL")
    return rows.select("pool", "bucket", kind.alias("kind"), "regime", "r_org").filter("kind is not null")


def rationale_rows(rows: DataFrame) -> DataFrame:
    """One row per recorded check: pool, bucket, seq, signal, observed, cmp, threshold, passed."""
    each = rows.select("pool", "bucket", F.posexplode("rationale").alias("seq", "item"))
    return each.select("pool", "bucket", "seq", "item.*")


def latest(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("pool").orderBy(F.desc("bucket"))
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
