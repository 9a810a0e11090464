"""The indicator pipeline as SQL for DuckDB: averages and regimes by recursion over each pool's bars, the mixture fit by
recursion over its rounds, everything else by windows and plain expressions. Numbers come from the configuration."""

from __future__ import annotations

from tidepool.operators.incremental import LOOKBACK
from tidepool.operators.mixture import ALIKE, FEWEST, GRID, ROUNDS
from tidepool.operators.pipeline import Config
from tidepool.plans.rollup import state_bars_sql, swap_bars_sql
from tidepool.schemas import TIMEFRAMES, bars_a_day
from tidepool.sources.adapters import sql

_W = "partition by pool order by bucket"
#: Signers of a day from which on their shares are a screen for wash trading.
SCREENED = 50


def _rows(first: int, last: str = "current row") -> str:
    return f"({_W} rows between {first} preceding and {last})"


def _by_regime(values: tuple, name: str = "regime") -> str:
    return f"case {name} when 'S' then {values[0]}::double when 'V1' then {values[1]}::double when 'V2' then {values[2]}::double end"


def significant(x: str, digits: int = 6) -> str:
    """x with so many digits after the first one."""
    p = f"pow(10::double, floor(log10(abs({x}))))"
    return f"case when {x} = 0 then 0::double when {x} is not null then round({x} / {p}, {digits}) * {p} end"


def _bars(tf: str) -> dict[str, str]:
    width, day = TIMEFRAMES[tf], bars_a_day(tf)
    hour, week = round(day / 24), 7 * day
    total = lambda c, k: f"case when count(*) over {_rows(k - 1)} >= {k} then sum({c}) over {_rows(k - 1)} end"
    ratio = lambda k: f"({total('fee', k)}) / nullif(greatest(tvl, 0), 0)" if k else "null::double"
    prior = f"sum(volume) over {_rows(2 * day - 1, f'{day} preceding')}"
    lags = "".join(f", r * lag(r, {k}) over ({_W}) as p{k}" for k in range(1, 7))
    begin = LOOKBACK - 2
    sums = "".join(f", sum(p{k}) over {_rows(begin - k)} as s{k}, sum(r) over {_rows(begin, f'{k} preceding')} as a{k}, sum(case when p{k} is not null then r end) over {_rows(begin - k)} as b{k}" for k in range(1, 7))
    rho = "".join(f", case when n >= 20 and q - m * m > 0 then (s{k} - m * (a{k} + b{k}) + (n - {k}) * m * m) / (n - {k}) / (q - m * m) end as rho_{k}" for k in range(1, 7))
    return {
        "sb": swap_bars_sql(width, traders=False), "st": state_bars_sql(width),
        "b": "select sb.pool, sb.bucket, sb.open::double as open, sb.high::double as high, sb.low::double as low, sb.close::double as close, sb.volume::double * 10000 as volume, sb.fee_milli::double * 10 as fee, sb.swap_count as trades, st.tvl_close::double * 100 as tvl, st.active_tvl_close::double * 10 as active_tvl from sb join st on st.pool = sb.pool and st.bucket = sb.bucket",
        "h": f"""select *, coalesce(sum(volume) over {_rows(day - 1)}, 0) as vol_24h, {ratio(hour)} as fee_tvl_1h, {ratio(day)} as fee_tvl_24h, {ratio(week)} as fee_tvl_7d,
          case when count(*) over {_rows(2 * day - 1)} >= {2 * day} and {prior} > 0 then (coalesce({total('volume', day)}, 0) - {prior}) / {prior} else 0 end as volume_trend,
          (bucket - first(bucket) over ({_W})) / 86400.0::double as history_days, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) as sigma_gk, volume - lag(volume) over ({_W}) as volume_change, row_number() over ({_W}) as i from b""",
        "rr": f"select pool, bucket, close, lag(close) over ({_W}) as p from b",
        "ret": f"select pool, bucket, r{lags} from (select pool, bucket, ln(close / p) as r from rr where p > 0 and close > 0)",
        "frames": f"select pool, bucket, count(*) over {_rows(begin)} as n, avg(r) over {_rows(begin)} as m, sum(r * r) over {_rows(begin)} / count(*) over {_rows(begin)} as q{sums} from ret",
        "rhos": f"select pool, bucket{rho} from frames",
    }


_WASH = f"""select pool, bucket + 86400 as day, sum(volume) filter (rn <= 5)::double / sum(volume)::double as top_share, 2 * sum(least(buy, sell))::double / sum(volume)::double as round_trip from (
  select *, row_number() over (partition by pool, bucket order by volume desc, signer) as rn from (
    select pool, t - t % 86400 as bucket, signer, sum(volume_usd) as volume, coalesce(sum(volume_usd) filter (not swap_for_y), 0) as buy, coalesce(sum(volume_usd) filter (swap_for_y), 0) as sell
    from swaps group by pool, t - t % 86400, signer)) group by pool, bucket having count(*) >= {SCREENED}"""
_CELLS = f"select pool, bucket, case when volume_usd > 0 then floor(ln(volume_usd::double) * {GRID}) else -1e12 end as cell, avg(volume_usd::double) as size, count(*)::double as n from ({{rows}}) group by all"
_PART = "(share * small * exp(-small * size))"
_OTHER = "((1 - share) * large * exp(-large * size))"
_FIT = f"""select pool, bucket, 0 as k, sum(n) as n, 0.5::double as share, 2 / (sum(size * n) / sum(n)) as small, 2 / (3 * (sum(size * n) / sum(n))) as large from cells group by pool, bucket having sum(n) >= {FEWEST} and sum(size * n) > 0
  union all
  select pool, bucket, any_value(k) + 1, any_value(total), least(greatest(sum(r * n) / any_value(total), 1e-6), 1 - 1e-6),
    case when sum(r * size * n) > 0 then sum(r * n) / sum(r * size * n) else any_value(small) end, case when sum((1 - r) * size * n) > 0 then sum((1 - r) * n) / sum((1 - r) * size * n) else any_value(large) end
  from (select c.pool, c.bucket, c.size, c.n, f.k, f.n as total, small, large, case when {_PART} + {_OTHER} > 0 then {_PART} / ({_PART} + {_OTHER}) else 0.5 end as r from fit f join cells c on c.pool = f.pool and c.bucket = f.bucket where f.k < {ROUNDS})
  group by pool, bucket"""


def _regimes(cfg: Config, width: int) -> str:
    """Each pool's bars in turn: averages, candidate, and what the rule makes of it."""
    calm = f"(pegged and sqrt(slow) < {cfg.s_enter_sigma} and coalesce(dev_peg < {cfg.s_enter_peg}, false))"
    wild = f"(sqrt(slow) > {cfg.v2_enter_sigma} or age_days < {cfg.v2_enter_age} or not major)"
    s_exit = f"(sqrt(fast) > {cfg.s_exit_sigma} or coalesce(dev_peg > {cfg.s_exit_peg}, false))"
    v2_exit = f"(sqrt(slow) < {cfg.v2_exit_sigma} and age_days >= {cfg.v2_exit_age} and major)"
    found = f"""case when not sufficient then null when regime = 'S' then case when not {s_exit} then 'S' when {wild} then 'V2' else 'V1' end
      when regime = 'V2' then case when not {v2_exit} then 'V2' when {calm} then 'S' else 'V1' end when {calm} then 'S' when {wild} then 'V2' else 'V1' end"""
    step = f"""select n.pool, n.bucket, n.i, n.bucket + {width} as t, n.pegged, n.major, n.sufficient, n.dev_peg, n.age_days, {cfg.fast} * coalesce(f.fast, 0) + (1 - {cfg.fast}) * n.sigma_gk as fast, {cfg.slow} * coalesce(f.slow, 0) + (1 - {cfg.slow}) * n.sigma_gk as slow,
      f.regime, coalesce(f.since, n.bucket + {width}) as since, f.pending, f.pending_since, f.last"""
    after = f"""select pool, bucket, i, fast, slow, regime as regime_before,
      case when commits then cand else regime end as regime, case when commits then t else since end as since, case when commits or same then null else cand end as pending,
      case when commits or same then null else waiting end as pending_since, case when commits then t else last end as last,
      case when same then 'regime_stable_minutes' when waited and cooling then 'regime_cooldown_minutes' else 'regime_persistence_minutes' end as item_signal,
      case when same then (t - since) / 60.0 when waited and cooling then (t - last) / 60.0 else (t - coalesce(waiting, t)) / 60.0 end::double as item_observed,
      case when same then (t - since) / 60.0 when waited and cooling then {cfg.cooldown / 60.0} else {cfg.persistence / 60.0} end::double as item_threshold, same or (waited and not cooling) as item_passed
      from (select *, not same and waited and not cooling as commits from (
        select *, t - coalesce(waiting, t) >= {cfg.persistence} as waited, coalesce(t - last < {cfg.cooldown}, false) as cooling from (
          select *, cand is not distinct from regime as same, case when cand is distinct from pending then t else pending_since end as waiting from (select *, {found} as cand from ({{rows}})))))"""
    none = "(select null::double as fast, null::double as slow, null::varchar as regime, null::bigint as since, null::varchar as pending, null::bigint as pending_since, null::bigint as last)"
    return f"{after.format(rows=f'{step} from d n, {none} f where n.i = 1')} union all {after.format(rows=f'{step} from fold f join d n on n.pool = f.pool and n.i = f.i + 1')}"


def _stages(cfg: Config, tf: str) -> dict[str, str]:
    """The stages after the regime, each a CTE that adds columns to the one before."""
    live = lambda x: f"case when gated then {x} end"
    rho = " + ".join(f"coalesce(rho_{k}, 0)" for k in range(1, 7)) if tf == "5m" else "0"
    step, jit = "(bin_step / 10000.0::double)", _by_regime(cfg.h_jit)
    trend_min = f"case when regime = 'V2' and age_days < {cfg.v2_enter_age} then {cfg.trend_min_young} else {_by_regime(cfg.trend_min)} end"
    at_least = " and ".join(f"coalesce({x} >= {y}, false)" for x, y in (
        ("r_org", _by_regime(cfg.r_min)), ("vol_tvl", _by_regime(cfg.vol_tvl_min)), ("phi_org", _by_regime(cfg.phi_min)), ("y_fee * 365", _by_regime(cfg.y_fee_min)),
        ("tvl", _by_regime(cfg.tvl_min)), ("vol_24h", _by_regime(cfg.vol_min)), ("volume_trend", trend_min)))
    steady = f"(fee_tvl_1h is null or fee_tvl_24h is null or fee_tvl_7d is null or coalesce(least(fee_tvl_1h * 24, fee_tvl_24h, fee_tvl_7d / 7) >= fee_tvl_24h * {cfg.consistency}, false))"
    risk = f"not blacklisted and coalesce(top_share <= {cfg.risk['signers']}, true) and coalesce(round_trip < {cfg.risk['round_trip']}, true) and (regime <> 'V2' or age_days * 24 >= {cfg.risk['v2_age_hours']})"
    return {
        "v1": "select d.*, fold.fast, fold.slow, fold.regime, fold.regime_before, item_signal, item_observed, item_threshold, item_passed, sqrt(greatest(fold.fast, 0)) as sigma_fast, sqrt(greatest(fold.slow, 0)) as sigma_slow, rhos.* exclude (pool, bucket) from d join fold on fold.pool = d.pool and fold.i = d.i left join rhos on rhos.pool = d.pool and rhos.bucket = d.bucket",
        "v2": f"select *, sqrt(greatest(sigma_fast * sigma_fast * 288 * (1 + 2 * ({rho})), sigma_fast * sigma_fast * 288 * 0.5)) as sigma_d, sigma_fast * sqrt({cfg.decay_window} / 86400.0) * 10000 as sigma_d_bps, regime is not null and {risk} as gated from v1",
        "v3": f"select *, tvl * ({_by_regime(cfg.phi_shape)}) as shaped, base_factor::double * bin_step * 10 * case base_power when 1 then 10 else 1 end as base, case when regime_before = 'S' then 0.75 else 0.5 end as c_fill, least(round(sqrt(pow(sigma_d_bps / bin_step, 2) * {cfg.kappa}) * 10000), 4294967295)::hugeint * bin_step as reach from v2",
        "v4": f"select *, {live('''case when quality = 'A' then coalesce(active_tvl, shaped) else shaped end''')} as l_a, {live('least(base + case when vfc = 0 then 0 else ((vfc::hugeint * reach * reach + 99999999999) // 100000000000)::double end, 1e8) / 1e9')} as f_hat, {live('base / 1e9')} as fee_current from v3",
        "v5": f"select *, {live(f'case when vol_24h <= 0 then 0 else greatest(0, least(1, 1 - pow(sigma_d / {step}, 2) * (l_a * c_fill / vol_24h))) end')} as phi_mech, {live('case when l_a > 0 then vol_24h / l_a else 0 end')} as tau_a, {live('case when tvl > 0 then vol_24h / tvl else 0 end')} as vol_tvl from v4",
        "v6": f"select *, 0.6 * phi_mech + 0.4 * coalesce(phi_size, phi_mech) as phi_observed, {cfg.sample_variance} / trades as own, {live(f'coalesce(2 * f_hat * tau_a * {step} * 0.9 / nullif(sigma_d * sigma_d, 0), 0)')} as r_gross, 0.9 * f_hat * tau_a * (1 - ({jit})) as y_fee, case when tvl > 0 then fee_current * tau_a end as fee_tvl from v5",
        "v7": f"select *, {live(f'own / (own + {cfg.prior_variance}) * {cfg.prior} + {cfg.prior_variance} / (own + {cfg.prior_variance}) * phi_observed')} as phi_org, fee_tvl * tvl / greatest(l_a, 1.0) as fee_active_tvl, l_a * (sqrt(0.9 * f_hat * tau_a / ({cfg.hurdle} / 365)) - 1) as m_dilution from v6",
        "v8": f"select *, r_gross * phi_org * (1 - ({jit})) as r_org from v7",
        "v9": f"select *, gated and {at_least} and {steady} as attractive, case when m_dilution > 0 then r_org * least(vol_24h / (5 * m_dilution), 1.0) else r_org end as ranking_key, least({cfg.positions} * ({_by_regime(cfg.theta)}) * l_a, ({_by_regime(cfg.tvl_share)}) * tvl, ({_by_regime(cfg.capital_share)}) * {cfg.capital}, greatest({cfg.mu_fee - cfg.mu_arb} / nullif(pow(0.5 * 1.3 * sigma_d, 2), 0) / 4 * {cfg.capital}, 0), {cfg.free}) as size_cap from v8",
        "scored": f"select *, case when attractive and quality = 'A' and size_cap >= {_by_regime(cfg.v_min)} then size_cap end as v_star from v9",
    }


def scored_ctes(cfg: Config, tf: str) -> dict[str, str]:
    """CTEs (of a recursive WITH) that end in `scored`: the evaluated bars of one timeframe."""
    described = """select h.*, case when p.pool_key % 4 = 0 then abs(h.close - 1) / 1000 end as dev_peg, h.history_days + case when p.pool_key % 3 = 0 then 60 else 25 end as age_days, p.pool_key % 4 = 0 as pegged, p.pool_key % 3 = 0 as major,
      case when p.tier = 1 then 'A' else 'B' end as quality, p.bin_step, p.base_factor, p.base_power, p.vfc, p.tier, p.blacklisted, w.top_share, w.round_trip, o.phi_size, h.history_days >= {0} as sufficient
      from h join pools p on p.pool = h.pool left join wash w on w.pool = h.pool and w.day = h.bucket - h.bucket % 86400 left join organic o on o.pool = h.pool and o.day = h.bucket - h.bucket % 86400"""
    return {
        **_bars(tf), "wash": _WASH, "cells": _CELLS.format(rows="select pool, t - t % 86400 as bucket, volume_usd from swaps"), "fit": _FIT, "organic": f"select pool, bucket + 86400 as day, case when small >= large * (1 - {ALIKE}) then share else 1 - share end as phi_size from fit where k = {ROUNDS}",
        "d": described.format(cfg.history_days), "fold": _regimes(cfg, TIMEFRAMES[tf]), **_stages(cfg, tf),
    }


def fit_sql(rows: str, body: str, *names: str) -> str:
    """A query over `fit`, the rounds of the mixture fit of rows (pool, bucket, volume_usd)."""
    return sql(body.format(alike=ALIKE, rounds=ROUNDS), *names, cells=_CELLS.format(rows=rows), fit=_FIT).replace("with ", "with recursive ", 1)


def scored_sql(cfg: Config, tf: str, body: str, *names: str, **more: str) -> str:
    """A query over `scored` and other logical tables."""
    return sql(body, "swaps", "snapshots", "pools", *names, **scored_ctes(cfg, tf), **more).replace("with ", "with recursive ", 1)
