"""Formulas of fees, prices, volatility, turnover, ranking and sizing as column expressions.

Nulls propagate. Divisions go through `try_divide`, so a zero denominator gives null instead of an error; gates treat
null and NaN as "not measured" (`functions.checks`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fee rates are integers of a billionth; a rate is capped at a tenth.
FEE_UNIT, MOST_FEE = 10**9, 10**8
LOGARITHM_REACH = 35.0
_WIDE = "decimal(38,0)"


def bucket(t: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket of `width` seconds."""
    return t - F.pmod(t, F.lit(width))


def base_fee_rate(base_factor: Column, bin_step: Column, power: Column) -> Column:
    """base_factor * bin_step * 10 * 10^power, exact; null on overflow."""
    scale = F.pow(F.lit(10.0), power).cast(_WIDE)
    product = F.try_multiply(base_factor.cast(_WIDE), bin_step.cast("decimal(10,0)"))
    return F.try_multiply(F.try_multiply(product.cast(_WIDE), F.lit(10).cast("decimal(2,0)")).cast(_WIDE), scale.cast("decimal(20,0)")).cast(_WIDE)


def variable_fee_rate(vfc: Column, accumulator: Column, bin_step: Column) -> Column:
    """(vfc * (accumulator * bin_step)^2 + 99 999 999 999) div 10^11, exact; 0 without a control value."""
    step = (accumulator.cast("decimal(12,0)") * bin_step.cast("decimal(6,0)")).cast("decimal(18,0)")
    square = (step * step).cast("decimal(37,0)")
    total = F.try_add(F.try_multiply(square, vfc.cast("decimal(12,0)")).cast(_WIDE), F.lit(99_999_999_999).cast("decimal(12,0)"))
    # decimal division rounds, so the remainder is taken off first
    unit = F.lit(10**11).cast("decimal(12,0)")
    total = total.cast(_WIDE)
    rate = ((total - total % unit) / unit).cast(_WIDE)
    return F.when(vfc == 0, F.lit(0).cast(_WIDE)).otherwise(rate)


def forecast_fee(base: Column, vfc: Column, bin_step: Column, sigma_bps: Column, kappa: float) -> Column:
    """The fee as a fraction that a forecast volatility implies: its accumulator equivalent goes through the exact
    fee arithmetic, capped at a tenth."""
    accumulator = F.round(F.sqrt(F.pow(sigma_bps / bin_step, F.lit(2.0)) * kappa) * 10_000.0)
    rate = base.cast("double") + variable_fee_rate(vfc, F.least(accumulator, F.lit(4294967295.0)).cast("long"), bin_step).cast("double")
    return F.least(rate, F.lit(float(MOST_FEE))) / float(FEE_UNIT)


def bin_price(bin_id: Column, bin_step: Column) -> Column:
    """(1 + step / 10 000)^bin as a double; null outside the envelope in which prices resolve."""
    log = bin_id * F.ln(1.0 + bin_step / 10_000.0)
    return F.when(F.abs(log) <= LOGARITHM_REACH, F.pow(1.0 + bin_step / 10_000.0, bin_id.cast("double")))


def bin_of_price(price: Column, bin_step: Column) -> Column:
    return F.round(F.ln(price) / F.ln(1.0 + bin_step / 10_000.0)).cast("long")


def array_index(bin_id: Column, size: int = 70) -> Column:
    """The array that holds a bin: floor division, also below zero."""
    return F.floor(bin_id / F.lit(size)).cast("long")


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Variance of a bar from its four prices."""
    return 0.5 * F.pow(F.ln(high / low), F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(F.ln(close / open_), F.lit(2.0))


def daily_variance(variance_5m: Column, autocorrelations: list[Column]) -> Column:
    """288 five-minute variances with autocorrelation, at least half of the plain sum."""
    plain = variance_5m * 288
    adjusted = plain * (1 + 2 * sum(autocorrelations, F.lit(0.0)))
    return F.greatest(adjusted, plain * 0.5)


def decay_window_bps(sigma_daily: Column, seconds: int) -> Column:
    return sigma_daily * math.sqrt(seconds / 86400) * 10_000


def lvr(sigma_daily: Column, value: Column, half_width: Column) -> Column:
    return F.try_divide(sigma_daily * sigma_daily * value, 2 * half_width)


def impermanent_loss(move: Column, value: Column, half_width: Column) -> Column:
    return F.try_divide(value * move * move, 2 * half_width)


def range_width(sigma_daily: Column, horizon_days: Column) -> Column:
    return 1.5 * sigma_daily * F.sqrt(horizon_days)


def range_bins(width: Column, step: Column) -> Column:
    """At least ten bins; ten too where the width is not finite."""
    bins = F.ceil(F.try_divide(width, step))
    return F.when(F.isnan(width) | width.isNull(), F.lit(10)).otherwise(F.greatest(bins, F.lit(10))).cast("long")


def exit_time(half_width: Column, sigma_daily: Column, trigger: float = 1.0) -> Column:
    """Expected days until a driftless price leaves a range that it starts in the middle of, or reaches the given
    part of its half-width; null without volatility."""
    return F.try_divide(F.pow(trigger * half_width, F.lit(2.0)), F.pow(sigma_daily, F.lit(2.0)))


def phi_mechanical(sigma_daily: Column, step: Column, liquidity: Column, fill: Column, volume_24h: Column) -> Column:
    """Share of volume that is not mechanical arbitrage, within 0 and 1."""
    share = 1 - F.pow(sigma_daily / step, F.lit(2.0)) * F.try_divide(liquidity * fill, volume_24h)
    return F.when(volume_24h <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def phi_blend(phi_time: Column, trades: Column, phi_mech: Column, phi_size: Column) -> Column:
    """Timing gets up to half of the weight, growing to 200 trades; the other two share the rest 6 to 4."""
    weight = F.when(phi_time.isNull(), F.lit(0.0)).otherwise(0.5 * F.least(F.lit(1.0), trades / 200))
    return weight * F.coalesce(phi_time, F.lit(0.0)) + (1 - weight) * (0.6 * phi_mech + 0.4 * phi_size)


def shrink(observed: Column, trades: Column, variance: float, prior: float, prior_variance: float) -> Column:
    """Towards the class prior, the less the more trades; without trades the prior itself."""
    own = F.try_divide(F.lit(variance), trades.cast("double"))
    return F.when(trades <= 0, F.lit(prior)).otherwise(own / (own + prior_variance) * prior + prior_variance / (own + prior_variance) * observed)


def r_ratio(fee: Column, turnover: Column, geometry: Column, protocol_share: Column, sigma_daily: Column) -> Column:
    return F.coalesce(F.try_divide(2 * fee * turnover * geometry * (1 - protocol_share), sigma_daily * sigma_daily), F.lit(0.0))


def fee_yield(protocol_share: Column, fee: Column, turnover: Column, jit: Column) -> Column:
    return (1 - protocol_share) * fee * turnover * (1 - jit)


def self_dilution_cap(liquidity: Column, protocol_share: Column, fee: Column, turnover: Column, annual_hurdle: float) -> Column:
    return liquidity * (F.sqrt((1 - protocol_share) * fee * turnover / (annual_hurdle / 365)) - 1)


def quarter_kelly(mu_fee: Column, mu_arb: Column, sigma: Column) -> Column:
    return F.try_divide(mu_fee - mu_arb, F.pow(0.5 * 1.3 * sigma, F.lit(2.0))) / 4


def capped_size(caps: list[Column], least: Column) -> Column:
    """The tightest cap, or null below the minimum."""
    size = F.least(*caps)
    return F.when(size >= least, size)


def is_weekend(t: Column) -> Column:
    """Saturday or Sunday, UTC, of epoch seconds (day 0 was a Thursday)."""
    return F.pmod(F.floor(t / F.lit(86400)) + 3, F.lit(7)) >= 5


def scaled(raw: Column, decimals: Column) -> Column:
    """raw / 10^decimals."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals)


def fee_share(lower: Column, bin_id: Column, upper: Column, fees: Column, size: Column, liquidity: Column) -> Column:
    inside = bin_id.between(lower, upper) & (size > 0) & (fees > 0)
    return F.when(inside, F.try_divide(fees * size, size + liquidity)).otherwise(F.lit(0.0))
