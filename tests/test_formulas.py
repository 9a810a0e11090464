"""Hand-checked values of the formulas, overflow, and non-finite inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepool.functions import checks, scalar


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


CASES = [
    (lambda: scalar.garman_klass(*lit(100, 110, 95, 105)), 0.00982672327557351, 1e-12),
    (lambda: scalar.decay_window_bps(F.lit(0.18), 600), 150.0, 1e-6),
    (lambda: scalar.phi_mechanical(*lit(2e-4, 1e-4, 800_000, 0.75, 25_000_000)), 0.904, 1e-9),
    (lambda: scalar.phi_mechanical(*lit(0.18, 0.01, 12_000, 0.5, 4_500_000)), 0.568, 1e-9),
    (lambda: scalar.phi_blend(*lit(0.88, 200, 0.90, 0.93)), 0.896, 1e-9),
    (lambda: scalar.phi_blend(F.lit(None).cast("double"), *lit(0, 0.57, 0.66)), 0.606, 1e-9),
    (lambda: scalar.range_width(F.lit(0.18), F.lit(0.5)), 0.190919, 1e-6),
    (lambda: scalar.range_bins(F.lit(0.190919), F.lit(0.01)), 20, 0),
    (lambda: scalar.range_bins(F.lit(1e-9), F.lit(0.01)), 10, 0),
    (lambda: scalar.range_bins(F.lit(float("nan")), F.lit(0.01)), 10, 0),
    (lambda: scalar.base_fee_rate(F.lit(10000), F.lit(25), F.lit(0)).cast("long"), 2_500_000, 0),
    (lambda: scalar.variable_fee_rate(F.lit(40000), F.lit(30000), F.lit(100)).cast("long"), 3_600_000, 0),
    (lambda: scalar.variable_fee_rate(F.lit(0), F.lit(30000), F.lit(100)).cast("long"), 0, 0),
    (lambda: scalar.array_index(F.lit(-71)), -2, 0),
    (lambda: scalar.bin_of_price(scalar.bin_price(F.lit(-1234), F.lit(25)), F.lit(25)), -1234, 0),
    (lambda: scalar.capped_size(lit(90000, 50000, 70000), F.lit(1000.0)), 50000, 0),
]


@pytest.mark.parametrize("make, want, within", CASES)
def test_value(value, make, want, within):
    assert value(make()) == pytest.approx(want, abs=max(within, 1e-12))


@pytest.mark.parametrize("make", [
    lambda: scalar.bin_price(F.lit(400_000), F.lit(100)),
    lambda: scalar.capped_size(lit(500, 7000), F.lit(1000.0)),
    lambda: scalar.lvr(*lit(0.1, 100, 0)),
    lambda: scalar.base_fee_rate(F.lit(10**18), F.lit(10**9), F.lit(19)),
])
def test_null(value, make):
    assert value(make()) is None


def test_gates_fail_on_what_was_not_measured(value):
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    assert value(checks.check("x", nan, ">=", 1.0)["passed"]) is False
    assert value(checks.check("x", none, "<=", 1.0)["passed"]) is False
    assert value(checks.optional("x", none, "<=", 1.0)["passed"]) is True
    assert value(checks.as_text(checks.optional("x", none, "<=", 1.0))) == "x not measured <= 1.0"


def test_weekend(value):
    assert value(scalar.is_weekend(F.lit(1712361600))) is True  # a Saturday
    assert value(scalar.is_weekend(F.lit(1712534400))) is False  # a Monday
