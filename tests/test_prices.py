"""Exact bin prices against Python's integers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tidepool.functions import prices, scalar

ONE, MOST = 1 << 64, (1 << 128) - 1


def fixed_point(bin_id, step):
    """The price with 64 fractional bits, or None."""
    if bin_id == 0:
        return ONE
    if abs(bin_id) >= 1 << 19:
        return None
    factor, out, n = MOST // (ONE + step * ONE // 10_000), ONE, abs(bin_id)
    while n:
        if n & 1:
            out = out * factor >> 64
        factor, n = factor * factor >> 64, n >> 1
    return None if out == 0 else MOST // out if bin_id > 0 else out


def test_prices_equal_integers(spark):
    rng = random.Random(4)
    steps = [0, 1, 2, 5, 10, 25, 80, 100, 400, 2000, 9999, 10_000, 65_535]
    bins = [0, 1, -1, 2, 3, 69, 70, -70, 443_636, -443_636, 524_287, -524_287, 524_288, -524_288, 10**9]
    rows = [(b, s) for s in steps for b in bins] + [(rng.randint(-9000, 9000), rng.choice(steps)) for _ in range(900)] + [(None, 5), (5, None), (None, None), (7, -1)]
    df = spark.createDataFrame(rows, "bin_id int, bin_step int").withColumn("squares", prices.ladder(F.col("bin_step")))
    got = df.select("bin_id", "bin_step", prices.digits(F.col("bin_id"), F.col("squares")).alias("digits"), prices.price(F.col("bin_id"), F.col("squares")).alias("price")).collect()
    assert len(got) == len(rows)
    known = 0
    for r in got:
        want = fixed_point(r.bin_id, r.bin_step) if None not in (r.bin_id, r.bin_step) and r.bin_step >= 0 else None
        have = None if r.digits is None else sum(d << 32 * (3 - i) for i, d in enumerate(r.digits))
        assert have == want, r
        assert r.price == (None if want is None else want / ONE), r  # Python rounds the quotient of integers once
        known += want is not None
    assert known > 500


def test_prices_on_the_spot_and_near_the_closed_form(spark):
    row = spark.range(1).select(*[prices.exact_price(F.lit(b), F.lit(s)).alias(f"p{i}") for i, (b, s) in enumerate([(100, 20), (-1234, 25), (0, 7)])], scalar.bin_price(F.lit(-1234), F.lit(25)).alias("closed")).first()
    assert abs(row.p0 - 1.002**100) < 1e-12 and row.p2 == 1.0 and abs(row.p1 / row.closed - 1) < 1e-12


def test_prices_of_the_given_pools(spark):
    import __spark_entry__ as entry

    out = entry.queries()["exact_bin_prices"](spark, SF).collect()
    for r in out[:300]:
        want = fixed_point(r.bin_id, r.bin_step)
        assert (r.high, r.low) == ((None, None) if want is None else (str(want >> 64), str(want & (ONE - 1))))
    assert len(out) > 500
