"""The rollup chain's golden case, absent against zero, and exact medians."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tidepool.operators import rollup

T0 = 1711929600  # 2024-04-01


@pytest.fixture(scope="module")
def tables(spark):
    d = Decimal
    swaps = spark.createDataFrame(
        [("p", T0 + 60, 1, "a", False, d("1.50"), d(1000), d(3000)), ("p", T0 + 180, 2, "b", True, d("1.55"), d(500), d(1500)), ("p", T0 + 420, 3, "a", True, d("1.60"), d(300), d(900)), ("idle", T0 + 30, 4, "z", True, d(1), d(5), d(1))],
        "pool string, t long, event_id long, signer string, swap_for_y boolean, price decimal(18,8), volume_usd decimal(18,4), fee_milli decimal(24,4)",
    )
    snapshots = spark.createDataFrame(
        [("p", T0 + 120, 1, d(1000000), d(45000), 100, 1), ("p", T0 + 270, 2, d(1000000), d(50000), 100, 2), ("p", T0 + 570, 3, d(1010000), d(51000), 105, 3)],
        "pool string, t long, event_id long, tvl decimal(24,4), active_tvl decimal(18,4), active_bin int, va int",
    )
    liquidity = spark.createDataFrame([("p", T0 + 120, 1, 1, 0, d(2000)), ("p", T0 + 420, 2, 1, 1, d(500))], "pool string, t long, event_id long, owner long, action int, amount_usd decimal(18,4)")
    return swaps, snapshots, liquidity


def test_five_minutes(tables):
    a, b = rollup.bars(*tables, 300).orderBy("bucket").collect()
    assert (a.volume, a.fee_milli, a.swap_count, a.unique_traders) == (1500, 4500, 2, 2)
    assert [float(x) for x in (a.open, a.high, a.low, a.close)] == [1.5, 1.55, 1.5, 1.55]
    assert (a.tvl_close, a.active_bin_open, a.active_bin_close, a.net_deposit, a.add_count, a.remove_count) == (1000000, 100, 100, 2000, 1, 0)
    assert (b.volume, b.swap_count, b.unique_traders, float(b.open), float(b.close)) == (300, 1, 1, 1.6, 1.6)
    assert (b.active_bin_close, b.net_deposit, b.add_count, b.remove_count) == (105, -500, 0, 1)


def test_ten_minutes_come_from_raw_rows(tables):
    (a,) = rollup.bars(*tables, 600).collect()
    assert (a.volume, a.swap_count, a.unique_traders, a.net_deposit, a.tvl_close, a.active_bin_close) == (1800, 3, 2, 1500, 1010000, 105)


@pytest.mark.parametrize("upto", ["1h", "4h", "24h"])
def test_coarser_bars(tables, upto):
    (a,) = rollup.chain(*tables, upto).collect()
    assert (a.pool, a.volume, a.swap_count, a.tvl_close, float(a.open), float(a.high), float(a.low), float(a.close)) == ("p", 1800, 3, 1010000, 1.5, 1.6, 1.5, 1.6)


def test_no_snapshot_no_bar_and_no_swap_is_null(tables):
    swaps, snapshots, liquidity = tables
    assert rollup.bars(swaps, snapshots, liquidity, 300).filter("pool = 'idle'").count() == 0
    (a,) = rollup.bars(swaps.filter("false"), snapshots.limit(1), liquidity.filter("false"), 300).collect()
    assert a.volume is None and a.swap_count is None and a.add_count is None


def test_quiet_bars_do_not_hide_prices(spark, tables):
    swaps, snapshots, liquidity = tables
    bars = rollup.bars(swaps.filter("event_id = 3"), snapshots, liquidity, 300)
    (a,) = rollup.coarser(bars, 3600).collect()
    assert float(a.open) == 1.6 and a.va_close == 3


def test_median_is_exact(spark):
    values = [Decimal("1"), Decimal("500000.1234"), Decimal("1000000")]
    rows = spark.createDataFrame([("p", T0 + i, i, v) for i, v in enumerate(values)] + [("p", T0 + 9, 9, None)], "pool string, t long, event_id long, active_tvl decimal(18,4)")
    found = rollup.trailing_median(rows, 300).filter(f"bucket = {T0}").first()
    assert found.active_tvl_median == Decimal("500000.1234")


def test_empty_tables(tables):
    empty = [t.filter("false") for t in tables]
    assert rollup.chain(*empty, "24h").count() == 0
