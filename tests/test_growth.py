"""Steps whose work must grow no faster than their input or their result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tidepool.functions import prices
from tidepool.operators import enrich, ledger


def rows_of(df, kind: str, metric: str = "numOutputRows") -> list[int]:
    """The rows given (or another metric) by each operator of a kind in the plan that df ran with."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        rows = node.metrics().get(metric)
        if kind in name and rows.isDefined():
            out.append(rows.get().value())
    return out


def test_positions_meet_bins_and_not_their_states(spark):
    states = spark.range(4000).select(F.lit("p").alias("pool"), (F.col("id") % 4).cast("int").alias("bin_id"), F.col("id").alias("t"), (F.col("id") * 2).alias("fee_per_share"))
    positions = spark.createDataFrame([(1, "p", 0, 1, 3), (1, "p", 2, 3, 1), (2, "p", 3, 9, 2), (3, "q", 0, 9, 1)], "position_id int, pool string, lower_bin int, upper_bin int, shares int")
    out = ledger.true_fees(positions, states)
    # every bin grows by 2 * 3996; rows that share a position_id count each by its own bins and shares
    assert {r.position_id: r.fees for r in out.collect()} == {1: 7992 * 2 * 3 + 7992 * 2, 2: 7992 * 2}
    joined = rows_of(out, "Join")
    assert joined and max(joined) <= 5


def test_marks_are_not_shuffled(spark):
    prices = spark.range(3000).select(F.lit("p").alias("pool"), (F.col("id") * 100).alias("t"), F.lit(2).cast("decimal(18,8)").alias("price"), (F.col("id") % 5).cast("int").alias("bin_id"))
    positions = spark.createDataFrame([(i, "p", 1, 3) for i in range(20)], "position_id int, pool string, lower_bin int, upper_bin int")
    flows = spark.createDataFrame([(i, 100_000 * i, 1) for i in range(20)], "position_id int, t long, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    out = ledger.valuations(positions, flows, prices)
    rows = out.collect()
    assert len(rows) == 60_000
    assert all(r.hold_value == (2 if r.t >= 100_000 * r.position_id else 0) and r.in_range == (1 <= r.t // 100 % 5 <= 3) for r in rows)
    shuffled = rows_of(out, "Exchange", "shuffleRecordsWritten")
    assert shuffled and max(shuffled) <= 3000


def test_deposits_held_at_a_price(spark):
    positions = spark.createDataFrame([(1, "p", 0, 1), (2, "p", 0, 1), (None, "p", 0, 1), (3, "q", 0, 1)], "position_id int, pool string, lower_bin int, upper_bin int")
    flows = spark.createDataFrame([(1, 100, 5), (1, 100, 1), (1, 90_000, 3), (1, None, 70), (1, 50, None), (None, 10, 9), (8, 10, 9)], "position_id int, t long, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    prices = spark.createDataFrame([("p", 99), ("p", 100), ("p", 89_999), ("p", 90_000), ("p", 900_000), ("p", None), ("r", 5)], "pool string, t long").withColumns({"price": F.lit(1).cast("decimal(18,8)"), "bin_id": F.lit(0)})
    got = {(r.position_id, r.t): r.hold_value for r in ledger.valuations(positions, flows, prices).collect()}
    times = [99, 100, 89_999, 90_000, 900_000, None]
    assert got == {(1, t): v for t, v in zip(times, [0, 6, 6, 9, 9, 0], strict=True)} | {(k, t): 0 for k in (2, None) for t in times}


def test_marks_of_sparse_prices_are_not_dealt_by_day(spark):
    """One price a day for 1200 days, and forty positions with a deposit in between."""
    prices = spark.range(1200).select(F.lit("p").alias("pool"), (F.col("id") * 86_400 + 5).alias("t"), F.lit(2).cast("decimal(18,8)").alias("price"), F.lit(0).alias("bin_id"))
    positions = spark.createDataFrame([(i, "p", 0, 1) for i in range(40)], "position_id int, pool string, lower_bin int, upper_bin int")
    flows = spark.createDataFrame([(i, 86_400 * 25 * i + 5, i + 1) for i in range(40)], "position_id int, t long, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    out = ledger.valuations(positions, flows, prices)
    rows = out.collect()
    assert len(rows) == 48_000
    assert all(r.hold_value == (2 * (r.position_id + 1) if r.t >= 86_400 * 25 * r.position_id + 5 else 0) for r in rows)
    assert max(rows_of(out, "Exchange", "shuffleRecordsWritten")) <= 1200


def test_marks_of_equal_deposits_are_written_together(spark, tmp_path):
    prices = spark.range(4000).select(F.lit("p").alias("pool"), (F.col("id") * 500).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10**7).cast("decimal(18,8)").alias("price"), (F.col("id") % 90).cast("int").alias("bin_id"))
    positions = spark.range(200).select(F.col("id").alias("position_id"), F.lit("p").alias("pool"), F.lit(0).alias("lower_bin"), F.lit(50).alias("upper_bin"))
    flows = spark.range(200).select(F.col("id").alias("position_id"), F.lit(-1).cast("long").alias("t"), (F.col("id") % 4 + 0.37).cast("decimal(18,2)").alias("amount"))
    out = ledger.valuations(positions, flows, prices).withColumns({c: F.col(c).cast("double") for c in ("price", "hold_value")})
    out.write.parquet(str(tmp_path / "marks"))
    assert spark.read.parquet(str(tmp_path / "marks")).count() == 800_000
    # a double of its own for each mark would be 8 bytes
    assert sum(f.stat().st_size for f in (tmp_path / "marks").glob("*.parquet")) < 2 * 800_000


@pytest.mark.parametrize(("most", "few"), [(2000, 50), (40, 10), (6, 2), (1, 1)])
def test_marks_are_whole_however_prices_are_cut(spark, most, few):
    day, n = 86_400, 30
    prices = [(pool, t, 1 + t % 7, t % 5) for pool in "pq" for t in sorted({(k * k * 37_777) % (12 * day) - 3 * day for k in range(60)})] + [("p", None, 3, 1), ("p", 2 * day, 3, 1), ("p", 2 * day + 1, 4, 2)]
    prices = sorted({(pool, t): (pool, t, price, b) for pool, t, price, b in prices}.values(), key=str)
    flows = [(k % n if k % n != 4 else None, (k * 7919 * 31) % (14 * day) - 4 * day, k % 9 + 1) for k in range(70)] + [(1, 2 * day, 5), (1, 2 * day, 6), (2, None, 50), (3, day, None), (5, day, 2), (5, day + 1, 3)]
    positions = [(k if k != 6 else None, "pqr"[k % 3], k % 3, 3) for k in range(n)] + [(8, "r", 0, 1), (9, "p", 2, 4)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    out = ledger.valuations(
        frame(positions, "position_id int, pool string, lower_bin int, upper_bin int"), frame(flows, "position_id int, t long, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)")),
        frame(prices, "pool string, t long, price int, bin_id int").withColumn("price", F.col("price").cast("decimal(18,8)")), most, few,
    )
    sum_at = lambda p, t: sum(a or 0 for i, s, a in flows if None not in (i, s, t) and i == p and s <= t)
    want = [(p, t, price, low <= b <= high, sum_at(p, t) * price) for p, pool, low, high in positions for of, t, price, b in prices if of == pool]
    assert sorted(((r.position_id, r.t, int(r.price), r.in_range, int(r.hold_value)) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_price_is_made_once_for_each_bin_and_step(spark):
    rows = spark.range(600).select("id", (F.col("id") % 7 - 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3 * 50).alias("b"), F.when(F.col("id") % 11 > 0, F.col("id") % 2 + 20).cast("int").alias("bin_step"))
    out = enrich.with_prices(rows, {"p": "a", "q": "b"}, rows)
    pairs = [(a, s) for a in (-3, -2, -1, 0, 1, 2, 3, 50, 100) for s in (20, 21)]
    want = {(r.b, r.s): r.p for r in spark.createDataFrame(pairs, "b long, s int").select("b", "s", prices.exact_price(F.col("b"), F.col("s")).alias("p")).collect()}
    got = out.collect()
    assert len(got) == 600
    assert all((r.p, r.q) == (want.get((r.a, r.bin_step)), want.get((r.b, r.bin_step))) for r in got)
    assert max(rows_of(out, "Scan parquet")) == len(pairs)


@pytest.mark.parametrize("name", ["exact_bin_prices", "proposed_ranges"])
def test_plans_of_prices_hold_no_products(spark, name):
    assert "aggregate(" not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
