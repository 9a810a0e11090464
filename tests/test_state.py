"""Folds, windows and gates on small histories."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidepool.operators import pipeline, ranking, windows
from tidepool.operators.mixture import organic_share
from tidepool.sources import sinks

CFG = pipeline.Config()


def observations(spark, rows):
    fields = "pool string, bucket long, sigma_slow double, sigma_fast double, sufficient boolean, dev_peg double, age_days double, pegged boolean, major boolean, kill boolean"
    return spark.createDataFrame(rows, fields)


def regimes(spark, slow_by_minute, kill=()):
    rows = [("p", m * 60, s, s, True, None, 60.0, False, True, m in kill) for m, s in slow_by_minute.items()]
    return {r.bucket // 60: r.regime for r in pipeline.regimes(observations(spark, rows), CFG, 60).collect()}


def test_a_candidate_needs_thirty_minutes(spark):
    assert regimes(spark, {0: 0.02, 29: 0.02})[29] is None
    assert regimes(spark, {0: 0.02, 29: 0.02, 31: 0.02})[31] == "V1"


def test_cooldown_blocks_a_second_flip(spark):
    found = regimes(spark, {0: 0.02, 31: 0.02, 40: 0.09, 100: 0.09, 152: 0.09})
    assert (found[31], found[100], found[152]) == ("V1", "V1", "V2")


def test_kill_switch_commits_at_once(spark):
    assert regimes(spark, {0: 0.02, 31: 0.02, 40: 0.09}, kill={40})[40] == "V2"


def test_leaving_needs_more_than_entering(spark):
    found = regimes(spark, {0: 0.09, 31: 0.09, 200: 0.06, 300: 0.06, 400: 0.04, 500: 0.04})
    assert (found[31], found[300], found[500]) == ("V2", "V2", "V1")


def test_ewma_is_the_recurrence_also_over_blocks(spark):
    xs = [math.sin(i) ** 2 for i in range(500)]
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(xs)], "pool string, bucket long, x double")
    for most in (20_000, 100):
        got = {r.bucket: r.v for r in windows.ewma(rows, "x", 0.8, "v", most).collect()}
        v = 0.0
        for i, x in enumerate(xs):
            v = 0.8 * v + 0.2 * x
            assert got[i] == pytest.approx(v, rel=1e-9)


def test_jump_share_of_alternating_returns(spark):
    closes = [math.exp(0.01 * (i % 2)) for i in range(9)]
    bars = spark.createDataFrame([("p", i, c) for i, c in enumerate(closes)], "pool string, bucket long, close double")
    last = windows.realised(windows.log_returns(bars), 8).orderBy(F.desc("bucket")).first()
    assert last.jump_share == 0.05


def test_null_closes_and_zero_prices_give_no_return(spark):
    bars = spark.createDataFrame([("p", 1, 1.0), ("p", 2, None), ("p", 3, 2.0), ("p", 4, 0.0), ("p", 5, 3.0)], "pool string, bucket long, close double")
    assert [r.bucket for r in windows.log_returns(bars).collect()] == [3]


def test_cooldown_and_gaps(spark):
    times = [0, 100, 3600, 3700, 7300, 7300]
    signals = spark.createDataFrame([("p", "k", t, i) for i, t in enumerate(times)], "pool string, kind string, t long, event_id long")
    assert sorted(r.t for r in windows.cooled(signals, ["pool", "kind"], 3600).collect()) == [0, 3600, 7300]
    arrivals = spark.createDataFrame([("s", i, x) for i, x in enumerate([5, 5, 7, 6, 8, 12])], "stream string, arrival long, slot long")
    for piece in (1, 2, 1000):
        assert sorted(tuple(r) for r in windows.slot_gaps(arrivals, piece).collect()) == [("s", 5, 7, 1), ("s", 8, 12, 3)]


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_pieces_of_a_history_carry_over(spark, piece):
    """Sums, states before and as-of values are those of one ordered history, however it is cut, with nulls."""
    xs = [None, 1, 1, None, None, 2, 2, 5, None, 5]
    rows = [(p, t, t, x) for p in ("p", None) for t, x in zip([0, 1, 1, 2, 6, 7, 20, 21, 40, 41], xs, strict=True)]
    rows = [(p, t, i, x) for i, (p, t, _, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "pool string, t long, event_id long, x int")
    sums = {r.event_id: r.total for r in windows.running_sum(df, ["pool"], ["t", "event_id"], "x", "total", piece).collect()}
    before = {r.event_id: r["__before"] for r in windows.with_state_before(df, ["pool"], ["t", "event_id"], ["x"], piece).collect()}
    assert len(sums) == len(before) == 20
    for start in (0, 10):
        for i in range(10):
            known = [x for x in xs[: i + 1] if x is not None]
            assert sums[start + i] == (sum(known) if known else None)
            assert (before[start + i].x if i else before[start]) == (xs[i - 1] if i else None)
    points = spark.createDataFrame([("p", -5, 1), ("p", 1, 2), ("p", 6, 3), ("p", 39, 4), ("p", 500, 5), ("p", None, 6), ("q", 3, 7)], "pool string, t long, point_id long")
    history = df.filter("event_id not in (1, 8) and pool = 'p'").unionByName(spark.createDataFrame([("p", None, 99, 7)], df.schema))
    found = {r.point_id: (r.x, r.seen) for r in ranking.as_of(points, history.select("pool", "t", "x"), "x", piece).collect()}
    assert found == {1: (None, None), 2: (1, 1), 3: (None, 6), 4: (5, 21), 5: (5, 41), 6: (None, None), 7: (None, None)}


def test_exits_look_back_on_ninety_six_hours(spark):
    hour = 3600
    low = lambda h: h not in (3, 120)
    rows = [("p", h * hour, 0.1 if low(h) else 5.0, 9.0, "V1", 60.0, 1.0) for h in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "pool string, bucket long, r_org double, vol_tvl double, regime string, age_days double, volume_trend double")
    found = {r.bucket // hour: {i.signal: i.observed for i in r.exit_items} for r in pipeline.exits(df, CFG).collect()}
    below = {h: x["r_org_exit_persistence_hours"] for h, x in found.items()}
    assert (below[0], below[3], below[6], below[99], below[102], below[117], below[120], below[123], below[150], below[297]) == (0, 0, 0, 93, 96, 96, 0, 0, 27, 96)
    assert all(x["vol_tvl_exit_persistence_hours"] == 0 for x in found.values())


def test_risk_gate_records_every_check(spark):
    row = pipeline.with_risk_inputs(spark.createDataFrame([("V2", 10.0, 1.0)], "regime string, age_days double, mint_authority double"))
    items = row.select(pipeline.risk_items(CFG).alias("i")).first().i
    assert len(items) == 16 and [i.signal for i in items if not i.passed] == ["mint_authority_null"]
    clean = pipeline.with_risk_inputs(spark.createDataFrame([("V1", 10.0)], "regime string, age_days double"))
    items = clean.select(pipeline.risk_items(CFG).alias("i")).first().i
    assert len(items) == 15 and all(i.passed and math.isnan(i.observed) for i in items)


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    for _ in range(2):
        sinks.append_new(batch, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_appends_read_the_partitions_of_their_days_only(spark, tmp_path):
    path, day = str(tmp_path / "t"), 86_400
    first = spark.createDataFrame([(1, 5, "a"), (2, day + 5, "b"), (3, 9 * day, "c")], "id int, t long, v string")
    second = spark.createDataFrame([(2, day + 5, "x"), (4, day + 6, "d"), (4, day + 6, "d")], "id int, t long, v string")
    for batch in (first, second, first, second):
        sinks.append_new(batch, path, ["id", "t"], time="t")
    table = spark.read.parquet(path)
    assert sorted((r.id, r.day, r.v) for r in table.collect()) == [(1, 0, "a"), (2, 1, "b"), (3, 9, "c"), (4, 1, "d")]
    batch = second.withColumn("day", F.floor(F.col("t") / day))
    plan = sinks.new_rows(batch, sinks.of_days(table, batch), ["id", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day" in plan.split("PartitionFilters")[1][:80]


def test_retention_drops_whole_days_by_policy(spark, tmp_path):
    from tidepool.sources import tables

    day = 86_400
    for name in ("swaps", "bins", "kept"):
        spark.createDataFrame([(d, d * day + 5) for d in range(10)], "day long, t long").write.partitionBy("day").parquet(str(tmp_path / name))
    policy = spark.createDataFrame([("swaps", 7), ("bins", 2), ("none", 1)], "table string, days int")
    for want in ([f"bins/day={d}" for d in range(7)] + ["swaps/day=0", "swaps/day=1"], []):
        assert sinks.retire(spark, str(tmp_path), policy, 9 * day + 100) == want
    left = {n: sorted(r.day for r in tables.read(spark, str(tmp_path / n)).select("day").distinct().collect()) for n in ("swaps", "bins", "kept")}
    assert left == {"swaps": list(range(2, 10)), "bins": [7, 8, 9], "kept": list(range(10))}


def test_one_quote_token_of_many_swaps(spark):
    """Prices as of each swap, whatever the pieces are, with one token that holds all swaps."""
    from tidepool.operators import enrich

    swaps = spark.createDataFrame([("T", i * 37 % 9000) for i in range(300)] + [("U", 5)], "token_y string, t long")
    quotes = [("T", i * 211, float(i)) for i in range(2, 40)]
    prices = spark.createDataFrame([*quotes, ("U", 6, 1.0)], "mint string, t long, usd double")
    for piece in (1, 300, 100_000):
        for r in enrich.quoted(swaps, prices, piece).collect():
            seen = [usd for m, t, usd in quotes if m == r.token_y and t <= r.t]
            assert r.quote_usd == (seen[-1] if seen else None)


def test_parts_are_completed_by_a_second_run(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, v string, x double")
    parts = {str(tmp_path / "one"): ["id", "v"], str(tmp_path / "two"): ["id", "x"]}
    sinks.append_new(batch.select("id", "v").limit(1), str(tmp_path / "one"), ["id"])  # a run that broke off
    for _ in range(2):
        sinks.append_parts(batch, parts, ["id"])
    assert [spark.read.parquet(p).count() for p in parts] == [2, 2]


def test_merge_rules(spark):
    old = spark.createDataFrame([("a", 1, None, 5), ("b", 1, 7, 5)], "pool string, tier int, first int, step int")
    new = spark.createDataFrame([("a", 0, 3, 6), ("b", 0, 9, 6), ("c", 0, 1, 6)], "pool string, tier int, first int, step int")
    assert sorted(tuple(r) for r in sinks.merged(old, new, ["pool"], ["tier"], ["first"]).collect()) == [("a", 1, 3, 6), ("b", 1, 7, 6), ("c", 0, 1, 6)]


def test_mixture_finds_the_small_component(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.exponential(1.0, 3000), rng.exponential(200.0, 1000)])
    rows = spark.createDataFrame([("p", float(x)) for x in sizes] + [("few", 1.0)], "pool string, size double")
    found = {r.pool: r.phi_size for r in organic_share(rows).collect()}
    assert found["p"] == pytest.approx(0.75, abs=0.03) and found["few"] is None
