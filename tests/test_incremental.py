"""Runs that go on from stored states against one run over everything, and replaced partitions after broken runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidepool.operators import incremental, pipeline, windows
from tidepool.plans import trading
from tidepool.sources import tables
from tidepool.sources.adapters import Tables

CFG = pipeline.Config()
SHOWN = ("pool", "bucket", "regime", "regime_before", "gated", "attractive", "fast", "slow", "sigma_d", "history_days", "jump_share", "fee_tvl_7d", "volume_trend", "r_org", "phi_org", "since", "pending", "pending_since", "last", "rationale")


def shown(df):
    return sorted((tuple(repr(r[c]) for c in SHOWN) for r in df.collect()), key=str)


@pytest.mark.parametrize("tf", ["1h", "5m"])
def test_runs_over_parts_equal_one_run(spark, tmp_path, tf, monkeypatch):
    t = Tables(spark, SF)
    bars = trading.written(trading.scoring_bars(t, tf), "bars")
    evaluate = lambda b, s, since: trading.evaluated_bars(t, tf, b, s, since)
    last = bars.agg(F.max("bucket")).first()[0]
    first = bars.agg(F.min("bucket")).first()[0]
    for until in (first + (last - first) // 3, first + (last - first) // 2, last):
        incremental.run_once(bars, str(tmp_path / "t"), until, evaluate)
    found = tables.read(spark, str(tmp_path / "t/rows"))
    assert shown(found) == shown(evaluate(bars, incremental.no_states(spark), None)) and found.count() == bars.count()
    incremental.run_once(bars, str(tmp_path / "t"), last, evaluate)  # nothing new
    assert tables.read(spark, str(tmp_path / "t/rows")).count() == bars.count()


def test_a_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    t = Tables(spark, SF)
    bars = trading.written(trading.scoring_bars(t, "4h"), "bars")
    evaluate = lambda b, s, since: trading.evaluated_bars(t, "4h", b, s, since)
    first, last = bars.agg(F.min("bucket"), F.max("bucket")).first()
    where = str(tmp_path / "t")
    incremental.run_once(bars, where, (first + last) // 2, evaluate)
    with monkeypatch.context() as broken:
        broken.setattr(tables, "store", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            incremental.run_once(bars, where, (first + 3 * last) // 4, evaluate)  # rows are in, the states are not
    incremental.run_once(bars, where, last, evaluate)
    assert shown(tables.read(spark, f"{where}/rows")) == shown(evaluate(bars, incremental.no_states(spark), None))


def test_states_keep_pending_candidates_and_clocks(spark):
    """A candidate that waits at the end of a run is committed by the next one on time."""
    fields = "pool string, bucket long, sigma_gk double, sufficient boolean, dev_peg double, age_days double, pegged boolean, major boolean, kill boolean"
    rows = [("p", m * 60, 0.0004 if m < 60 else 0.5, True, None, 60.0, False, True, m == 95) for m in range(0, 400, 7)] + [("q", 0, None, False, None, None, False, False, False)]
    df = spark.createDataFrame(rows, fields)
    whole = incremental.folded(df, incremental.no_states(spark), CFG, 60)
    states, out = incremental.no_states(spark), []
    for a, b in ((-1, 10), (10, 90), (90, 95), (95, 1000)):
        part = incremental.folded(df.filter((F.col("bucket") > a * 60) & (F.col("bucket") <= b * 60)), states, CFG, 60)
        out += part.collect()
        states = spark.createDataFrame(incremental.states_after(part, states).collect(), incremental.STATE)
    key = lambda rows: sorted(map(repr, rows))
    assert key(out) == key(whole.collect()) and {r.regime for r in out if r.pool == "p"} >= {None, "V1", "V2"}
    assert states.count() == 2 and incremental.folded(df, states, CFG, 60).count() == 0


def test_fold_equals_the_columns_form(spark):
    fields = "pool string, bucket long, sigma_gk double, sufficient boolean, dev_peg double, age_days double, pegged boolean, major boolean, kill boolean"
    rows = [(p, i * 600, 1e-5 if i < 60 else 0.02 if i < 90 else 1e-4, i > 5, (i % 9) / 1000 if k else None, 20.0 + i / 10, k == 1, k > 0, i % 61 == 60) for k, p in enumerate("abc") for i in range(150)]
    df = spark.createDataFrame(rows, fields)
    ours = incremental.folded(df, incremental.no_states(spark), CFG, 600)
    averaged = windows.ewma(windows.ewma(df, "sigma_gk", CFG.fast, "f"), "sigma_gk", CFG.slow, "s").withColumns({"sigma_fast": F.sqrt("f"), "sigma_slow": F.sqrt("s")})
    theirs = {(r.pool, r.bucket): (r.regime, r.regime_item.signal, round(r.regime_item.observed, 9), r.regime_item.passed) for r in pipeline.regimes(averaged, CFG, 600).collect()}
    found = {(r.pool, r.bucket): (r.regime, r.item_signal, round(r.item_observed, 9), r.item_passed) for r in ours.collect()}
    assert found == theirs and len({v[0] for v in found.values()}) >= 3


def test_trailing_autocorrelations(spark):
    import numpy as np

    r = np.sin(np.arange(90.0) ** 1.3) / 50 + 0.001
    rows = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate(r)], "pool string, bucket long, r double")
    for found in windows.trailing_autocorrelations(rows, 41).collect():
        x = r[max(0, found.bucket - 39) : found.bucket + 1]
        for k in range(1, 7):
            if len(x) < 20:
                assert found[f"rho_{k}"] is None
            else:
                m = x - x.mean()
                assert found[f"rho_{k}"] == pytest.approx((m[k:] * m[:-k]).sum() / (len(x) - k) / (m * m).mean(), abs=1e-9)


def test_partitions_are_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "day long, v string")
    rows = lambda: sorted((r.day, r.v) for r in tables.read(spark, path).collect())
    assert tables.read(spark, path) is None
    tables.replace(frame([(1, "a"), (2, "b")]), path, ["day"])
    tables.replace(frame([(2, "c"), (3, "d")]), path, ["day"])
    assert rows() == [(1, "a"), (2, "c"), (3, "d")]
    tables.replace(tables.read(spark, path).filter("day = 3").unionByName(frame([(3, "e")])), path, ["day"])  # from itself
    assert rows() == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]
    moves, move = [], tables.Folder.move

    def fails(self, name, to):
        if moves:
            raise OSError("lost")
        moves.append(to)
        move(self, name, to)

    with monkeypatch.context() as broken:
        broken.setattr(tables.Folder, "move", fails)
        with pytest.raises(OSError, match="lost"):
            tables.replace(frame([(1, "x"), (2, "y")]), path, ["day"])  # one of two is moved
    tables.recover(spark, path, ["day"])
    assert rows() == [(1, "x"), (2, "y"), (3, "d"), (3, "e")]
    with monkeypatch.context() as broken:
        broken.setattr(tables.Folder, "mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            tables.replace(frame([(1, "z")]), path, ["day"])  # not whole
    tables.recover(spark, path, ["day"])
    assert rows() == [(1, "x"), (2, "y"), (3, "d"), (3, "e")]
    for v in (1, 2, 3):
        tables.store(frame([(v, "s")]), str(tmp_path / "s"), v)
    found, version = tables.newest(spark, str(tmp_path / "s"))
    assert version == 3 and found.first().day == 3 and tables.newest(spark, str(tmp_path / "none")) is None
