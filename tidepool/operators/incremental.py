"""The indicator pipeline from run to run: a state per pool holds what all bars before have left (averages, regime,
clocks, the first bar), so a run folds new bars only and reads no more than a bounded look-back of older ones."""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import scalar
from tidepool.operators import pipeline, windows
from tidepool.operators.pipeline import Config
from tidepool.sources import tables

#: Bars of a pool before a run's first one that its windows reach back to: seven days of five-minute bars and four more.
LOOKBACK = 2020
DAY = 86_400

_NAMES = ("first_seen", "fast", "slow", "regime", "since", "pending", "pending_since", "last", "seen")
STATE = "pool string, first_seen long, fast double, slow double, regime string, since long, pending string, pending_since long, last long, seen long"
_ITEM = "item_signal string, item_observed double, item_threshold double, item_passed boolean"
FOLDED = f"{STATE}, regime_before string, {_ITEM}"
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def no_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _fold(cfg: Config, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    persistence, cooldown = cfg.persistence / 60.0, cfg.cooldown / 60.0
    schema = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in FOLDED.split(", ")])

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        new = sorted(rows.to_pylist(), key=lambda r: r["bucket"])
        if not new:
            return schema.empty_table()
        pool, first = new[0]["pool"], new[0]
        held = states.to_pylist()
        s = SimpleNamespace(**held[0]) if held else SimpleNamespace(first_seen=first["bucket"], fast=0.0, slow=0.0, regime=None, since=first["bucket"] + width, pending=None, pending_since=None, last=None, seen=None)
        out = []
        for row in new:
            if s.seen is not None and row["bucket"] <= s.seen:
                continue
            t, before, gk = row["bucket"] + width, s.regime, row["sigma_gk"]
            if gk is not None:
                s.fast, s.slow = cfg.fast * s.fast + (1 - cfg.fast) * gk, cfg.slow * s.slow + (1 - cfg.slow) * gk
            number = lambda v: math.nan if v is None else v
            seen = SimpleNamespace(sigma_slow=math.sqrt(max(s.slow, 0.0)), sigma_fast=math.sqrt(max(s.fast, 0.0)), dev_peg=number(row["dev_peg"]), age_days=number(row["age_days"]), pegged=row["pegged"], major=row["major"], sufficient=row["sufficient"])
            found = pipeline.suggested(s.regime, seen, cfg)
            if row["kill"]:
                item, commit = ("regime_kill_switch", 1.0, 1.0, True), True
            elif found == s.regime:
                s.pending = s.pending_since = None
                stable, commit = (t - s.since) / 60.0, False
                item = ("regime_stable_minutes", stable, stable, True)
            else:
                if found != s.pending:
                    s.pending, s.pending_since = found, t
                waited = (t - (t if s.pending_since is None else s.pending_since)) / 60.0
                rested = None if s.last is None else (t - s.last) / 60.0
                cooling = rested is not None and rested < cooldown
                commit = waited >= persistence and not cooling
                item = ("regime_cooldown_minutes", rested, cooldown, False) if waited >= persistence and cooling else ("regime_persistence_minutes", waited, persistence, waited >= persistence)
            if commit:
                s.regime, s.since, s.pending, s.pending_since, s.last = found, t, None, None, t
            s.seen = row["bucket"]
            out.append((pool, *(getattr(s, c) for c in _NAMES), before, *item))
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def folded(rows: DataFrame, states: DataFrame, cfg: Config, width: int) -> DataFrame:
    """pool, bucket, the state after each bar, regime_before and the regime's rationale item, by one fold over each
    pool's new bars from its state on. A bar at or before the last one seen is passed over, so a run that is repeated
    changes nothing. A pool's new bars are folded in one task; there is one a `width`, so none is hot.

    rows: pool, bucket, sigma_gk, sufficient, dev_peg, age_days, pegged, major, kill. states: STATE, one row a pool.
    """
    wanted = rows.select("pool", "bucket", "sigma_gk", "sufficient", "dev_peg", "age_days", "pegged", "major", "kill")
    out = wanted.groupBy("pool").cogroup(states.groupBy("pool")).applyInArrow(_fold(cfg, width), FOLDED)
    return out.withColumn("bucket", F.col("seen"))


def evaluated(bars: DataFrame, states: DataFrame, describe: Callable[[DataFrame], DataFrame], cfg: Config, bars_day: int, width: int, since: int | None, correlated: bool = False) -> DataFrame:
    """The stages over the bars after `since` (all bars without it), with the state after each. `bars` holds the run's
    bars and, of each pool, at least LOOKBACK before them; `describe` adds what the stages need to know of pools."""
    old = bars.join(states.select("pool", "first_seen"), "pool", "left")
    rows = pipeline.history(old, bars_day, LOOKBACK)
    if since is not None:
        rows = rows.filter(F.col("bucket") > since)
    rows = rows.withColumns({"sigma_gk": scalar.garman_klass(F.col("open"), F.col("high"), F.col("low"), F.col("close")), "sufficient": F.col("history_days") >= cfg.history_days})
    rows = describe(rows.drop("first_seen"))
    state = folded(rows, states, cfg, width)
    item = F.struct(F.col("item_signal").alias("signal"), F.col("item_observed").alias("observed"), F.lit(">=").alias("cmp"), F.col("item_threshold").alias("threshold"), F.col("item_passed").alias("passed"))
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0)))
    out = rows.join(state.withColumn("regime_item", item).drop("item_signal", "item_observed", "item_threshold", "item_passed"), ["pool", "bucket"])
    out = pipeline.daily_volatility(out.withColumns({"sigma_fast": root("fast"), "sigma_slow": root("slow")}), cfg, correlated)
    out = out.withColumn("c_fill", F.when(F.col("regime_before") == "S", 0.75).otherwise(0.5))
    return pipeline.evaluate(pipeline.with_risk_inputs(out), cfg)


def states_after(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The states after a run: each evaluated pool's last one, and those of pools without new bars."""
    last = windows.latest_per_key(rows.select("pool", *_NAMES), ["pool"], ["seen"])
    return last.unionByName(states.join(last.select("pool"), "pool", "left_anti"))


def run_once(bars: DataFrame, where: str, until: int, evaluate: Callable[[DataFrame, DataFrame, int | None], DataFrame]) -> None:
    """One run over all bars that are new since the last run, up to `until`: the states are loaded, new bars evaluated
    from bounded look-backs, their rows put into `where`/rows by day, and the new states stored in `where`/states.

    Only a stored state counts as a run. One that broke off before is repeated from the old state: the days that it
    touched are written again from what had been there up to that state, so its half-done rows are replaced.
    """
    spark = bars.sparkSession
    tables.recover(spark, f"{where}/rows", ["day"])
    held = tables.newest(spark, f"{where}/states")
    states, since = held or (no_states(spark), None)
    bars = bars.filter(F.col("bucket") <= until)
    if since is not None:
        bars = bars.filter(F.col("bucket") > since).unionByName(windows.recent(bars, LOOKBACK, since))
    rows = evaluate(bars, states, since).withColumn("day", F.floor(F.col("bucket") / DAY))
    touched = [r.day for r in bars.filter(F.col("bucket") > since if since is not None else F.lit(True)).select(F.floor(F.col("bucket") / DAY).alias("day")).distinct().collect()]
    there = tables.read(spark, f"{where}/rows") if since is not None else None
    if touched:
        kept = there.filter(F.col("day").isin(touched) & (F.col("bucket") <= since)) if there is not None else None
        tables.replace(rows if kept is None else rows.unionByName(kept), f"{where}/rows", ["day"])
        new = tables.read(spark, f"{where}/rows").filter(F.col("day").isin(touched))
        new = new.filter(F.col("bucket") > since) if since is not None else new
        tables.store(states_after(new, states), f"{where}/states", until)
