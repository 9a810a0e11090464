"""Structured Streaming forms of the ingest and rollup jobs.

Every job takes streaming frames (of files or a log) and returns a frame or a started query; sinks write through
`foreachBatch` with idempotent keys, so a batch that is run again after a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidepool.operators import barstore
from tidepool.operators.pipeline import Config, suggested
from tidepool.sources.sinks import append_new


def landed(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """A stream of parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def of_pools(events: DataFrame, pools: Sequence[str] | None) -> DataFrame:
    return events if pools is None else events.filter(F.col("pool").isin(*pools))


_SIDES = ("buy_volume", "sell_volume", "fee_milli", "unique_traders")


def _sides(swaps: DataFrame) -> list:
    """Buy and sell volume, fees and exact distinct traders, where the stream carries what they need."""
    if not {"swap_for_y", "fee_milli", "signer"} <= set(swaps.columns):
        return []
    volume = lambda sell: F.sum(F.when(F.col("swap_for_y") == sell, F.col("volume_usd")))
    return [volume(False).alias("buy_volume"), volume(True).alias("sell_volume"), F.sum("fee_milli").alias("fee_milli"), F.size(F.collect_set("signer")).cast("long").alias("unique_traders")]


def bars(swaps: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a stream with event time `ts`; rows later than the watermark are dropped, as bars already
    built are not built again. OHLC needs (ts, event_id) order within the bar."""
    order = F.struct("ts", "event_id")
    return swaps.withWatermark("ts", late).groupBy("pool", F.window("ts", width)).agg(
        F.sum("volume_usd").alias("volume"), F.count("*").alias("swap_count"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), *_sides(swaps)
    ).select("pool", F.col("window.start").alias("bucket"), "volume", "swap_count", "open", "high", "low", "close", *_SIDES[: len(_sides(swaps))])


def sliding(states: DataFrame, span: str, every: str, late: str = "10 minutes") -> DataFrame:
    """Windows of `span` sampled `every` so often, with the exact median, the mean and the extent of active liquidity.
    A window's values are kept until the watermark passes it."""
    seen = states.withWatermark("ts", late).groupBy("pool", F.window("ts", span, every)).agg(F.array_sort(F.collect_list("active_tvl")).alias("values"), F.avg("active_tvl").alias("mean"), F.max("active_tvl").alias("high"), F.count("*").alias("n"))
    nth = lambda k: F.get("values", F.floor((F.size("values") + k) / 2).cast("int") - 1)
    return seen.select("pool", "window", ((nth(1) + nth(2)) / 2).alias("median"), "mean", "high", "n")


def with_block_times(transactions: DataFrame, blocks: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Transactions with their slot's block time, whichever comes first; without one by the watermark it is null.
    Both sides carry event time `ts` of arrival and are joined within the lateness."""
    left = transactions.withWatermark("ts", late).alias("t")
    right = blocks.select(F.col("slot").alias("b_slot"), F.col("block_time"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late).alias("b")
    near = F.expr(f"slot = b_slot and b_ts between ts - interval {late} and ts + interval {late}")
    return left.join(right, near, "left_outer").drop("b_slot", "b_ts")


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest slot's row; of equal slots the later arrival."""
    best = state.get if state.exists else None
    for frame in frames:
        for slot, seq, value in frame.sort_values("seq")[["slot", "seq", "value"]].itertuples(index=False):
            if best is None or (slot, seq) >= (best[0], best[1]):
                best = (int(slot), int(seq), float(value))
    if best is not None:
        state.update(best)
        yield pd.DataFrame({"pool": [key[0]], "slot": [best[0]], "seq": [best[1]], "value": [best[2]]})


def latest_state(updates: DataFrame) -> DataFrame:
    """Each pool's newest state (pool, slot, seq, value) as updates come in; older slots change nothing."""
    return updates.groupBy("pool").applyInPandasWithState(_latest, "pool string, slot long, seq long, value double", "slot long, seq long, value double", "update", GroupStateTimeout.NoTimeout)


def _cooled(seconds: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for t in sorted(frame["t"]):
                if last is None or t - last >= seconds:
                    last = int(t)
                    out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"pool": [key[0]] * len(out), "kind": [key[1]] * len(out), "t": out})

    return run


def cooled_signals(signals: DataFrame, seconds: int) -> DataFrame:
    """Signals (pool, kind, t) that pass the cooldown; the last sent time of each key is kept in the state."""
    return signals.groupBy("pool", "kind").applyInPandasWithState(_cooled(seconds), "pool string, kind string, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def _averaged(decay: float) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen = state.get if state.exists else (0.0, -1)
        times, values = [], []
        for frame in frames:
            for t, x in frame.sort_values("t")[["t", "x"]].itertuples(index=False):
                if t > seen:
                    value, seen = decay * value + (1 - decay) * float(x), int(t)
                    times.append(seen)
                    values.append(value)
        state.update((value, seen))
        yield pd.DataFrame({"pool": [key[0]] * len(times), "t": times, "value": values})

    return run


def averaged_variance(observations: DataFrame, decay: float) -> DataFrame:
    """Running averages of (pool, t, x) with decay; each bar is folded once, replays change nothing."""
    return observations.groupBy("pool").applyInPandasWithState(_averaged(decay), "pool string, t long, value double", "value double, seen long", "append", GroupStateTimeout.NoTimeout)


def _regimes(cfg: Config, width: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        regime, pending, pending_since, changed, seen = state.get if state.exists else (None, None, None, None, None)
        rows = pd.concat(frames).sort_values("bucket")
        rows = rows.astype({c: "float64" for c in ("sigma_slow", "sigma_fast", "dev_peg", "age_days")})
        out = []
        for x in rows.itertuples(index=False):
            t = int(x.bucket) + width
            if seen is not None and t <= seen:
                continue
            seen = t
            found = suggested(regime, x, cfg)
            if x.kill:
                regime, pending, pending_since, changed = found, None, None, t
            elif found == regime:
                pending, pending_since = None, None
            else:
                since = t if found != pending else pending_since
                early = t - (t if since is None else since) < cfg.persistence
                if early or (changed is not None and t - changed < cfg.cooldown):
                    pending, pending_since = found, since
                else:
                    regime, pending, pending_since, changed = found, None, None, t
            out.append((key[0], int(x.bucket), regime))
        state.update((regime, pending, pending_since, changed, seen))
        yield pd.DataFrame(out, columns=["pool", "bucket", "regime"])

    return run


def regimes(observations: DataFrame, cfg: Config, width: int) -> DataFrame:
    """pool, bucket, regime: the streaming form of `pipeline.regimes`. Each pool's regime, pending candidate and clocks
    are kept in the state, so a restart goes on where it was; a bar at or before the last one seen changes nothing, so
    bars must come in order from batch to batch. observations: as for `pipeline.regimes`."""
    kept = "regime string, pending string, pending_since long, changed long, seen long"
    return observations.groupBy("pool").applyInPandasWithState(_regimes(cfg, width), "pool string, bucket long, regime string", kept, "append", GroupStateTimeout.NoTimeout)


def _field_changes(fields: Sequence[str]) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for frame in frames:
            for t, *values in frame.sort_values("t")[["t", *fields]].itertuples(index=False):
                now = tuple(None if pd.isna(v) else int(v) for v in values)
                if last is not None:
                    out += [(key[0], t, f, old, new) for f, old, new in zip(fields, last, now, strict=True) if old != new]
                last = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["pool", "t", "field", "old_value", "new_value"])

    return run


def parameter_changes(reads: DataFrame, fields: Sequence[str] = ("a", "b")) -> DataFrame:
    """One row per changed one of the given fields of reads (pool, t, fields); the last read survives a restart in the
    checkpoint."""
    kept = ", ".join(f"{f} long" for f in fields)
    return reads.groupBy("pool").applyInPandasWithState(_field_changes(fields), "pool string, t long, field string, old_value long, new_value long", kept, "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], every: str | None = None, time: str | None = None):
    """Starts an idempotent append: a batch's rows are written unless their key is there already, and only then is the
    batch committed. With `time`, a column of the key in epoch seconds, a batch reads the table's partitions of its own
    days only. Without `every` it takes what is there and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_new(batch, path, key, time=time))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def refreshing(stream: DataFrame, where: str, checkpoint: str, every: str | None = None):
    """Starts a job over 10-minute bars as they come in or are corrected: a batch's bars are merged into the stored ones
    (the last of a pool and bucket counts), and the coarser bars of the look-back are made anew. A batch that is run
    again changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        barstore.upsert(rows.dropDuplicates(["pool", "bucket"]), where, "10m")
        barstore.refresh(rows.sparkSession, where, barstore.newest(barstore.bars(rows.sparkSession, where, "10m")))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watched(stream: DataFrame, watch_set: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Starts a job that keeps each batch's rows of watched pools; the set is read anew for every batch."""

    def batch(rows: DataFrame, _: int) -> None:
        write(rows.join(watch_set().select("pool"), "pool", "left_semi"))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
