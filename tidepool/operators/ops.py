"""Freshness, ingest lag, alerts and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions.scalar import bucket

SLOT_SECONDS = 0.4
# Alert limits.
LAG_WARN, LAG_CRITICAL, MOST_RECONNECTS, MOST_ERRORS = 750, 3000, 5, 0.1


def freshness(bars: DataFrame, now: int) -> DataFrame:
    return bars.agg((F.lit(now) - F.max("bucket")).alias("age"))


def activity(signals: DataFrame, width: int = 900) -> DataFrame:
    return signals.groupBy(bucket(F.col("t"), width).alias("bucket"), "kind").agg(F.count("*").alias("signals"))


def ingest_lag(ticks: DataFrame) -> DataFrame:
    """Adds lag_slots, new_rows and healthy to telemetry (source, t, last_block_time, total_rows): a tick is healthy
    if rows came since the tick before and the lag is below the warning."""
    before = F.lag("total_rows").over(W.partitionBy("source").orderBy("t"))
    lag = F.round(F.greatest(F.col("t") - F.col("last_block_time"), F.lit(0)) / SLOT_SECONDS).cast("long")
    rows = ticks.select("*", lag.alias("lag_slots"), (F.col("total_rows") - before).alias("new_rows"))
    return rows.withColumn("healthy", (F.col("lag_slots") <= LAG_WARN) & (F.coalesce("new_rows", F.lit(0)) > 0))


def held(rows: DataFrame, condition: str, seconds: int, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Rows at which a condition has been true for `seconds` without a break."""
    by = W.partitionBy(*keys).orderBy("t")
    runs = rows.withColumn("__run", F.count_if(~F.coalesce(F.expr(condition), F.lit(False))).over(by))
    since = F.min(F.when(F.expr(condition), F.col("t"))).over(W.partitionBy(*keys, "__run"))
    return runs.withColumn("__since", since).filter(F.expr(condition) & (F.col("t") - F.col("__since") >= seconds)).drop("__run", "__since")


def alerts(telemetry: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, t, alert) of telemetry (source, t, lag_slots, slot, reconnects) and decode errors (source, event_type,
    t, errors), of which reconnects and errors are running counts: lag above its limits, no new slot in ten minutes and
    too many reconnects in a quarter of an hour, each held for five minutes; and more than a tenth of an error a second
    of one event type over five minutes, held for ten."""
    over = lambda seconds, *keys: W.partitionBy("source", *keys).orderBy("t").rangeBetween(-seconds, 0)
    rows = telemetry.select(
        "*", (F.max("slot").over(over(600)) == F.min("slot").over(over(600))).alias("still"), (F.col("t") - F.min("t").over(W.partitionBy("source"))).alias("age"),
        (F.col("reconnects") - F.min("reconnects").over(over(900))).alias("recent_reconnects"),
    )
    rates = errors.withColumn("rate", (F.col("errors") - F.min("errors").over(over(300, "event_type"))) / 300.0)
    rules = {"lag_warning": f"lag_slots > {LAG_WARN}", "lag_critical": f"lag_slots > {LAG_CRITICAL}", "no_progress": "still and age >= 600", "reconnects": f"recent_reconnects > {MOST_RECONNECTS}"}
    out = held(rates, f"rate > {MOST_ERRORS}", 600, ("source", "event_type")).select("source", "t", F.concat(F.lit("decode_errors:"), "event_type").alias("alert"))
    for name, condition in rules.items():
        out = out.unionByName(held(rows, condition, 300).select("source", "t", F.lit(name).alias("alert")))
    return out
