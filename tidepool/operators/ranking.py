"""Rankings, joins onto dimensions, and the choice of watched pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators.windows import DAY, latest_per_key


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """df marked for broadcast where its counted rows are few; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if rows <= most else df


def scoring_universe(pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pools with the symbols and decimals of both tokens; unknown tokens leave nulls."""
    side = lambda s: tokens.select(F.col("mint").alias(f"token_{s}"), F.col("symbol").alias(f"symbol_{s}"), F.col("decimals").alias(f"decimals_{s}"))
    return pools.join(side("x"), "token_x", "left").join(side("y"), "token_y", "left")


def latest_bucket(rows: DataFrame) -> DataFrame:
    """The rows of the latest bucket of the whole table; pools without a row in it disappear."""
    return rows.join(F.broadcast(rows.agg(F.max("bucket").alias("bucket"))), "bucket")


def top(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(by), "pool").limit(k)


def over_fetched(rows: DataFrame, k: int, by: str, then: str) -> DataFrame:
    """5k rows by one column, of which the first k by another."""
    return rows.orderBy(F.desc_nulls_last(by), "pool").limit(5 * k).orderBy(F.desc_nulls_last(then), F.desc_nulls_last(by), "pool").limit(k)


def wanted(rows: DataFrame, measured_only: bool = True, least: float = 1.0, regime: str | None = None) -> DataFrame:
    """The optional predicates of a screen."""
    keep = F.col("r_org") >= least
    if measured_only:
        keep &= F.col("quality") == "A"
    if regime is not None:
        keep &= F.col("regime") == regime
    return rows.filter(keep)


def rank_shift(narrow: DataFrame, wide: DataFrame, by: str) -> DataFrame:
    """Each pool's rank in a short and a long timeframe and the difference: above 0 it is heating up."""
    rank = lambda df, name: df.select("pool", F.rank().over(W.partitionBy("bucket").orderBy(F.desc_nulls_last(by))).cast("long").alias(name))
    return rank(narrow, "rank_short").join(rank(wide, "rank_long"), "pool").withColumn("shift", F.col("rank_long") - F.col("rank_short"))


def pool_detail(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """The latest value of a column for each timeframe, side by side."""
    rows = None
    for name, df in frames.items():
        own = latest_per_key(df.select("pool", "bucket", F.col(column).alias("value")), ["pool"], ["bucket"]).withColumn("tf", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("pool").pivot("tf", list(frames)).agg(F.first("value"))


def whole_pool_detail(pools: DataFrame, frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Every pool with its summary and, for each timeframe, all columns of its latest bar (`column_timeframe`; null
    without one). All timeframes go through one aggregation by pool, so bars are combined before they are shuffled."""
    rows = None
    for name, df in frames.items():
        own = df.select("pool", F.lit(name).alias("tf"), *columns)
        rows = own if rows is None else rows.unionByName(own)
    latest = rows.groupBy("pool").agg(*[F.max_by(F.struct(*columns), F.when(F.col("tf") == name, F.col("bucket"))).alias(f"__{name}") for name in frames])
    shown = [F.col(f"__{name}")[c].alias(f"{c}_{name}") for name in frames for c in columns]
    return pools.join(latest, "pool", "left").select(*pools.columns, *shown)


def tier_changes(ranked: DataFrame, pools: DataFrame, measured: DataFrame, open_: DataFrame, cap: int = 100, exploration: float = 0.1, margin: int = 20) -> DataFrame:
    """pool, change: which pools to promote and demote.

    The best pools by `r_org` fill the watched slots but for an exploration slice, which takes the newest unmeasured
    unwatched pools. Watched pools go unless they rank within the slots and a margin, are being explored, or have an
    open position. ranked: pool, r_org. pools: pool, tier, age_key (higher is newer). measured, open_: pool.
    """
    slice_ = min(cap, max(0, round(cap * exploration)))
    order = ranked.orderBy(F.desc_nulls_last("r_org"), "pool").limit(cap - slice_ + margin)
    ranks = order.withColumn("rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("r_org"), "pool")))  # at most cap + margin rows
    chosen = ranks.filter(F.col("rn") <= cap - slice_).select("pool")
    fresh = pools.filter("tier = 0").join(measured.select("pool"), "pool", "left_anti").orderBy(F.desc("age_key"), "pool").limit(slice_).select("pool")
    promote = chosen.union(fresh).distinct()
    safe = ranks.select("pool").union(fresh).union(open_.select("pool")).distinct()
    demote = pools.filter("tier = 1").select("pool").join(safe, "pool", "left_anti")
    newly = promote.join(pools.filter("tier = 1").select("pool"), "pool", "left_anti")
    return newly.withColumn("change", F.lit("promote")).union(demote.withColumn("change", F.lit("demote")))


def as_of(points: DataFrame, history: DataFrame, value: str, piece: int = DAY) -> DataFrame:
    """Each point's last value at or before its time. Both sides go into one window by pool and day, and the last value
    of the days before is carried into each, so the cost is one shuffle whatever the distance and no task holds a
    pool's whole history. Rows of the history without a time count for nothing.

    points: pool, t, point_id. history: pool, t, value.
    """
    none = F.lit(None)
    known = F.struct(value, F.col("t").alias("seen"))
    right = history.filter("t is not null").select("pool", "t", none.cast(dict(points.dtypes)["point_id"]).alias("point_id"), known.alias("h"), F.lit(0).alias("side"))
    left = points.select("pool", "t", "point_id", none.cast(dict(right.dtypes)["h"]).alias("h"), F.lit(1).alias("side"))
    both = left.unionByName(right).withColumn("day", F.floor(F.col("t") / piece))
    days = both.groupBy("pool", "day").agg(F.max_by("h", F.col("h.seen")).alias("h"))
    past = F.last("h", ignorenulls=True).over(W.partitionBy("pool").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    opening = days.select("pool", "day", past.alias("h"), F.lit(-1).alias("side")).filter("h is not null")
    # a day's opening sorts first, as it has no time
    w = W.partitionBy("pool", "day").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    rows = both.unionByName(opening, allowMissingColumns=True).withColumn("h", F.last("h", ignorenulls=True).over(w))
    return rows.filter("side = 1").select("pool", "t", "point_id", F.col(f"h.{value}").alias(value), F.col("h.seen").alias("seen"))


def explained(points: DataFrame, signals: DataFrame, items: DataFrame) -> DataFrame:
    """Each point with the last signal of its pool at or before its time, and that signal's conditions in order:
    point_id, pool, t, signal_id, kind, seen, conditions (an array by seq; empty where the signal has none). Points
    before any signal have nulls. Of signals at one time the largest id counts.

    points: pool, t, point_id. signals: pool, t, signal_id, kind. items: signal_id, seq, and what to keep of one, few
    for each signal.
    """
    last = signals.groupBy("pool", "t").agg(F.max(F.struct("signal_id", "kind")).alias("signal"))
    found = as_of(points, last, "signal").select("point_id", "pool", "t", "signal.signal_id", "signal.kind", "seen")
    kept = [c for c in items.columns if c not in ("signal_id", "seq")]
    lists = items.join(found.select("signal_id").distinct(), "signal_id", "left_semi").groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("seq", *kept))).alias("conditions"))
    none = F.when(F.col("signal_id").isNotNull(), F.array().cast(dict(lists.dtypes)["conditions"]))
    return found.join(lists, "signal_id", "left").withColumn("conditions", F.coalesce("conditions", none))


def discovered(found: DataFrame, known: DataFrame, metrics: DataFrame, most: int) -> DataFrame:
    """pool, status, action of discovered against known pools. New ones are onboarded, by name, up to `most` a sweep
    and wait otherwise; known ones with flow metrics are refreshed; those that are missing are reported, never
    deleted. found, known, metrics: pool (nulls are left out)."""
    side = lambda df, name: df.select("pool").filter("pool is not null").distinct().withColumn(name, F.lit(True))
    rows = side(found, "is_found").join(side(known, "is_known"), "pool", "full_outer").join(side(metrics, "is_measured"), "pool", "left")
    status = F.when(F.col("is_known").isNull(), "new").when(F.col("is_found").isNull(), "missing").otherwise("known")
    rows = rows.withColumn("status", status)
    sweep = rows.filter("status = 'new'").select("pool").orderBy("pool").limit(most).withColumn("onboard", F.lit(True))
    action = F.when(F.col("onboard"), "onboard").when(F.col("status") == "new", "wait").when(F.col("is_known") & F.col("is_measured"), "refresh")
    return rows.join(sweep, "pool", "left").select("pool", "status", action.alias("action"))


def with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of known pools with the pool's parameters. params: one row a pool; broadcast only where it is small."""
    return rows.join(small(params, params.count()), "pool")


def bins_in_range(positions: DataFrame, bins: DataFrame, size: int = 16) -> DataFrame:
    """Bins within each position's bounds: both sides are cut into blocks of `size` bins, joined on (pool, block),
    and checked, so a pool's bins meet only positions near them."""
    low, high = F.floor(F.col("lower_bin") / size), F.floor(F.col("upper_bin") / size)
    cut = positions.withColumn("block", F.explode(F.sequence(low, high)))
    own = bins.withColumn("block", F.floor(F.col("bin_id") / size))
    return cut.join(own, ["pool", "block"]).filter(F.col("bin_id").between(F.col("lower_bin"), F.col("upper_bin"))).drop("block")
