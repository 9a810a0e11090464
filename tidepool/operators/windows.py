"""Per-pool windows over bars: changes, returns, variances, trailing flows, persistence, and keyed folds.

Windows are partitioned by pool (and timeframe, where a frame holds several) and ordered by bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_pool() -> WindowSpec:
    return W.partitionBy("pool").orderBy("bucket")


def trailing(bars: int) -> WindowSpec:
    return by_pool().rowsBetween(-(bars - 1), 0)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's row with the highest order columns: an aggregation, so hot keys are combined map-side."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*")


def changes(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Current minus previous bar's value; null if either is."""
    return bars.select("*", *[(F.col(c) - F.lag(c).over(by_pool())).alias(f"{c}_change") for c in columns])


def log_returns(bars: DataFrame) -> DataFrame:
    """pool, bucket, r: log returns between neighbouring closes that are both known and above zero."""
    closes = bars.filter("close is not null").select("pool", "bucket", F.col("close").cast("double").alias("close"))
    before = F.lag("close").over(by_pool())
    return closes.withColumn("r", F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before))).filter("r is not null").select("pool", "bucket", "r")


def realised(returns: DataFrame, bars: int) -> DataFrame:
    """Realised variance, bipower variation and the jump share (at least 0.05) of the last `bars` returns."""
    rows = returns.withColumn("n", F.row_number().over(by_pool())).withColumn("pair", F.abs("r") * F.abs(F.lag("r").over(by_pool())))
    w, inner = trailing(bars), by_pool().rowsBetween(-(bars - 2), 0)
    rv = F.sum(F.col("r") * F.col("r")).over(w)
    bv = math.pi / 2 * F.coalesce(F.sum("pair").over(inner), F.lit(0.0)) if bars > 1 else F.lit(0.0)
    share = F.greatest(F.try_divide(F.col("rv") - F.col("bv"), F.col("rv")), F.lit(0.05))
    return rows.select("pool", "bucket", "r", rv.alias("rv"), bv.alias("bv")).withColumn("jump_share", F.when(F.col("rv") <= 0, F.lit(0.05)).otherwise(share))


def autocorrelations(returns: DataFrame, lags: int = 6, least: int = 20) -> DataFrame:
    """rho_1 .. rho_lags of each pool's returns: population variance, covariance over n - lag pairs; null with fewer
    than `least` returns or no variance."""
    pool = W.partitionBy("pool")
    rows = returns.select("pool", "bucket", "r", F.avg("r").over(pool).alias("m")).withColumn("x", F.col("r") - F.col("m"))
    rows = rows.select("pool", "x", *[(F.col("x") * F.lag("x", k).over(by_pool())).alias(f"x{k}") for k in range(1, lags + 1)])
    n, variance = F.count("*"), F.avg(F.col("x") * F.col("x"))
    enough = (n >= least) & (variance > 0)
    return rows.groupBy("pool").agg(n.alias("returns"), *[F.when(enough, F.sum(f"x{k}") / (n - k) / variance).alias(f"rho_{k}") for k in range(1, lags + 1)])


def trailing_autocorrelations(returns: DataFrame, bars: int, lags: int = 6, least: int = 20) -> DataFrame:
    """returns with rho_1 .. rho_lags of each pool's last `bars` - 1 returns up to each row, as `autocorrelations` has
    them for all: sums over bounded frames, in which a pair counts if both its returns lie in the frame."""
    frame = lambda first, last=0: by_pool().rowsBetween(first, last)
    begin = -(bars - 2)
    pairs = returns.select("*", *[(F.col("r") * F.lag("r", k).over(by_pool())).alias(f"__p{k}") for k in range(1, lags + 1)])
    n, total, square = F.count(F.lit(1)).over(frame(begin)), F.sum("r").over(frame(begin)), F.sum(F.col("r") * F.col("r")).over(frame(begin))
    sums = [c for k in range(1, lags + 1) for c in (F.sum(f"__p{k}").over(frame(begin + k)).alias(f"__s{k}"), F.sum("r").over(frame(begin, -k)).alias(f"__a{k}"))]
    # the first returns of a frame that is not full have no partner before them: their pairs are null
    later = [F.sum(F.when(F.col(f"__p{k}").isNotNull(), F.col("r"))).over(frame(begin + k)).alias(f"__b{k}") for k in range(1, lags + 1)]
    rows = pairs.select("*", n.alias("__n"), (total / n).alias("__m"), (square / n).alias("__q"), *sums, *later)
    mean, count = F.col("__m"), F.col("__n")
    variance = F.col("__q") - mean * mean
    enough = (count >= least) & (variance > 0)
    rho = lambda k: F.when(enough, (F.col(f"__s{k}") - mean * (F.col(f"__a{k}") + F.col(f"__b{k}")) + (count - k) * mean * mean) / (count - k) / variance)
    return rows.select(*returns.columns, *[rho(k).alias(f"rho_{k}") for k in range(1, lags + 1)])


def trailing_sum(column: str, bars: int) -> Column:
    """Sum over the last `bars` rows, nulls skipped."""
    return F.sum(column).over(trailing(bars))


def full_sum(column: str, bars: int) -> Column:
    """Sum over exactly `bars` rows; null before there are as many."""
    w = trailing(bars)
    return F.when(F.count(F.lit(1)).over(w) >= bars, F.sum(column).over(w))


def trend(column: str, bars: int) -> Column:
    """(recent - prior) / prior over two windows of `bars` rows; 0 without both or with nothing before."""
    recent, prior = full_sum(column, bars), F.sum(column).over(by_pool().rowsBetween(-(2 * bars - 1), -bars))
    known = (F.count(F.lit(1)).over(trailing(2 * bars)) >= 2 * bars) & (prior > 0)
    return F.when(known, (F.coalesce(recent, F.lit(0.0)) - prior) / prior).otherwise(F.lit(0.0))


def hours_below(points: DataFrame, value: str, threshold: float) -> DataFrame:
    """Hours for which each pool's value has been below the threshold without a break up to its last point; a null
    breaks, and a last value that isn't below gives 0."""
    below = F.coalesce(F.col(value) < threshold, F.lit(False))
    last = F.max("bucket").over(W.partitionBy("pool"))
    broken = F.max(F.when(~below, F.col("bucket"))).over(W.partitionBy("pool"))
    after = points.select("pool", "bucket", last.alias("last"), broken.alias("broken")).filter(F.col("broken").isNull() | (F.col("bucket") > F.col("broken")))
    spans = after.groupBy("pool").agg(((F.max("last") - F.min("bucket")) / 3600).cast("double").alias("hours"))
    return points.select("pool").distinct().join(spans, "pool", "left").select("pool", F.coalesce("hours", F.lit(0.0)).alias("hours"))


def ewma(rows: DataFrame, value: str, decay: float, out: str, most: int = 20_000) -> DataFrame:
    """v = decay * v + (1 - decay) * x over each pool's rows, from 0; a null x leaves v. In closed form, as one
    window sum of weighted values; only the last `most` rows of a pool carry weight, so powers stay finite."""
    numbered = rows.withColumn("__n", F.count(value).over(by_pool()))
    reach = min(most, int(650 / -math.log(decay)))
    base = F.floor(F.col("__n") / reach) * reach
    weighted = F.col(value) * F.pow(F.lit(decay), -(F.col("__n") - base).cast("double"))
    block = W.partitionBy("pool", "__block").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    numbered = numbered.withColumn("__block", base).withColumn("__w", weighted)
    own = (1 - decay) * F.pow(F.lit(decay), (F.col("__n") - F.col("__block")).cast("double")) * F.coalesce(F.sum("__w").over(block), F.lit(0.0))
    within = numbered.withColumn("__own", own)
    # a block starts from the block before: with `reach` rows a block, what lies further back than two blocks weighs less than 1e-26
    ends = within.groupBy("pool", "__block").agg(F.max_by("__own", "bucket").alias("__end")).withColumn("__block", F.col("__block") + reach)
    carried = F.coalesce("__end", F.lit(0.0)) * F.pow(F.lit(decay), (F.col("__n") - F.col("__block") + 1).cast("double"))
    return within.join(ends, ["pool", "__block"], "left").withColumn(out, F.col("__own") + carried).select(*rows.columns, out)


DAY = 86_400


def _pieces(rows: DataFrame, keys: Sequence[str], by: str, piece: int, opening: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """rows (side 1) with one row (side 0) at the start of each piece of a key's history, which holds what `opening`
    carries over from the pieces before. No task holds more of a key than a piece; pieces are cut by `piece` along the
    column `by`. `opening` gets rows with __piece, and the window of a key's pieces in order."""
    cut = rows.withColumn("__piece", F.floor(F.col(by) / piece))
    carried = opening(cut, W.partitionBy(*keys).orderBy("__piece"))
    return cut.withColumn("__side", F.lit(1)).unionByName(carried.withColumn("__side", F.lit(0)), allowMissingColumns=True)


def in_piece(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys, "__piece").orderBy("__side", *order)


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, piece: int = DAY) -> DataFrame:
    """rows with the sum of a key's values so far, nulls skipped (null before the first value). The first column of the
    order is a number, along which histories are cut into pieces; doubles are added piece by piece."""

    def opening(cut: DataFrame, before: WindowSpec) -> DataFrame:
        sums = cut.groupBy(*keys, "__piece").agg(F.sum(value).alias("__sum"))
        past = F.sum("__sum").over(before.rowsBetween(W.unboundedPreceding, -1))
        return sums.select(*keys, "__piece", past.alias(value)).filter(F.col(value).isNotNull())

    total = F.sum(value).over(in_piece(keys, order).rowsBetween(W.unboundedPreceding, 0))
    given = [F.col(c).cast(t).alias(c) if c == value else F.col(c) for c, t in rows.dtypes if c != out]  # the union widens the value's type
    return _pieces(rows, keys, order[0], piece, opening).select("*", total.alias("__total")).filter("__side = 1").select(*given, F.col("__total").alias(out))


def with_state_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str], piece: int = DAY) -> DataFrame:
    """rows with __before, the watched columns of the key's row before, null for a key's first. Cut into pieces as for
    `running_sum`."""
    state = F.struct(*watched)

    def opening(cut: DataFrame, before: WindowSpec) -> DataFrame:
        ends = cut.groupBy(*keys, "__piece").agg(F.max_by(state, F.struct(*order)).alias("__end"))
        return ends.select(*keys, "__piece", F.lag("__end").over(before).alias("__end")).filter("__end is not null").select(*keys, "__piece", "__end.*")

    rows_and_openings = _pieces(rows, keys, order[0], piece, opening)
    return rows_and_openings.withColumn("__before", F.lag(state).over(in_piece(keys, order))).filter("__side = 1").select(*rows.columns, "__before")


def field_changes(reads: DataFrame, fields: Sequence[str]) -> DataFrame:
    """pool, t, field, old_value, new_value: one row per field that differs from the pool's read before."""
    rows = with_state_before(reads, ["pool"], ["t", "event_id"], fields).filter("__before is not null")
    items = [F.struct(F.lit(f).alias("field"), F.col("__before")[f].cast("long").alias("old_value"), F.col(f).cast("long").alias("new_value")) for f in fields]
    changed = F.filter(F.array(*items), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return rows.select("pool", "t", F.explode(changed).alias("c")).select("pool", "t", "c.*")


def changed_only(rows: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Rows whose watched columns differ from the key's row before; a key's first row stays."""
    before = with_state_before(rows, keys, order, watched)
    return before.filter(F.col("__before").isNull() | ~F.struct(*watched).eqNullSafe(F.col("__before"))).drop("__before")


def recent(rows: DataFrame, n: int, until: int | None = None) -> DataFrame:
    """Each pool's newest n rows up to a time."""
    if until is not None:
        rows = rows.filter(F.col("bucket") <= until)
    w = W.partitionBy("pool").orderBy(F.desc("bucket"))
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def cooled(signals: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Signals that are sent: a key's first, and each one at least `seconds` after the last sent. The choice depends
    on the one before, so a key's times are folded in order."""
    # a time that follows the one before by `seconds` is always sent: the folds begin anew there. Both windows go over
    # days of a key with what the days before carry over
    begins = F.coalesce(F.col("t") - F.col("__before.t") >= seconds, F.lit(True)).cast("long")
    times_before = with_state_before(signals.select(*keys, "t").distinct(), keys, ["t"], ["t"])
    begun = times_before.select(*keys, "t", begins.alias("__begins"))
    pieces = running_sum(begun, keys, ["t"], "__begins", "__fold")
    times = pieces.groupBy(*keys, "__fold").agg(F.array_sort(F.collect_list("t")).alias("__ts"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("sent"))

    def merge(acc: Column, t: Column) -> Column:
        go = acc["last"].isNull() | (t - acc["last"] >= seconds)
        return F.struct(F.when(go, t).otherwise(acc["last"]).alias("last"), F.when(go, F.concat(acc["sent"], F.array(t))).otherwise(acc["sent"]).alias("sent"))

    sent = times.select(*keys, F.explode(F.aggregate("__ts", start, merge)["sent"]).alias("t"))
    first = W.partitionBy(*keys, "t").orderBy("event_id")
    return signals.join(sent, [*keys, "t"]).withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


def slot_gaps(arrivals: DataFrame, piece: int = 1_000_000) -> DataFrame:
    """stream, from_slot, to_slot, missed: slots that the highest one so far skips, in order of arrival (a number).
    First, repeated and late slots make no gap. A task holds at most the arrivals of one piece of a stream."""

    def opening(cut: DataFrame, before: WindowSpec) -> DataFrame:
        highs = cut.groupBy("stream", "__piece").agg(F.max("slot").alias("__high"))
        past = F.max("__high").over(before.rowsBetween(W.unboundedPreceding, -1))
        return highs.select("stream", "__piece", past.alias("slot")).filter("slot is not null")

    high = F.max("slot").over(in_piece(["stream"], ["arrival"]).rowsBetween(W.unboundedPreceding, -1))
    rows = _pieces(arrivals.select("stream", "arrival", "slot"), ["stream"], "arrival", piece, opening).withColumn("__high", high)
    gaps = rows.filter("__side = 1").filter(F.col("slot") > F.col("__high") + 1)
    return gaps.select("stream", F.col("__high").alias("from_slot"), F.col("slot").alias("to_slot"), (F.col("slot") - F.col("__high") - 1).alias("missed"))
