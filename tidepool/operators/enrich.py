"""Raw events with what they lack on the chain: prices, amounts in units, values in USD, and the sides of a pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import prices, scalar
from tidepool.operators.ranking import small
from tidepool.session import written

FEE_BPS = 10_000.0


def ladders(steps: DataFrame) -> DataFrame:
    """bin_step and its squares, made once for each step that occurs (steps: bin_step)."""
    once = steps.select("bin_step").filter("bin_step is not null").distinct()
    return small(once, once.count(), 20_000).select("bin_step", prices.ladder(F.col("bin_step")).alias("squares"))


def with_prices(rows: DataFrame, bins: dict[str, str], steps: DataFrame, digits: bool = False) -> DataFrame:
    """rows (bin_step, ...) with the exact prices of their bins, in columns named by `bins` (new column to bin column):
    doubles, or the four digits. Each price is made once for each pair of bin and step that occurs, in tasks of equally
    many pairs, and written, so neither the rows nor a plan that reads them twice make it again. steps: bin_step, at
    least those of the rows."""
    pair = lambda c: rows.select(F.col(c).cast("bigint").alias("__bin"), "bin_step")
    pairs = reduce(DataFrame.unionAll, [pair(c) for c in bins.values()]).filter("__bin is not null and bin_step is not null").distinct()
    # a given number of tasks, as a few bytes of pairs make much work
    pairs = pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__bin", "bin_step")
    made = prices.digits(F.col("__bin"), F.col("squares")) if digits else prices.price(F.col("__bin"), F.col("squares"))
    table = written(pairs.join(ladders(steps), "bin_step").select("__bin", "bin_step", made.alias("__price")), "bin-prices")
    table = small(table, table.count())
    for name, column in bins.items():
        one = table.select(F.col("__bin").alias("__of"), F.col("bin_step").alias("__step"), F.col("__price").alias(name))
        rows = rows.join(one, (F.col(column) == F.col("__of")) & (F.col("bin_step") == F.col("__step")), "left").drop("__of", "__step")
    return rows


def quoted(swaps: DataFrame, quotes: DataFrame, piece: int = 300) -> DataFrame:
    """swaps with quote_usd, the quote token's last price at or before each swap. Both sides are dealt by token_y and
    `piece` seconds, and the last price before is carried into each piece, so one token may hold all swaps: a task holds
    five minutes of it, and the carried prices have a row a token and piece.

    swaps: token_y, t. quotes: mint, t, usd.
    """
    of_piece = lambda c: F.floor(F.col(c) / piece)
    prices = quotes.select(F.col("mint").alias("token_y"), F.col("t").alias("seen"), "usd").withColumn("piece", of_piece("seen"))
    rows = swaps.withColumn("piece", of_piece("t"))
    last = prices.groupBy("token_y", "piece").agg(F.max_by("usd", "seen").alias("usd"))
    # a row a piece and token: the price that each piece begins with
    pieces = rows.select("token_y", "piece").unionByName(prices.select("token_y", "piece")).distinct().join(last, ["token_y", "piece"], "left")
    before = W.partitionBy("token_y").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    opening = pieces.select("token_y", "piece", F.last("usd", ignorenulls=True).over(before).alias("opening"))
    both = rows.withColumns({"at": F.col("t"), "side": F.lit(1), "usd": F.lit(None).cast("double")}).unionByName(
        prices.select("token_y", "piece", F.col("seen").alias("at"), F.lit(0).alias("side"), F.col("usd").cast("double")), allowMissingColumns=True
    )
    w = W.partitionBy("token_y", "piece").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("usd", F.last("usd", ignorenulls=True).over(w)).filter("side = 1").join(opening, ["token_y", "piece"])
    return seen.withColumn("quote_usd", F.coalesce("usd", "opening")).select(*swaps.columns, "quote_usd")


def enriched_swaps(swaps: DataFrame, pools: DataFrame, tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """swaps with start_price, end_price, amount_in, amount_out, volume_usd, fee_usd (the providers' part) and
    protocol_fee_usd; null where a token or price is unknown.

    A price is the exact one of the bin, scaled by the tokens' decimals; each is made once (`with_prices`). Selling X (swap_for_y) takes X in and gives Y out. The
    volume is the quote side's amount at the quote token's last known price; fees are parts of it in basis points.
    swaps: pool, t, swap_for_y, amount_in_raw, amount_out_raw, start_bin, end_bin, fee_bps, protocol_bps.
    pools: pool, bin_step, token_x, token_y. tokens: mint, decimals. quotes: mint, t, usd.
    """
    side = lambda s: tokens.select(F.col("mint").alias(f"token_{s}"), F.col("decimals").alias(f"decimals_{s}"))
    dims = pools.select("pool", "bin_step", "token_x", "token_y").join(side("x"), "token_x", "left").join(side("y"), "token_y", "left")
    met = with_prices(swaps.join(dims, "pool"), {"start_price": "start_bin", "end_price": "end_bin"}, pools)
    in_units = lambda c: (F.col(c) * F.pow(F.lit(10.0), F.col("decimals_x") - F.col("decimals_y"))).alias(c)
    ends = ("start_price", "end_price")
    rows = quoted(met.select(*[c for c in met.columns if c not in ends], *map(in_units, ends)), quotes)
    sells = F.col("swap_for_y")
    known_in = F.when(sells, F.col("decimals_x")).otherwise(F.col("decimals_y"))
    known_out = F.when(sells, F.col("decimals_y")).otherwise(F.col("decimals_x"))
    out = rows.withColumns({
        "amount_in": scalar.scaled(F.col("amount_in_raw").cast("double"), known_in), "amount_out": scalar.scaled(F.col("amount_out_raw").cast("double"), known_out),
    })
    out = out.withColumn("volume_usd", F.when(sells, F.col("amount_out")).otherwise(F.col("amount_in")) * F.col("quote_usd"))
    return out.withColumn("protocol_fee_usd", F.col("volume_usd") * F.col("protocol_bps") / FEE_BPS).withColumn("fee_usd", F.col("volume_usd") * (F.col("fee_bps") - F.col("protocol_bps")) / FEE_BPS)


def base_side(pools: DataFrame, quotes: dict[str, str], now: Column) -> DataFrame:
    """pools with quote_asset, base_token and age_days. The recognised token is the quote side; if both or neither are,
    token_y is. The age counts from the first liquidity, or else from the creation.

    pools: pool, token_x, token_y, first_liquidity_at, created_at. quotes: mint to the asset's name.
    """

    def asset(token: str) -> Column:
        out = F.lit(None).cast("string")
        for mint, name in quotes.items():
            out = F.when(F.col(token) == mint, name).otherwise(out)
        return out

    by_y = asset("token_y").isNotNull() | asset("token_x").isNull()
    since = F.coalesce("first_liquidity_at", "created_at")
    return pools.withColumns({
        "quote_asset": F.coalesce(F.when(by_y, asset("token_y")).otherwise(asset("token_x")), F.lit("other")),
        "base_token": F.when(by_y, F.col("token_x")).otherwise(F.col("token_y")), "age_days": (now - since) / 86400.0,
    })


def volume_ranked(metrics: DataFrame, pools: DataFrame, indicators: DataFrame, limit: int) -> DataFrame:
    """The pools with metrics and indicators in the metrics' latest bucket, by volume."""
    latest = metrics.join(F.broadcast(metrics.agg(F.max("bucket").alias("bucket"))), "bucket")
    return latest.join(pools, "pool").join(indicators, ["pool", "bucket"]).orderBy(F.desc_nulls_last("volume"), "pool").limit(limit)


def state_rows(updates: DataFrame) -> DataFrame:
    """Adds total_fee_bps, active_x, active_y and bins_held to pool updates with an array of bins: the base and the
    dynamic fee together (a missing part counts as 0; no cap here) and what the active bin holds, null where the
    update doesn't hold that bin. updates: active_bin, base_bps, dynamic_bps, bins array<struct<bin_id, amount_x,
    amount_y>>, null or empty where none came."""
    active = F.get(F.filter("bins", lambda b: b["bin_id"] == F.col("active_bin")), F.lit(0))
    fee = F.coalesce("base_bps", F.lit(0)) + F.coalesce("dynamic_bps", F.lit(0))
    held = F.coalesce(F.size("bins"), F.lit(0))
    return updates.withColumns({"total_fee_bps": fee, "active_x": active["amount_x"], "active_y": active["amount_y"], "bins_held": F.greatest(held, F.lit(0))})


def state_bins(updates: DataFrame) -> DataFrame:
    """One row per bin of an update, with whether it is the active one; updates without bins give none. updates: pool,
    t, and as for `state_rows`."""
    each = updates.select("pool", "t", "active_bin", F.explode("bins").alias("b"))
    return each.select("pool", "t", "b.*", F.coalesce(F.col("b.bin_id") == F.col("active_bin"), F.lit(False)).alias("is_active"))
