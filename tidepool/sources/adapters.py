"""The engine's logical tables as projections of the given benchmark tables.

Times are whole epoch seconds (long), computed from the timestamp's fields, so no result depends on the session's
time zone. USD amounts are decimals, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def pool_name(key: Column) -> Column:
    return F.concat(F.lit("P"), key.cast("string"))


@dataclass(frozen=True)
class Tables:
    """The logical tables of one data folder, each a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", epoch_seconds(F.col("ts")).alias("t"), "user_id", "event_type", F.col("value").cast("decimal(18,4)").alias("v"), "props",
            pool_name(F.col("user_id") % 8).alias("pool"),
        )

    def swaps(self) -> DataFrame:
        e = self.events().filter(F.col("event_type").isin("click", "purchase"))
        return e.select(
            "pool", "t", "event_id", F.col("user_id").alias("signer"), (F.col("event_id") % 2 == 0).alias("swap_for_y"),
            (F.col("v") / 100 + 1).cast("decimal(18,8)").alias("price"), F.col("v").alias("volume_usd"),
            (F.col("v") * F.lit(3)).cast("decimal(24,4)").alias("fee_milli"),
        )

    def snapshots(self) -> DataFrame:
        e = self.events().filter("event_type = 'view'")
        return e.select(
            "pool", "t", "event_id", (F.col("v") * 100 + 10000).cast("decimal(24,4)").alias("tvl"), (F.col("v") + 100).cast("decimal(18,4)").alias("active_tvl"),
            F.floor("v").cast("int").alias("active_bin"), (F.col("event_id") % 1000).cast("int").alias("va"),
        )

    def liquidity(self) -> DataFrame:
        e = self.events().filter(F.col("event_type").isin("signup", "error"))
        return e.select("pool", "t", "event_id", F.col("user_id").alias("owner"), F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("action"), F.col("v").alias("amount_usd"))

    def pools(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            pool_name(k).alias("pool"), k.alias("pool_key"), (10 + k * 7 % 91).cast("int").alias("bin_step"), (5000 + k * 37 % 10000).cast("int").alias("base_factor"),
            (k % 2).cast("int").alias("base_power"), (k * 1009 % 50000).cast("int").alias("vfc"), (k % 2).cast("int").alias("tier"), (k % 13 == 0).alias("blacklisted"),
            F.when(k % 17 != 0, F.concat(F.lit("T"), (k % 25).cast("string"))).alias("token_x"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("token_y"),
            F.col("s_acctbal").cast("decimal(18,2)").alias("reserve"), F.col("s_nationkey").cast("int").alias("nation"),
        )

    def tokens(self) -> DataFrame:
        return self.raw("nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("mint"), F.col("n_name").alias("symbol"), (6 + F.col("n_nationkey") % 4).cast("int").alias("decimals"))

    def positions(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            c.alias("position_id"), pool_name(c % 100).alias("pool"), (c % 40).alias("wallet"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"),
            (c % 50).cast("int").alias("lower_bin"), (c % 50 + 20).cast("int").alias("upper_bin"), (c % 5 == 0).alias("closed"),
        )

    def cash_flows(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
        return self.raw("orders").select(F.col("o_orderkey").alias("flow_id"), F.col("o_custkey").alias("position_id"), kind.alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), epoch_seconds(F.col("o_orderdate")).alias("t"))

    def trades(self) -> DataFrame:
        """Daily trades of many pools: one row per line item."""
        return self.raw("lineitem").select(
            pool_name(F.col("l_suppkey")).alias("pool"), epoch_seconds(F.col("l_shipdate")).alias("t"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("volume_usd"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_partkey").alias("signer"),
        )


#: The same projections for DuckDB, by name.
SQL = {
    "e": "select event_id, cast(floor(epoch(ts)) as bigint) as t, user_id, event_type, cast(value as decimal(18,4)) as v, props, 'P' || (user_id % 8) as pool from events",
    "swaps": "select pool, t, event_id, user_id as signer, event_id % 2 = 0 as swap_for_y, cast(1 + cast(v as decimal(18,6)) / 100 as decimal(18,8)) as price, v as volume_usd, cast(v * 3 as decimal(24,4)) as fee_milli from e where event_type in ('click', 'purchase')",
    "snapshots": "select pool, t, event_id, cast(v * 100 + 10000 as decimal(24,4)) as tvl, cast(v + 100 as decimal(18,4)) as active_tvl, cast(floor(v) as integer) as active_bin, cast(event_id % 1000 as integer) as va from e where event_type = 'view'",
    "liquidity": "select pool, t, event_id, user_id as owner, case when event_type = 'signup' then 0 else 1 end as action, v as amount_usd from e where event_type in ('signup', 'error')",
    "pools": "select 'P' || s_suppkey as pool, s_suppkey as pool_key, cast(10 + s_suppkey * 7 % 91 as integer) as bin_step, cast(5000 + s_suppkey * 37 % 10000 as integer) as base_factor, cast(s_suppkey % 2 as integer) as base_power, cast(s_suppkey * 1009 % 50000 as integer) as vfc, cast(s_suppkey % 2 as integer) as tier, s_suppkey % 13 = 0 as blacklisted, case when s_suppkey % 17 <> 0 then 'T' || (s_suppkey % 25) end as token_x, 'T' || (s_suppkey % 3) as token_y, cast(s_acctbal as decimal(18,2)) as reserve, cast(s_nationkey as integer) as nation from supplier",
    "tokens": "select 'T' || n_nationkey as mint, n_name as symbol, cast(6 + n_nationkey % 4 as integer) as decimals from nation",
    "positions": "select c_custkey as position_id, 'P' || (c_custkey % 100) as pool, c_custkey % 40 as wallet, cast(c_acctbal as decimal(18,2)) as value, cast(c_custkey % 50 as integer) as lower_bin, cast(c_custkey % 50 + 20 as integer) as upper_bin, c_custkey % 5 = 0 as closed from customer",
    "cash_flows": "select o_orderkey as flow_id, o_custkey as position_id, case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end as kind, cast(o_totalprice as decimal(18,2)) as amount, cast(epoch(o_orderdate) as bigint) as t from orders",
    "trades": "select 'P' || l_suppkey as pool, cast(epoch(l_shipdate) as bigint) as t, l_orderkey as order_key, l_linenumber as line, cast(l_extendedprice as decimal(18,2)) as volume_usd, l_extendedprice / l_quantity as price, l_partkey as signer from lineitem",
}
_NEEDS = {"swaps": "e", "snapshots": "e", "liquidity": "e"}


def exact_price_ctes(name: str, rows: str, bits: int) -> dict[str, str]:
    """CTEs for DuckDB that end in `name`: the rows (bin_id of at most so many bits, bin_step) with q, the price in
    fixed point with 64 fractional bits, and price, the same as a double."""
    one, most = "18446744073709551616::uhugeint", "340282366920938463463374607431768211455::uhugeint"
    return {
        f"{name}0": f"select *, {most} // ({one} + bin_step::uhugeint * {one} // 10000) as f, {one} as p from ({rows})",
        **{f"{name}{k + 1}": f"select * replace (f * f // {one} as f, case when (abs(bin_id) >> {k}) & 1 = 1 then p * f // {one} else p end as p) from {name}{k}" for k in range(bits)},
        f"{name}_q": f"select * exclude (f, p), case when bin_id = 0 then {one} when p = 0 then null when bin_id > 0 then {most} // p else p end as q from {name}{bits}",
        name: f"select *, q::double / 18446744073709551616.0::double as price from {name}_q",
    }


def sql(body: str, *names: str, **more: str) -> str:
    """A query over logical tables: `names` and the given CTEs (in order) before the body."""
    wanted = [n for name in names for n in ([_NEEDS[name]] if name in _NEEDS else []) + [name]]
    parts = {n: SQL[n] for n in wanted} | more
    return "with " + ", ".join(f"{n} as ({q})" for n, q in parts.items()) + " " + body if parts else body
