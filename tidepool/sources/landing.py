"""Sources of landed data: typed scans, JSON pages, nested transactions, event payloads, and backfill planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schema of a landed page of pool metrics and its windows.
WINDOWS = ("30m", "1h", "2h", "4h", "12h", "24h")
_PER_WINDOW = T.StructType([T.StructField(w, T.DoubleType()) for w in WINDOWS])
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("pages", T.LongType()),
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("address", T.StringType()),
                        T.StructField("current_price", T.DoubleType()),
                        T.StructField("tvl", T.DoubleType()),
                        T.StructField("apr", T.DoubleType()),
                        T.StructField("apy", T.DoubleType()),
                        T.StructField("dynamic_fee_pct", T.DoubleType()),
                        T.StructField("pool_config", T.StructType([T.StructField("bin_step", T.IntegerType()), T.StructField("base_fee_pct", T.DoubleType()), T.StructField("protocol_fee_pct", T.DoubleType())])),
                        T.StructField("volume", _PER_WINDOW),
                        T.StructField("fees", _PER_WINDOW),
                        T.StructField("fee_tvl_ratio", _PER_WINDOW),
                        T.StructField("has_farm", T.BooleanType()),
                        T.StructField("is_blacklisted", T.BooleanType()),
                        T.StructField("launchpad", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def scan(spark: SparkSession, path: str, schema: T.StructType, start: int | None = None, end: int | None = None, pools: Sequence[str] | None = None) -> DataFrame:
    """A typed parquet scan within [start, end) of column t and a list of pools; the filters reach the files."""
    rows = spark.read.schema(schema).parquet(path)
    if start is not None:
        rows = rows.filter(F.col("t") >= start)
    if end is not None:
        rows = rows.filter(F.col("t") < end)
    return rows if pools is None else rows.filter(F.col("pool").isin(*pools))


def metric_pages(pages: DataFrame) -> DataFrame:
    """One row per pool of landed JSON pages (column `body`): missing numbers are 0, missing flags false; pages that
    don't parse and pools without an address are left out."""
    parsed = pages.select(F.from_json("body", PAGE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    d = parsed.filter("p._corrupt_record is null").select(F.explode("p.data").alias("d")).filter("d.address is not null")
    number = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(0.0))
    per = [number(f"{c}.{w}").alias(f"{c}_{w}") for c in ("volume", "fees", "fee_tvl_ratio") for w in WINDOWS]
    return d.select("d.address", number("current_price").alias("price"), number("tvl").alias("tvl"), "d.pool_config.bin_step", *per, F.coalesce("d.has_farm", F.lit(False)).alias("has_farm"), F.coalesce("d.is_blacklisted", F.lit(False)).alias("blacklisted"))


def transaction_events(transactions: DataFrame, program: str, pools: Sequence[str] | None = None) -> DataFrame:
    """Events in the inner instructions of transactions: failed ones and those without metadata are dropped, other
    programs' instructions too. ix_index is the group's index times 1000 plus the place in it.

    transactions: signature, slot, err, inner array<struct<index, instructions array<struct<program, pool, data>>>>.
    """
    ok = transactions.filter(F.col("err").isNull() & F.col("inner").isNotNull())
    groups = ok.select("signature", "slot", F.explode("inner").alias("g"))
    each = groups.select("signature", "slot", F.col("g.index").alias("group"), F.posexplode("g.instructions").alias("place", "i")).filter(F.col("i.program") == program)
    rows = each.select("signature", "slot", (F.col("group") * 1000 + F.col("place")).cast("int").alias("ix_index"), F.col("i.pool").alias("pool"), F.col("i.data").alias("data"))
    return rows if pools is None else rows.filter(F.col("pool").isin(*pools))


def little_endian(data: Column, start: int, length: int) -> Column:
    """An unsigned little-endian integer at a 0-based offset of a binary column, as decimal(20,0)."""
    pairs = F.regexp_extract_all(F.hex(F.substring(data, start + 1, length)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


def discriminator(kind: str) -> Column:
    """The eight bytes, as hex, that begin a payload of a kind: of the hash of `event:<kind>`."""
    return F.upper(F.substring(F.sha2(F.lit(f"event:{kind}").cast("binary"), 256), 1, 16))


def decoded(payloads: DataFrame, layouts: dict[str, Sequence[tuple[str, int, int]]], tag: bytes) -> DataFrame:
    """Adds kind, fields (a map of name to decimal) and quarantined to a binary column `data`.

    A payload is the tag, its kind's discriminator, and a little-endian body; layouts name (field, offset in the
    body, length). An unknown kind or a short body quarantines the row, with null fields.
    """
    head, own = F.hex(F.substring("data", 1, len(tag))), F.hex(F.substring("data", len(tag) + 1, 8))
    kind, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,decimal(20,0)>")
    for name, layout in layouts.items():
        size = len(tag) + 8 + max(o + n for _, o, n in layout)
        here = (head == tag.hex().upper()) & (own == discriminator(name)) & (F.octet_length("data") >= size)
        body = F.create_map(*[x for f, o, n in layout for x in (F.lit(f), little_endian(F.col("data"), len(tag) + 8 + o, n))])
        kind, fields = F.when(here, F.lit(name)).otherwise(kind), F.when(here, body).otherwise(fields)
    out = payloads.select("*", kind.alias("kind"), fields.alias("fields"))
    return out.withColumn("quarantined", F.col("kind").isNull())


# The tag before an event and the fields of its eight kinds, in order, with their types.
EVENT_TAG = bytes.fromhex("e445a52e51cb9a1d")
EVENT_LAYOUTS = {
    "Swap": [
        ("lb_pair", "key"), ("from", "key"), ("start_bin_id", "i32"), ("end_bin_id", "i32"), ("amount_in", "u64"), ("amount_out", "u64"), ("swap_for_y", "bool"), ("fee", "u64"), ("protocol_fee", "u64"),
        ("fee_rate", "u128"), ("host_fee", "u64"),
    ],
    "AddLiquidity": [("lb_pair", "key"), ("from", "key"), ("position", "key"), ("amount_x", "u64"), ("amount_y", "u64"), ("active_bin_id", "i32")],
    "RemoveLiquidity": [("lb_pair", "key"), ("from", "key"), ("position", "key"), ("amount_x", "u64"), ("amount_y", "u64"), ("active_bin_id", "i32")],
    "ClaimFee": [("lb_pair", "key"), ("position", "key"), ("owner", "key"), ("fee_x", "u64"), ("fee_y", "u64")],
    "ClaimFee2": [("lb_pair", "key"), ("position", "key"), ("owner", "key"), ("fee_x", "u64"), ("fee_y", "u64"), ("active_bin_id", "i32")],
    "LbPairCreate": [("lb_pair", "key"), ("bin_step", "u16"), ("token_x", "key"), ("token_y", "key")],
    "PositionCreate": [("lb_pair", "key"), ("position", "key"), ("owner", "key")],
    "PositionClose": [("position", "key"), ("owner", "key")],
}
BYTES = {"key": 32, "u128": 16, "u64": 8, "i32": 4, "u16": 2, "bool": 1}
_TYPES = {"key": "string", "u128": "decimal(38,0)", "u64": "decimal(20,0)", "i32": "int", "u16": "int", "bool": "boolean"}


def _field(data: Column, start: int, kind: str) -> Column:
    """A field of a payload: keys as lower-case hex, numbers exact, a rate beyond 2^64 null."""
    if kind == "key":
        return F.lower(F.hex(F.substring(data, start + 1, 32)))
    low = little_endian(data, start, min(BYTES[kind], 8))
    if kind == "u128":
        return F.when(little_endian(data, start + 8, 8) == 0, low).cast(_TYPES[kind])
    if kind == "i32":
        return (low - F.when(low >= 2**31, F.lit(2**32)).otherwise(F.lit(0))).cast("int")
    return (low == 1) if kind == "bool" else low.cast(_TYPES[kind])


def event_payloads(payloads: DataFrame) -> DataFrame:
    """Adds kind, one column for each field name of `EVENT_LAYOUTS` (null where a kind has no such field), lp_fee,
    fee_bps and quarantined to a binary column `data`.

    Quarantined, with null fields: null or empty data, a wrong tag, an unknown kind, a body of any other length than
    its kind's, a flag that is neither 0 nor 1, and swaps whose protocol fee exceeds the fee or whose rate is beyond
    64 bits. lp_fee is the fee less the protocol's part; fee_bps the rate in basis points, rounded down.
    """
    body, data = len(EVENT_TAG) + 8, F.col("data")
    tagged, own = F.hex(F.substring(data, 1, 8)) == EVENT_TAG.hex().upper(), F.hex(F.substring(data, 9, 8))
    kind = F.lit(None).cast("string")
    found: dict[str, Column] = {}
    types = {name: t for layout in EVENT_LAYOUTS.values() for name, t in layout}
    for name, layout in EVENT_LAYOUTS.items():
        size = sum(BYTES[t] for _, t in layout)
        sound = tagged & (own == discriminator(name)) & (F.octet_length(data) == body + size)
        at, fields = body, {}
        for field, t in layout:
            fields[field] = _field(data, at, t)
            if t == "bool":
                sound &= little_endian(data, at, 1) <= 1
            at += BYTES[t]
        if name == "Swap":
            sound &= (fields["fee"] >= fields["protocol_fee"]) & fields["fee_rate"].isNotNull()
        kind = F.when(sound, F.lit(name)).otherwise(kind)
        for field, value in fields.items():
            found[field] = F.when(F.col("kind") == name, value).otherwise(found.get(field, F.lit(None).cast(_TYPES[types[field]])))
    rows = payloads.withColumn("kind", kind)
    rows = rows.withColumns({f: c.cast(_TYPES[types[f]]) for f, c in found.items()})
    bps = F.floor(F.col("fee_rate") * 10_000 / 1_000_000_000).cast("decimal(20,0)")
    return rows.withColumns({"lp_fee": (F.col("fee") - F.col("protocol_fee")).cast("decimal(20,0)"), "fee_bps": bps, "quarantined": F.col("kind").isNull()})


def range_class(slot: Column, time: Column, slots: tuple[int | None, int | None], times: tuple[int | None, int | None]) -> Column:
    """`too_new`, `within` or `too_old` against inclusive bounds of which each may be open; with an unknown time only
    the slots count."""
    above = below = F.lit(False)
    for value, (low, high) in ((slot, slots), (time, times)):
        if high is not None:
            above |= F.coalesce(value > high, F.lit(False))
        if low is not None:
            below |= F.coalesce(value < low, F.lit(False))
    return F.when(above, "too_new").when(below, "too_old").otherwise("within")


def backfill_plan(requests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """pool, low, high, action, cursor: `resume` from the cursor if the checkpoint has the same range, `skip` if that
    is complete, else `fresh`."""
    saved = checkpoints.select("pool", F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("cursor").alias("__cursor"), "complete")
    same = F.col("__low").eqNullSafe(F.col("low")) & F.col("__high").eqNullSafe(F.col("high")) & F.col("complete").isNotNull()
    action = F.when(same & F.col("complete"), "skip").when(same, "resume").otherwise("fresh")
    return requests.join(saved, "pool", "left").select("pool", "low", "high", action.alias("action"), F.when(action == "resume", F.col("__cursor")).alias("cursor"))


def chunk_index(slot: Column, low: Column, high: Column, chunk: int) -> Column:
    """The index of a slot's chunk in [low, high), clamped to the range."""
    inside = F.greatest(low, F.least(slot, high - 1))
    return F.floor((inside - low) / chunk).cast("long")
