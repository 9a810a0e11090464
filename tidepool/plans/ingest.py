"""Queries of projections, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import prices, scalar, shapes
from tidepool.operators import enrich
from tidepool.operators.windows import latest_per_key
from tidepool.plans.registry import query
from tidepool.sources import landing, sinks
from tidepool.sources.adapters import Tables, exact_price_ctes, sql


@query(sql("select 'chain-event:' || pool || ':' || (t // 60) || ':' || rn as key, pool, signer, v3::bigint as fee_raw, volume_usd::double as amount from (select pool, t, signer, event_id, volume_usd, fee_milli as v3, row_number() over (partition by pool, t // 60 order by event_id) as rn from swaps)", "swaps"))
def swap_rows(t: Tables) -> DataFrame:
    """Swaps as stored: a key of pool, slot and place in the slot, and the raw fee of both parts together."""
    slot = F.floor(F.col("t") / 60)
    rows = t.swaps().withColumn("slot", slot).withColumn("rn", F.row_number().over(W.partitionBy("pool", "slot").orderBy("event_id")))
    key = F.concat(F.lit("chain-event:"), F.concat_ws(":", "pool", F.col("slot").cast("string"), F.col("rn").cast("string")))
    return rows.select(key.alias("key"), "pool", "signer", F.round("fee_milli").cast("long").alias("fee_raw"), F.col("volume_usd").cast("double").alias("amount"))


@query(sql("select event_id, pool, owner, action, amount_usd::double as amount_usd from liquidity", "liquidity"))
def liquidity_rows(t: Tables) -> DataFrame:
    return t.liquidity().select("event_id", "pool", "owner", "action", F.col("amount_usd").cast("double").alias("amount_usd"))


_FEES = "select event_id, user_id * 1000003 as fee, user_id * 1000003 // 10 - (case when event_id % 50 = 0 then -user_id * 1000003 else 0 end) as protocol, event_id % 100000000 as rate from e"


@query(sql("select event_id, fee - protocol as lp_fee, rate * 10000 // 1000000000 as fee_bps, fee - protocol < 0 as quarantined from f", "e", f=_FEES))
def lp_fees(t: Tables) -> DataFrame:
    """The providers' part of a fee and its rate in basis points; negative parts are quarantined."""
    fee, e = F.col("user_id") * 1000003, F.col("event_id")
    protocol = F.floor(fee / 10) + F.when(e % 50 == 0, fee).otherwise(F.lit(0))
    bps = F.floor((e % 100000000) * 10000 / 1000000000).cast("long")
    return t.events().select("event_id", (fee - protocol).alias("lp_fee"), bps.alias("fee_bps"), (fee - protocol < 0).alias("quarantined"))


@query(sql("select case event_type when 'click' then 'swap' when 'purchase' then 'swap' when 'signup' then 'liquidity' when 'error' then 'liquidity' else 'other' end as route, count(*) as events from e group by 1", "e"))
def routed_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    route = F.when(kind.isin("click", "purchase"), "swap").when(kind.isin("signup", "error"), "liquidity").otherwise("other")
    return t.events().groupBy(route.alias("route")).agg(F.count("*").alias("events"))


@query(sql("select pool, (base_factor::bigint * bin_step * 10 * case base_power when 1 then 10 else 1 end) as base_rate, round((base_factor::bigint * bin_step * 10 * case base_power when 1 then 10 else 1 end) / 1e5, 6) as base_bps, ((vfc::hugeint * (va::hugeint * bin_step) * (va::hugeint * bin_step) + 99999999999) // 100000000000)::bigint * (vfc <> 0)::bigint as variable_rate from (select *, pool_key * 517 % 350000 as va from pools)", "pools"))
def pool_fees(t: Tables) -> DataFrame:
    """Exact base and variable fee rates of the pool dimension."""
    base = scalar.base_fee_rate(F.col("base_factor"), F.col("bin_step"), F.col("base_power"))
    va = F.col("pool_key") * 517 % 350000
    return t.pools().select("pool", base.cast("long").alias("base_rate"), F.round(base.cast("double") / 1e5, 6).alias("base_bps"), scalar.variable_fee_rate(F.col("vfc"), va, F.col("bin_step")).cast("long").alias("variable_rate"))


@query(sql("select s.pool, s.event_id, round(case when abs(active_bin * ln(1 + bin_step / 10000.0)) <= 35 then pow(1 + bin_step / 10000.0, active_bin) end, 9) as price, active_bin // 70 as array_index, round(ln(close) / ln(1 + bin_step / 10000.0))::bigint as bin_of_price from (select *, active_bin - 50 as b, 1 + active_tvl::double / 100 as close from snapshots) s join pools p on p.pool = s.pool".replace("active_bin *", "b *").replace(", active_bin) end", ", b) end").replace("active_bin // 70", "floor(b / 70)::bigint"), "snapshots", "pools"))
def state_rows(t: Tables) -> DataFrame:
    """Snapshots with the price of the active bin, its array, and the bin of a price."""
    b, step = F.col("active_bin") - 50, F.col("bin_step")
    rows = t.snapshots().join(t.pools().select("pool", "bin_step"), "pool")
    return rows.select("pool", "event_id", F.round(scalar.bin_price(b, step), 9).alias("price"), scalar.array_index(b).alias("array_index"), scalar.bin_of_price(1 + F.col("active_tvl").cast("double") / 100, step).alias("bin_of_price"))


_EXACT = exact_price_ctes("exact", "select pool, event_id, event_id * 7 % 20001 - 10000 as bin_id, bin_step from e join pools using (pool)", 14)


@query(sql("select event_id, bin_id, bin_step, (q // 18446744073709551616)::varchar as high, (q % 18446744073709551616)::varchar as low, price from exact", "e", "pools", **_EXACT))
def exact_bin_prices(t: Tables) -> DataFrame:
    """The price of a bin of each event's pool in fixed point (whole part and 64-bit fraction, as text) and as a double."""
    pools = t.pools().select("pool", "bin_step")
    rows = t.events().select("pool", "event_id", (F.col("event_id") * 7 % 20001 - 10000).alias("bin_id")).join(pools, "pool")
    rows = enrich.with_prices(rows.drop("pool"), {"q": "bin_id"}, pools, digits=True)
    half = lambda i: (F.col("q")[i].cast("decimal(20,0)") * 2**32 + F.col("q")[i + 1]).cast("decimal(20,0)").cast("string")
    return rows.select("event_id", "bin_id", "bin_step", half(0).alias("high"), half(2).alias("low"), prices.as_double(F.col("q")).alias("price"))


@query(sql("select e.event_id, round(e.v::double * 1000000 / pow(10, tk.decimals), 9) as amount from e left join pools p on p.pool = e.pool left join tokens tk on tk.mint = p.token_x", "e", "pools", "tokens"))
def scaled_amounts(t: Tables) -> DataFrame:
    """Raw amounts by the token's decimals; null where the token is unknown."""
    rows = t.events().join(t.pools().select("pool", "token_x"), "pool", "left").join(t.tokens().select(F.col("mint").alias("token_x"), "decimals"), "token_x", "left")
    return rows.select("event_id", F.round(scalar.scaled(F.col("v").cast("double") * 1000000, F.col("decimals")), 9).alias("amount"))


@query(sql("select pool, coalesce(m.until > 1000, false) as muted from pools p left join (select 'P' || (c_custkey % 60) as pool, max(c_custkey) as until from customer where c_custkey % 40 = 7 group by 1) m using (pool)", "pools"))
def muted_pools(t: Tables) -> DataFrame:
    """Pools tagged as muted, none dropped."""
    mutes = t.positions().filter("position_id % 40 = 7").groupBy(F.concat(F.lit("P"), (F.col("position_id") % 60).cast("string")).alias("pool")).agg(F.max("position_id").alias("until"))
    return t.pools().select("pool").join(mutes, "pool", "left").select("pool", F.coalesce(F.col("until") > 1000, F.lit(False)).alias("muted"))


@query(sql("select position_id, case when p.pool is null then 'unknown_pool' when p.blacklisted then 'blacklisted' when p.tier <> 1 then 'not_watched' when x.value > 9000 then 'too_large' end as refusal from positions x left join pools p on p.pool = x.pool and p.pool_key % 10 <> 9", "positions", "pools"))
def farm_refusals(t: Tables) -> DataFrame:
    """The first reason, in order, for which a request is refused; null if none."""
    known = t.pools().filter("pool_key % 10 <> 9").select("pool", "blacklisted", "tier")
    code = F.when(F.col("tier").isNull(), "unknown_pool").when(F.col("blacklisted"), "blacklisted").when(F.col("tier") != 1, "not_watched").when(F.col("value") > 9000, "too_large")
    return t.positions().join(known, "pool", "left").select("position_id", code.alias("refusal"))


@query(sql("select position_id, case when s.kind is null or s.kind <> 'POTENTIAL' then 'no_signal' when x.value <= 0 then 'no_amount' when f.last is not null and x.value > f.last then 'above_cap' end as refusal from positions x left join (select 'P' || (user_id % 100) as pool, case when max_by(event_type, event_id) in ('click', 'view') then 'POTENTIAL' else 'INFO' end as kind from events group by 1) s on s.pool = x.pool left join (select position_id as fp, max_by(amount, flow_id) as last from cash_flows group by 1) f on f.fp = x.position_id", "positions", "cash_flows"))
def exposure_refusals(t: Tables) -> DataFrame:
    """Adds only to pools whose latest signal is POTENTIAL, with an amount, and within the last priced flow."""
    latest = t.events().groupBy(F.concat(F.lit("P"), (F.col("user_id") % 100).cast("string")).alias("pool")).agg(F.max_by("event_type", "event_id").alias("last_type"))
    priced = t.cash_flows().groupBy("position_id").agg(F.max_by("amount", "flow_id").alias("last"))
    rows = t.positions().join(latest, "pool", "left").join(priced, "position_id", "left")
    good = F.coalesce(F.col("last_type").isin("click", "view"), F.lit(False))
    code = F.when(~good, "no_signal").when(F.col("value") <= 0, "no_amount").when(F.col("last").isNotNull() & (F.col("value") > F.col("last")), "above_cap")
    return rows.select("position_id", code.alias("refusal"))


@query(r"select conv_id, turn, text is not null and (len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[1-9A-HJ-NP-Za-km-z]{32,44}'))) > 0) as public_key, text is not null and (len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[1-9A-HJ-NP-Za-km-z]{50,}'))) > 0) as raw_key, coalesce(len(string_split(text, ' ')) in (12, 15, 18, 21, 24) and (regexp_full_match(text, '[a-z]{3,8}( [a-z]{3,8})*') or regexp_full_match(text, '[A-Z]{3,8}( [A-Z]{3,8})*')), false) as phrase, coalesce(regexp_full_match(text, '\s*\[\s*[0-9]{1,4}\s*(,\s*[0-9]{1,4}\s*){31,}\]\s*'), false) as key_array from (select conv_id, turn, text from conversations union all select conv_id, turn + 1000000, '[' || array_to_string(list_transform(range(28 + conv_id % 8), lambda x: (x * 37 + turn) % 256), ', ') || ']' from conversations)")
def secret_shapes(t: Tables) -> DataFrame:
    """Texts with words of a key's shape, of a recovery phrase's shape, or of a key file's: beside the given texts
    stands an array of 28 to 35 small numbers for each."""
    given = t.raw("conversations").select("conv_id", "turn", "text")
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), 27 + F.col("conv_id") % 8), lambda x: ((x * 37 + F.col("turn")) % 256).cast("string"))
    arrays = given.select("conv_id", (F.col("turn") + 1000000).alias("turn"), F.concat(F.lit("["), F.array_join(numbers, ", "), F.lit("]")).alias("text"))
    text = F.col("text")
    return given.unionByName(arrays).select("conv_id", "turn", shapes.has_public_key(text).alias("public_key"), shapes.has_raw_key(text).alias("raw_key"), shapes.is_phrase(text).alias("phrase"), shapes.is_key_array(text).alias("key_array"))


@query(sql("select event_id, case when t // 60 > 28420000 or (known and t > 1705800000) then 'too_new' when t // 60 < 28405000 or (known and t < 1704500000) then 'too_old' else 'within' end as class from (select *, event_id % 5 <> 0 as known from e)", "e"))
def range_classes(t: Tables) -> DataFrame:
    """Events against inclusive slot and time bounds; a fifth have no block time."""
    time = F.when(F.col("event_id") % 5 != 0, F.col("t"))
    return t.events().select("event_id", landing.range_class(F.floor(F.col("t") / 60), time, (28405000, 28420000), (1704500000, 1705800000)).alias("class"))


@query(sql("select r.pool, r.low, r.high, case when c.low = r.low and c.high = r.high then case when c.complete then 'skip' else 'resume' end else 'fresh' end as action, case when c.low = r.low and c.high = r.high and not c.complete then c.cursor end as cursor from (select pool, pool_key * 10 as low, pool_key * 10 + 1000 as high from pools) r left join (select pool, pool_key * 10 + pool_key % 3 // 2 as low, pool_key * 10 + 1000 as high, pool_key * 10 + 77 as cursor, pool_key % 4 = 0 as complete from pools where pool_key % 5 <> 0) c on c.pool = r.pool", "pools"))
def backfill_plan(t: Tables) -> DataFrame:
    k = F.col("pool_key")
    asked = t.pools().select("pool", (k * 10).alias("low"), (k * 10 + 1000).alias("high"))
    saved = t.pools().filter("pool_key % 5 <> 0").select("pool", (k * 10 + F.floor(k % 3 / 2)).alias("low"), (k * 10 + 1000).alias("high"), (k * 10 + 77).alias("cursor"), (k % 4 == 0).alias("complete"))
    return landing.backfill_plan(asked, saved)


@query(sql("select pool, least(greatest(t, 1704100000), 1706499999) // 1 as clamped, (least(greatest(t, 1704100000), 1706499999) - 1704100000) // 250000 as chunk, count(*) as events from e group by all", "e").replace("least(greatest(t, 1704100000), 1706499999) // 1 as clamped, ", ""))
def chunk_progress(t: Tables) -> DataFrame:
    """Events by the chunk of the backfill range that they fall in."""
    index = landing.chunk_index(F.col("t"), F.lit(1704100000), F.lit(1706500000), 250000)
    return t.events().groupBy("pool", index.alias("chunk")).agg(F.count("*").alias("events"))


@query(sql("select user_id as signature, (g.event_id % 4 * 1000 + row_number() over (partition by user_id, event_id % 4 order by event_id) - 1)::integer as ix_index, pool, event_id from e g where user_id % 9 <> 0 qualify event_type <> 'view'", "e"))
def transaction_events(t: Tables) -> DataFrame:
    """Events of nested transactions: here each user's events are one transaction's instructions in four groups,
    views belong to another program, and every ninth transaction failed."""
    e = t.events()
    program = F.when(F.col("event_type") == "view", "other").otherwise("pools")
    one = F.struct(F.col("event_id").alias("data"), program.alias("program"), "pool")
    groups = e.groupBy("user_id", (F.col("event_id") % 4).alias("index")).agg(F.array_sort(F.collect_list(one)).alias("instructions"))
    nested = groups.groupBy("user_id").agg(F.collect_list(F.struct("index", "instructions")).alias("inner"))
    rows = nested.select(F.col("user_id").alias("signature"), F.lit(0).alias("slot"), F.when(F.col("user_id") % 9 == 0, "failed").alias("err"), "inner")
    return landing.transaction_events(rows, "pools").select("signature", "ix_index", "pool", F.col("data").alias("event_id"))


def _little_endian(value: Column, size: int) -> Column:
    """A number that isn't negative as so many bytes."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


@query(sql("select event_id, case when event_id % 10 = 0 then null when event_type in ('click', 'purchase') then 'Swap' when event_type = 'signup' then 'AddLiquidity' end as kind, case when event_id % 10 <> 0 and event_type in ('click', 'purchase', 'signup') then t end as a, case when event_id % 10 <> 0 and event_type in ('click', 'purchase', 'signup') then user_id end as b, event_id % 10 = 0 or event_type not in ('click', 'purchase', 'signup') as quarantined from e", "e"))
def payload_round_trip(t: Tables) -> DataFrame:
    """Events written as binary payloads and decoded again; every tenth is cut short, unknown kinds are quarantined."""
    e = t.events()
    name = F.when(F.col("event_type").isin("click", "purchase"), F.unhex(landing.discriminator("Swap"))).when(F.col("event_type") == "signup", F.unhex(landing.discriminator("AddLiquidity"))).otherwise(F.unhex(F.lit("0011223344556677")))
    whole = F.concat(F.lit(landing.EVENT_TAG), name, _little_endian(F.col("t"), 8), _little_endian(F.col("user_id"), 4))
    data = F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    layout = [("a", 0, 8), ("b", 8, 4)]
    out = landing.decoded(e.select("event_id", data.alias("data")), {"Swap": layout, "AddLiquidity": layout}, landing.EVENT_TAG)
    return out.select("event_id", "kind", F.col("fields")["a"].cast("long").alias("a"), F.col("fields")["b"].cast("long").alias("b"), "quarantined")


_UPDATES = "select pool, t, event_id, active_bin, case when event_id % 6 <> 0 then 20 + event_id % 30 end as base_bps, case when event_id % 4 <> 0 then event_id % 1100 end as dynamic_bps from snapshots"


def _updates(t: Tables) -> DataFrame:
    """Snapshots as pool updates with five bins below and at the active one; of some the active bin is missing, and
    some hold no bins."""
    i, a = F.col("event_id"), F.col("active_bin").cast("long")
    bins = F.transform(F.sequence(a - 4 - F.when(i % 5 == 0, 1).otherwise(0), a - F.when(i % 5 == 0, 1).otherwise(0)), lambda b: F.struct(b.alias("bin_id"), (i + b).alias("amount_x"), (i - b).alias("amount_y")))
    return t.snapshots().select("pool", "t", "event_id", a.alias("active_bin"), F.when(i % 6 != 0, 20 + i % 30).alias("base_bps"), F.when(i % 4 != 0, i % 1100).alias("dynamic_bps"), F.when(i % 7 != 0, bins).alias("bins"))


@query(sql("select event_id, pool, coalesce(base_bps, 0) + coalesce(dynamic_bps, 0) as total_fee_bps, case when event_id % 7 <> 0 and event_id % 5 <> 0 then event_id + active_bin end as active_x, case when event_id % 7 <> 0 and event_id % 5 <> 0 then event_id - active_bin end as active_y, case when event_id % 7 <> 0 then 5 else 0 end as bins_held from u", "snapshots", u=_UPDATES))
def pool_states(t: Tables) -> DataFrame:
    """Pool updates with their total fee and what the active bin holds."""
    return enrich.state_rows(_updates(t)).select("event_id", "pool", "total_fee_bps", "active_x", "active_y", "bins_held")


@query(sql("select pool, bin_id, count(*) as updates, count(*) filter (bin_id = active_bin) as active, sum(event_id + bin_id)::double as amount_x from (select *, unnest(range(active_bin - 4 - (event_id % 5 = 0)::integer, active_bin + 1 - (event_id % 5 = 0)::integer)) as bin_id from u where event_id % 7 <> 0) group by pool, bin_id", "snapshots", u=_UPDATES))
def state_bins(t: Tables) -> DataFrame:
    """Bins of pool updates, summed for each pool and bin."""
    out = enrich.state_bins(_updates(t)).groupBy("pool", "bin_id")
    return out.agg(F.count("*").alias("updates"), F.count_if("is_active").alias("active"), F.sum("amount_x").cast("double").alias("amount_x"))


_KINDS = tuple(landing.EVENT_LAYOUTS)
_EVENT_SQL = """select event_id, kind,
  case when kind <> 'PositionClose' then sha256(pool) end as lb_pair,
  case when kind not in ('Swap', 'LbPairCreate') then sha256('position' || user_id) end as position,
  case when kind = 'Swap' then event_id % 4000 - 2000 end::integer as start_bin_id,
  case when kind in ('AddLiquidity', 'RemoveLiquidity', 'ClaimFee2') then event_id % 3000 - 1500 end::integer as active_bin_id,
  case when kind = 'Swap' then event_id % 2 = 0 end as swap_for_y,
  case when kind = 'Swap' then (t * 1000 + user_id) end::bigint as amount_in,
  case when kind = 'Swap' then user_id * 1000003 - event_id % 1000 end::bigint as lp_fee,
  case when kind = 'Swap' then event_id * 977 % 100000000 * 10000 // 1000000000 end::bigint as fee_bps,
  case when kind in ('ClaimFee', 'ClaimFee2') then t end::bigint as fee_x,
  case when kind = 'LbPairCreate' then event_id % 400 end::integer as bin_step,
  kind is null as quarantined
  from (select *, case when event_id % 10 < 8 and not (event_id % 10 = 0 and user_id * 1000003 < event_id % 1000) then (['""" + "', '".join(_KINDS) + """'])[event_id % 10 + 1] end as kind from e)"""


@query(sql(_EVENT_SQL, "e"))
def event_payloads(t: Tables) -> DataFrame:
    """Events of all eight kinds written as binary payloads and decoded again. Of each ten, the ninth is a swap cut by
    a byte, the tenth of an unknown kind; both are quarantined."""
    e, i, user = t.events(), F.col("event_id"), F.col("user_id")
    key = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    owner, position, pool = key(F.concat(F.lit("owner"), user.cast("string"))), key(F.concat(F.lit("position"), user.cast("string"))), key(F.col("pool"))
    wrap = lambda c: F.when(c < 0, c + 2**32).otherwise(c)
    bin_, side = wrap(i % 4000 - 2000), wrap(i % 3000 - 1500)
    own = {
        "lb_pair": pool, "from": owner, "owner": owner, "position": position, "token_x": key(F.lit("x")), "token_y": key(F.lit("y")), "start_bin_id": bin_, "end_bin_id": bin_, "active_bin_id": side, "swap_for_y": F.when(i % 2 == 0, 1).otherwise(0).cast("long"),
        "amount_in": F.col("t") * 1000 + user, "amount_out": F.col("t"), "fee": user * 1000003, "protocol_fee": i % 1000, "fee_rate": i * 977 % 100000000, "host_fee": F.lit(0).cast("long"), "amount_x": F.col("t"), "amount_y": user, "fee_x": F.col("t"), "fee_y": user,
        "bin_step": i % 400,
    }
    width = {"u128": 16, "u64": 8, "i32": 4, "u16": 2, "bool": 1}
    data = None
    for n, (name, layout) in enumerate(landing.EVENT_LAYOUTS.items()):
        body = [own[f] if k == "key" else _little_endian(own[f], width[k]) for f, k in layout]
        whole = F.concat(F.lit(landing.EVENT_TAG), F.unhex(landing.discriminator(name)), *body)
        cut = F.substring(whole, 1, 8 + 8 + sum(landing.BYTES[k] for _, k in layout) - 1)
        data = F.when(i % 10 == n, whole) if data is None else data.when(i % 10 == n, whole)
        data = data.when(i % 10 == 8, cut) if n == 0 else data
    data = data.otherwise(F.concat(F.lit(landing.EVENT_TAG), F.unhex(F.lit("0011223344556677"))))
    out = landing.event_payloads(e.select("event_id", data.alias("data")))
    long = [F.col(c).cast("long").alias(c) for c in ("amount_in", "lp_fee", "fee_bps", "fee_x")]
    return out.select("event_id", "kind", "lb_pair", "position", "start_bin_id", "active_bin_id", "swap_for_y", *long, "bin_step", "quarantined")


@query(sql("select 'P' || l_suppkey as address, sum(l_quantity)::double as tvl, min(l_linenumber)::integer as bin_step, round(sum(l_extendedprice::decimal(18,2))::double, 2) as \"volume_24h\", 0.0::double as \"fees_1h\", false as has_farm from lineitem where l_suppkey % 20 <> 0 group by l_suppkey"))
def metric_pages(t: Tables) -> DataFrame:
    """Pool metrics out of JSON pages, of which every twentieth doesn't parse; missing numbers and flags are filled."""
    own = t.raw("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("tvl"), F.min("l_linenumber").alias("bin_step"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    pool = F.struct(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("address"), "tvl", F.struct("bin_step").alias("pool_config"), F.struct(F.col("v").alias("24h")).alias("volume"))
    body = F.to_json(F.struct(F.lit(1).alias("pages"), F.array(pool).alias("data")))
    pages = own.select(F.when(F.col("l_suppkey") % 20 == 0, F.concat(body, F.lit("}{"))).otherwise(body).alias("body"))
    pages = pages.filter(~F.col("body").endswith("}{")).union(pages.filter(F.col("body").endswith("}{")).select(F.concat(F.lit("["), "body").alias("body")))
    out = landing.metric_pages(pages)
    return out.select("address", "tvl", F.col("bin_step").cast("int").alias("bin_step"), F.round("volume_24h", 2).alias("volume_24h"), "fees_1h", "has_farm")


@query(sql("select pool, event_id from swaps where event_id % 2 = 0 or event_id % 3 = 0", "swaps"))
def idempotent_append(t: Tables) -> DataFrame:
    """A table after two batches that overlap: every row once."""
    rows = t.swaps().select("pool", "event_id")
    held = rows.filter("event_id % 2 = 0")
    batch = rows.filter("event_id % 3 = 0").union(rows.filter("event_id % 6 = 0"))
    return held.unionByName(sinks.new_rows(batch, held, ["pool", "event_id"]))


@query(sql("select pool, t, v::double as v from (select pool, t, event_id, v, row_number() over (partition by pool order by t desc, (event_id % 2) desc, event_id desc) as rn from e) where rn = 1", "e"))
def last_writer_wins(t: Tables) -> DataFrame:
    rows = t.events().select("pool", "t", "event_id", F.col("v").cast("double").alias("v"))
    one = lambda df: df.groupBy("pool").agg(F.max_by(F.struct("t", "event_id", "v"), F.struct("t", "event_id")).alias("r")).select("pool", "r.*")
    return sinks.last_wins(one(rows.filter("event_id % 2 = 0")), one(rows.filter("event_id % 2 = 1")), ["pool"], "t").select("pool", "t", "v")


@query(sql("select coalesce(o.pool, n.pool) as pool, case when o.pool is not null then o.tier else n.tier end as tier, coalesce(o.first, n.first) as first, case when n.pool is not null then n.bin_step else o.bin_step end as bin_step from (select pool, tier, case when pool_key % 3 = 0 then pool_key end as first, bin_step from pools where pool_key % 4 <> 0) o full join (select pool, 0 as tier, pool_key + 1000 as first, bin_step + 1 as bin_step from pools where pool_key % 5 <> 0) n on n.pool = o.pool", "pools"))
def merged_pools(t: Tables) -> DataFrame:
    """An upsert of pools that keeps the tier and the first liquidity time already known."""
    p = t.pools()
    old = p.filter("pool_key % 4 <> 0").select("pool", "tier", F.when(F.col("pool_key") % 3 == 0, F.col("pool_key")).alias("first"), "bin_step")
    new = p.filter("pool_key % 5 <> 0").select("pool", F.lit(0).alias("tier"), (F.col("pool_key") + 1000).alias("first"), (F.col("bin_step") + 1).alias("bin_step"))
    return sinks.merged(old, new, ["pool"], keep=["tier"], first=["first"])


@query(sql("select position_id, coalesce(case when closed then 5 end, case when position_id % 3 = 0 then position_id end)::bigint as closed_at from positions", "positions"))
def first_write_wins(t: Tables) -> DataFrame:
    p = t.positions().select("position_id", F.when(F.col("closed"), F.lit(5).cast("long")).alias("closed_at"))
    updates = t.positions().filter("position_id % 3 = 0").select("position_id", F.col("position_id").alias("closed_at"))
    return sinks.first_write(p, updates, ["position_id"], ["closed_at"])


@query(sql("select pool, count(*) as events from e where t >= 1706659200 - 7 * 86400 group by pool", "e"))
def retained_events(t: Tables) -> DataFrame:
    return sinks.retained(t.events(), "t", 7, 1706659200).groupBy("pool").agg(F.count("*").alias("events"))


@query(sql("""select 'duplicate_trade' as rule, order_key || '|' || line as key from trades group by order_key, line having count(*) > 1
  union all select 'unknown_pool', order_key || '|' || line from trades where pool not in (select pool from pools where pool_key % 50 <> 0)
  union all select 'bad_kind', flow_id::varchar from cash_flows where kind not in (0, 1)""", "trades", "pools", "cash_flows"))
def constraint_audit(t: Tables) -> DataFrame:
    """Rows that break a key, a reference or a set of values, with the rule's name."""
    trades = t.trades()
    parts = [
        sinks.duplicate_keys(trades, ["order_key", "line"], "duplicate_trade"),
        sinks.orphans(trades, ["order_key", "line"], t.pools().filter("pool_key % 50 <> 0"), "pool", "unknown_pool"),
        sinks.outside_set(t.cash_flows(), ["flow_id"], "kind", [0, 1], "bad_kind"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(sql("select pool, slot, event_id, v::double as v from (select *, t // 3600 as slot, row_number() over (partition by pool order by t // 3600 desc, event_id desc) as rn from e) where rn = 1", "e"))
def newest_slot_state(t: Tables) -> DataFrame:
    """Each pool's newest slot; of equal slots the later arrival."""
    rows = t.events().select("pool", F.floor(F.col("t") / 3600).alias("slot"), "event_id", F.col("v").cast("double").alias("v"))
    return latest_per_key(rows, ["pool"], ["slot", "event_id"])


@query(sql("select pool, t // 3600 as slot, last(event_id order by t, event_id) filter (event_type = 'view') as pair, coalesce(list_sort(list(event_id) filter (event_type = 'click'))::varchar, '[]') as arrays, max(t) filter (event_id % 3 = 0) as block_time from e group by pool, t // 3600", "e"))
def grouped_state_updates(t: Tables) -> DataFrame:
    """Account updates grouped to one state per pool and slot: last pair, all bin arrays, last block time. A slot
    bounds what one group holds."""
    kind = F.col("event_type")
    out = t.events().groupBy("pool", F.floor(F.col("t") / 3600).alias("slot")).agg(
        F.max_by("event_id", F.when(kind == "view", F.struct("t", "event_id"))).alias("pair"),
        F.array_sort(F.collect_list(F.when(kind == "click", F.col("event_id")))).alias("ids"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("t"))).alias("block_time"),
    )
    return out.select("pool", "slot", "pair", F.concat(F.lit("["), F.concat_ws(", ", F.transform("ids", lambda x: x.cast("string"))), F.lit("]")).alias("arrays"), "block_time")


@query(sql("select pool, count(*) as events, min(t) as first_t, max(t) as last_t from e group by pool", "e"))
def compacted_events(t: Tables) -> DataFrame:
    """Events after a rewrite that deals them by pool and day and sorts them within files: nothing is lost."""
    rows = sinks.clustered(t.events(), "pool", "t", 16)
    return rows.groupBy("pool").agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(sql("select t // 86400 as batch, max(t // 60) as max_slot, count(*) as rows_written, count(*) filter (event_type = 'view') as skipped from e group by 1", "e"))
def flush_progress(t: Tables) -> DataFrame:
    """Highest slot and rows of every flush, here a day."""
    return t.events().groupBy(F.floor(F.col("t") / 86400).alias("batch")).agg(F.max(F.floor(F.col("t") / 60)).alias("max_slot"), F.count("*").alias("rows_written"), F.count_if(F.col("event_type") == "view").alias("skipped"))


_INTENTS = "select o_orderkey as intent, o_custkey % 40 as wallet, o_orderkey // 7 % 900 as idempotency_key, case when o_orderkey % 3 <> 0 then 's' || (o_orderkey // 5) end as signature, (o_orderkey % 6)::integer as action, case when o_orderkey % 11 <> 0 then (o_orderkey % 5)::integer end as status from orders"


@query(sql(
    """select 'intent action' as rule, intent::varchar as key from i where action not in (0, 1, 2, 3, 4) union all select 'intent status', intent::varchar from i where status not in (0, 1, 2, 3)
    union all select 'one signature', signature from i where signature is not null group by signature having count(*) > 1 union all select 'one key a wallet', wallet || '|' || idempotency_key from i group by wallet, idempotency_key having count(*) > 1""", i=_INTENTS))  # fmt: skip
def intent_audit(t: Tables) -> DataFrame:
    """Broken rules of transaction intents: allowed actions and states, signatures and idempotency keys that occur once."""
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        k.alias("intent"), (F.col("o_custkey") % 40).alias("wallet"), (F.floor(k / 7) % 900).alias("idempotency_key"), F.when(k % 3 != 0, F.concat(F.lit("s"), F.floor(k / 5).cast("string"))).alias("signature"),
        (k % 6).cast("int").alias("action"), F.when(k % 11 != 0, (k % 5).cast("int")).alias("status"),
    )
    return sinks.audited(rows, ["intent"], {"intent action": ("action", range(5)), "intent status": ("status", range(4))}, {"one signature": ["signature"], "one key a wallet": ["wallet", "idempotency_key"]})
