"""Event payloads, shapes of secrets, ranges and intents in their awkward cases."""

from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tidepool.functions import scalar, shapes
from tidepool.operators import enrich, ledger, ranking
from tidepool.sources import landing

KEY = bytes(range(32))


def payload(kind: str, body: bytes, tag: bytes = landing.EVENT_TAG) -> bytearray:
    return bytearray(tag + hashlib.sha256(f"event:{kind}".encode()).digest()[:8] + body)


def swap(fee=1000, protocol=100, rate=2_500_000, flag=1) -> bytes:
    return KEY + KEY[::-1] + struct.pack("<iiQQBQQQQQ", -7, 2**31 - 1, 2**64 - 1, 5, flag, fee, protocol, rate % 2**64, rate >> 64, 3)


def decoded(spark, *data):
    rows = landing.event_payloads(spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, data binary"))
    return {r.id: r for r in rows.collect()}


def test_the_tag_is_the_reversed_hash_of_its_name():
    assert landing.EVENT_TAG == hashlib.sha256(b"anchor:event").digest()[:8][::-1]


def test_swap_payload_keeps_signs_and_large_numbers(spark):
    one = decoded(spark, payload("Swap", swap()))[0]
    assert (one.kind, one.lb_pair, one["from"], one.start_bin_id, one.end_bin_id, one.swap_for_y) == ("Swap", KEY.hex(), KEY[::-1].hex(), -7, 2**31 - 1, True)
    assert (int(one.amount_in), int(one.lp_fee), int(one.fee_bps), int(one.host_fee), one.quarantined) == (2**64 - 1, 900, 25, 3, False)
    assert one.position is None and one.bin_step is None


def test_broken_payloads_are_quarantined(spark):
    good = payload("PositionClose", KEY + KEY)
    bad = [
        None, bytearray(), good[:-1], good + b"\0", payload("PositionClose", KEY + KEY, bytes(8)), payload("Other", KEY), payload("Swap", swap(flag=2)), payload("Swap", swap(fee=1, protocol=2)), payload("Swap", swap(rate=2**64)),
    ]
    found = decoded(spark, good, *bad)
    assert found[0].kind == "PositionClose" and found[0].owner == KEY.hex() and not found[0].quarantined
    assert len(found) == 1 + len(bad)
    for i in range(1, len(bad) + 1):
        assert found[i].quarantined and found[i].kind is None and found[i].lb_pair is None and found[i].fee is None


@pytest.mark.parametrize(
    ("text", "is_array"),
    [
        ("[" + ",".join(["7"] * 32) + "]", True), (" [ " + " , ".join(["65535"] * 40) + " ]\n", True), ("[" + ",".join(["7"] * 31) + "]", False), ("[" + ",".join(["7"] * 32) + ",]", False), ("[" + ",".join(["65536"] * 32) + "]", False),
        ("[" + ",".join(["-1"] * 32) + "]", False), (",".join(["7"] * 32), False), ("", False), (None, False),
    ],
)
def test_key_arrays(spark, text, is_array):
    assert spark.createDataFrame([(text,)], "text string").select(shapes.is_key_array(F.col("text")).alias("v")).first().v is is_array


def test_exit_times(spark):
    row = spark.range(1).select(scalar.exit_time(F.lit(0.2), F.lit(0.1)).alias("a"), scalar.exit_time(F.lit(0.2), F.lit(0.1), 0.5).alias("b"), scalar.exit_time(F.lit(0.2), F.lit(0.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (pytest.approx(4.0), pytest.approx(1.0), None)


def test_an_even_range_has_its_odd_bin_above(spark):
    rows = spark.createDataFrame([(1000, 20), (1000, 1), (1000, 0), (1000, 71), (None, 20), (2_000_000, 20), (1000, None)], "a int, w int")
    r = [x.r for x in rows.select(ledger.proposed_range(F.col("a"), F.col("w"), F.lit(25)).alias("r")).collect()]
    assert (r[0].lower_bin, r[0].upper_bin, r[0].refusal) == (991, 1010, None) and r[0].price_lower == pytest.approx(1.0025**991)
    assert (r[1].lower_bin, r[1].upper_bin) == (1000, 1000)
    assert [x.refusal for x in r[2:]] == ["width", "width", "active", "range", "width"] and all(x.lower_bin is None and x.price_upper is None for x in r[2:])


def test_replayed_confirmations_change_nothing(spark):
    rows = [
        (1, 10, 1, "open", 7, 5.0, None), (1, 12, 2, "open", 7, 99.0, None), (2, 20, 3, "close", 7, 4.0, None), (3, 30, 4, "close", 7, 1.0, "late"), (4, 5, 5, "close", 8, 1.0, "unopened"), (5, 6, 6, "other", 9, None, None),
    ]
    confirmed = spark.createDataFrame(rows, "intent int, t long, seq int, action string, position_id int, amount double, reason string")
    flows = {r.intent: (r.kind, r.t, r.amount) for r in ledger.intent_flows(confirmed).collect()}
    assert flows == {1: (0, 10, 5.0), 2: (1, 20, 4.0), 3: (1, 30, 1.0), 4: (1, 5, 1.0), 5: (None, 6, None)}
    assert [tuple(r) for r in ledger.intent_positions(confirmed).collect()] == [(7, 1, 10, 20, "late")]
    assert ledger.intent_positions(confirmed.limit(0)).count() == ledger.intent_flows(confirmed.limit(0)).count() == 0


def test_a_revoked_wallet_is_restored_by_its_owner_only(spark):
    asked = spark.createDataFrame([(1, 9, 1), (1, 5, 2), (1, 5, 3), (2, 4, 1), (2, 3, 1), (3, 6, 1)], "wallet int, owner int, t int")
    known = spark.createDataFrame([(1, 5, True), (3, 6, None)], "wallet int, owner int, revoked boolean")
    found = {(r.wallet, r.owner, r.t): r.outcome for r in ledger.registrations(asked, known).collect()}
    assert found == {(1, 9, 1): "refused", (1, 5, 2): "restored", (1, 5, 3): "relabelled", (2, 3, 1): "registered", (2, 4, 1): "refused", (3, 6, 1): "relabelled"}


def test_the_latest_signal_brings_its_conditions_in_order(spark):
    points = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 10, 3), ("a", 11, 4)], "pool string, t long, point_id int")
    signals = spark.createDataFrame([("a", 10, 100, "x"), ("a", 10, 101, "y"), ("a", 11, 102, "z")], "pool string, t long, signal_id int, kind string")
    items = spark.createDataFrame([(101, 1, "second"), (101, 0, "first"), (100, 0, "other")], "signal_id int, seq int, signal string")
    found = {r.point_id: r for r in ranking.explained(points, signals, items).collect()}
    assert found[1].signal_id is None and found[1].conditions is None and found[3].kind is None
    assert found[2].kind == "y" and [c.signal for c in found[2].conditions] == ["first", "second"]
    assert found[4].signal_id == 102 and found[4].conditions == []


def test_states_without_their_active_bin(spark):
    rows = spark.sql("select 'a' as pool, 1L as t, 5 as active_bin, 10 as base_bps, cast(null as int) as dynamic_bps, array(named_struct('bin_id', 4, 'amount_x', 1, 'amount_y', 2)) as bins union all select 'a', 2L, null, null, 3, null")
    one, two = sorted(enrich.state_rows(rows).collect(), key=lambda r: r.t)
    assert (one.total_fee_bps, one.active_x, one.bins_held) == (10, None, 1) and (two.total_fee_bps, two.active_y, two.bins_held) == (3, None, 0)
    assert [(r.bin_id, r.is_active) for r in enrich.state_bins(rows).collect()] == [(4, False)]
