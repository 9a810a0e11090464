"""Exact prices of bins: (1 + step / 10 000) ^ bin in fixed point with 64 fractional bits, as column expressions.

A price is raised by squaring the reciprocal of the base, which is below one, so every factor is an unsigned number of
64 bits. Such a number is three limbs of 22 bits, whose products and sums fit a long. The squares depend on the bin
step alone: `ladder` makes them once for each step, and `digits` multiplies those that the bin's bits choose, from the
lowest on, each product cut to 64 fractional bits. A number of 128 bits is four digits of 32, the highest first.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins have fewer bits than this many.
BITS = 19
_LIMB, _MASK, _DIGIT = 22, (1 << 22) - 1, 32
_LIMBS = "struct<a: bigint, b: bigint, c: bigint>"
#: One, as limbs (the highest limb has a bit more than others need).
_ONE = (0, 0, 1 << 20)


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast(f"decimal({len(str(value))},0)")


def _limbs(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c"))


def _times(x: Column, y: Column) -> Column:
    """x * y / 2^64, rounded down."""
    first, second = x["a"] * y["a"], x["a"] * y["b"] + x["b"] * y["a"]
    third, fourth, fifth = x["a"] * y["c"] + x["b"] * y["b"] + x["c"] * y["a"], x["b"] * y["c"] + x["c"] * y["b"], x["c"] * y["c"]
    low = F.shiftright(third + F.shiftright(second + F.shiftright(first, _LIMB), _LIMB), 20) + fourth * 4
    middle = F.shiftright(low, _LIMB) + fifth * 4
    return _limbs(low.bitwiseAND(F.lit(_MASK).cast("bigint")), middle.bitwiseAND(F.lit(_MASK).cast("bigint")), F.shiftright(middle, _LIMB))


def _largest_over(divisor: Column) -> list[Column]:
    """(2^128 - 1) / divisor, rounded down, as four digits, by long division; null for a divisor of 0. Without its
    leading digits the quotient is also right for divisors of more than 64 bits."""
    divisor = F.nullif(divisor, F.lit(Decimal(0)).cast("decimal(21,0)"))
    full, unit = _whole(2**_DIGIT - 1), _whole(2**_DIGIT)
    rest, out = full.cast("decimal(38,0)"), []
    for _ in range(4):
        out.append(F.call_function("div", rest, divisor))
        rest = ((rest % divisor).cast("decimal(21,0)") * unit + full).cast("decimal(38,0)")
    return out


def ladder(bin_step: Column) -> Column:
    """The reciprocal of 1 + step / 10 000 and its squares, squares of squares and so on, as limbs; null for a null or
    negative step."""
    scaled = bin_step.cast("decimal(10,0)") * _whole(2**64)
    base = _whole(2**64) + ((scaled - scaled % 10_000) / F.lit(Decimal(10_000)).cast("decimal(5,0)")).cast("decimal(25,0)")
    *_, high, low = _largest_over(base.cast("decimal(21,0)"))
    mask = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    first = _limbs(mask(low, _LIMB), F.shiftright(low, _LIMB) + mask(high, 12) * 1024, F.shiftright(high, 12))
    start = F.struct(first.cast(_LIMBS).alias("last"), F.array(first).cast(f"array<{_LIMBS}>").alias("all"))

    def squared(acc: Column, _: Column) -> Column:
        one = F.array(_times(acc["last"], acc["last"]))
        return F.transform(one, lambda x: F.struct(x.cast(_LIMBS).alias("last"), F.concat(acc["all"], F.array(x)).cast(f"array<{_LIMBS}>").alias("all")))[0]

    made = F.aggregate(F.sequence(F.lit(2), F.lit(BITS)), start, squared)["all"]
    return F.when(bin_step >= 0, made)


def digits(bin_id: Column, squares: Column) -> Column:
    """The price as four digits, given the step's ladder; null for a bin of more than BITS bits and a price of 0."""
    size = F.abs(bin_id.cast("bigint"))
    chosen = F.filter(squares, lambda _, i: F.getbit(size, i) == 1)
    product = F.aggregate(chosen, _limbs(*map(F.lit, _ONE)).cast(_LIMBS), lambda acc, x: _times(acc, x).cast(_LIMBS))

    def shown(p: Column) -> Column:
        whole = (p["c"].cast("decimal(20,0)") * _whole(2**44) + (p["b"] * (1 << _LIMB) + p["a"]).cast("decimal(20,0)")).cast("decimal(21,0)")
        high = F.shiftright(p["b"], 10) + p["c"] * 4096
        low = p["b"].bitwiseAND(F.lit(1023).cast("bigint")) * (1 << _LIMB) + p["a"]
        zero = F.lit(0).cast("bigint")
        below = F.when((p["a"] > 0) | (p["b"] > 0) | (p["c"] > 0), F.array(zero, zero, high, low))
        return F.when(size == 0, F.array(zero, F.lit(1).cast("bigint"), zero, zero)).when(bin_id > 0, F.array(*_largest_over(whole))).otherwise(below)

    found = F.transform(F.array(product), shown)[0]
    return F.when((size < 2**BITS) & squares.isNotNull() & F.coalesce(F.get(found, F.lit(0)).isNotNull(), F.lit(False)), found)


def as_double(four: Column) -> Column:
    """The number of four digits over 2^64, rounded once, to the nearest double."""
    number = [four[i].cast("decimal(10,0)") for i in range(4)]
    # the last byte only tells whether something follows, so 38 decimal places hold the rest
    last = F.shiftright(four[3], 8).bitwiseOR(F.when(four[3].bitwiseAND(F.lit(255).cast("bigint")) != 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    large = (number[0] * _whole(2**88) + (number[1] * _whole(2**56)).cast("decimal(30,0)") + (number[2] * _whole(2**24)).cast("decimal(20,0)") + last.cast("decimal(10,0)")).cast("decimal(38,0)")
    small = (number[2] * _whole(2**32) + number[3]).cast("decimal(20,0)")
    above = (four[0] > 0) | (four[1] > 0)
    return F.when(above, large.cast("double") / float(2**56)).otherwise(small.cast("double") / float(2**64))


def price(bin_id: Column, squares: Column) -> Column:
    """The price of a bin as a double, given the step's ladder; null where it overflows."""
    return F.transform(F.array(digits(bin_id, squares)), as_double)[0]


def exact_price(bin_id: Column, bin_step: Column) -> Column:
    """price with the ladder made on the spot, for few rows."""
    return price(bin_id, ladder(bin_step))
