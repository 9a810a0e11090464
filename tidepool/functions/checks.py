"""Rationale items: what was compared with what, and whether it passed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<signal: string, observed: double, cmp: string, threshold: double, passed: boolean>"


def _item(signal: str, observed: Column, cmp: str, threshold: Column, passed: Column) -> Column:
    return F.struct(F.lit(signal).alias("signal"), observed.cast("double").alias("observed"), F.lit(cmp).alias("cmp"), threshold.cast("double").alias("threshold"), passed.alias("passed"))


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def check(signal: str, observed: Column, cmp: str, threshold: Column | float) -> Column:
    """A comparison with >=, <= , < or >. A null or NaN observation fails: Spark orders NaN above all numbers, so it is
    tested for apart."""
    limit = _column(threshold)
    ops = {">=": observed >= limit, "<=": observed <= limit, "<": observed < limit, ">": observed > limit}
    return _item(signal, observed, cmp, limit, F.coalesce(ops[cmp] & ~F.isnan(observed.cast("double")), F.lit(False)))


def optional(signal: str, observed: Column, cmp: str, threshold: Column | float) -> Column:
    """A comparison of an input that may be unavailable: then it is noted as NaN and passes."""
    missing = _item(signal, F.lit(float("nan")), cmp, _column(threshold), F.lit(True))
    return F.when(observed.isNull(), missing).otherwise(check(signal, observed, cmp, threshold))


def info(signal: str, observed: Column) -> Column:
    """An observation that is only recorded."""
    return _item(signal, observed, ">=", observed, F.lit(True))


def passed(items: Column) -> Column:
    return F.forall(items, lambda i: i["passed"])


def as_text(item: Column) -> Column:
    """`signal observed cmp threshold`, with `not measured` for NaN."""
    number = F.when(F.isnan(item["observed"]) | item["observed"].isNull(), F.lit("not measured")).otherwise(F.round(item["observed"], 6).cast("string"))
    return F.concat_ws(" ", item["signal"], number, item["cmp"], F.round(item["threshold"], 6).cast("string"))
