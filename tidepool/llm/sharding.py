"""Weighted rendezvous sharding of stable record keys, with DataFrame functions only (operator 8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import table, unused

#: Rows that one slot-numbering group holds on average.
ROWS_A_GROUP = 4096


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(u), where u in (0, 1) is a hash of key and shard. A further
    shard only takes keys into itself; a shard's share is its weight's. A null key is hashed as such."""
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def with_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. Rows of a shard are numbered in hashed groups of a bounded mean
    size, on top of the counts of the groups before, so no task holds a whole shard."""
    groups = max(1, rows.count() // (ROWS_A_GROUP * 16) + 1)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = W.partitionBy("shard").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("shard", "_group").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("shard", "_group").orderBy(*order))
    placed = rows.withColumn("_row", within).join(bases, ["shard", "_group"])
    return placed.withColumn("slot", F.col("_base") + F.col("_row") - 1).drop("_group", "_base", "_row")


def sharded(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `key`: doc_id and the weights alone decide. A null text counts as empty in text_crc32 and as no
    bytes in size; null and repeated doc_ids are placed like any other key; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, new_weight]).alias("grown_shard"),
    )
    placed = with_slots(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float]) -> None:
    """Writes docs as Parquet partitioned by shard (shard_ where docs has such a column)."""
    (shard,) = unused(docs, "shard")
    docs.withColumn(shard, rendezvous_shard(F.col("doc_id"), weights)).repartition(F.col(shard), F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy(shard).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), [1.0] * 16)
