"""Sinks: idempotent appends, upserts with merge rules, retention, clustering, and an audit of constraints.

The merges are frames to frames, so that a job can write their result in whatever layout it keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.sources import tables


def new_rows(batch: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """The batch's rows, once for each key, that the target doesn't hold: appending them twice changes nothing."""
    return batch.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def of_days(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The target's rows of the batch's days: of a table partitioned by day only those partitions are read."""
    return target.filter(F.col("day").isin([r.day for r in batch.select("day").distinct().collect()]))


def append_new(batch: DataFrame, path: str, key: Sequence[str], partition: Sequence[str] = (), time: str | None = None) -> None:
    """Appends the batch's new rows to a parquet table, which need not exist yet. With `time`, a column of the key in
    epoch seconds, the table is partitioned by its day first, and only the partitions of the batch's days are read."""
    spark = batch.sparkSession
    if time:
        batch, partition = batch.withColumn("day", F.floor(F.col(time) / 86_400)), ["day", *partition]
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    target = spark.read.parquet(path) if there else None
    if there and time:
        target = of_days(target, batch)
    rows = new_rows(batch, target, key) if there else batch.dropDuplicates(list(key))
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def append_parts(batch: DataFrame, parts: dict[str, Sequence[str]], key: Sequence[str]) -> None:
    """Appends one batch to several tables that belong together, path to columns (the key among them). The batch is
    computed once; if a run breaks off between two tables, running it again completes the second and leaves the first."""
    batch = batch.persist()
    try:
        for path, columns in parts.items():
            append_new(batch.select(*columns), path, key)
    finally:
        batch.unpersist()


def last_wins(target: DataFrame, batch: DataFrame, key: Sequence[str], updated: str) -> DataFrame:
    """Target and batch with each key's newest row; of equal times the batch's."""
    both = target.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.desc(updated), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def merged(target: DataFrame, batch: DataFrame, key: Sequence[str], keep: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Upsert in which columns of `keep` stay as they were in the target, those of `first` stay unless null, and the
    others take the batch's value."""
    old, new = target.alias("o"), batch.alias("n")
    on = F.lit(True)
    for k in key:
        on &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    was, came = F.col("o.__there").isNotNull(), F.col("n.__there").isNotNull()
    old, new = target.withColumn("__there", F.lit(1)).alias("o"), batch.withColumn("__there", F.lit(1)).alias("n")
    out = []
    for c in target.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            value = F.coalesce(o, n)
        elif c in keep:
            value = F.when(was, o).otherwise(n)
        elif c in first:
            value = F.coalesce(o, n)
        else:
            value = F.when(came, n).otherwise(o)
        out.append(value.alias(c))
    return old.join(new, on, "full_outer").select(*out)


def first_write(target: DataFrame, updates: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that are still null in the target take the update's value; set ones stay."""
    own = updates.select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = target.join(own, list(key), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in target.columns])


def retained(rows: DataFrame, time: str, days: int, now: int) -> DataFrame:
    """Rows not older than so many days."""
    return rows.filter(F.col(time) >= now - days * 86400)


def retire(spark: SparkSession, where: str, policy: DataFrame, now: int, unit: int = 86_400) -> list[str]:
    """Drops the day partitions of tables below `where` that a policy (table, days) no longer keeps, and returns their
    paths. A day goes when all of it is older than its table's days; no file is read or rewritten. Tables without a
    policy, and those that don't exist, are left alone. The policy is a table of a row per table."""
    gone = []
    for r in policy.select("table", "days").distinct().collect():
        folder, cutoff = tables.Folder(spark, f"{where}/{r.table}"), (now - r.days * unit) // unit
        for name in folder.names():
            if name.startswith("day=") and name[4:].lstrip("-").isdigit() and int(name[4:]) < cutoff:
                folder.delete(name)
                gone.append(f"{r.table}/{name}")
    return sorted(gone)


def clustered(rows: DataFrame, key: str, time: str, partitions: int) -> DataFrame:
    """Rows dealt by key and sorted by key and falling time within each file, for a rewrite of cold partitions. Keys
    are dealt with a day's salt, so a hot key's days spread over files."""
    return rows.repartition(partitions, key, F.floor(F.col(time) / 86400)).sortWithinPartitions(key, F.desc(time))


def audited(rows: DataFrame, key: Sequence[str], sets: dict[str, tuple[str, Sequence]], unique: dict[str, Sequence[str]]) -> DataFrame:
    """rule, key of every broken rule of one table: `sets` are allowed values of columns (null is allowed), `unique` are
    columns that together occur once (rows with a null in them are left aside). All rules take one scan and one shuffle:
    each row gives its outsiders and its unique values, and values that occur twice are broken. The key of a set rule is
    that of the row, of a unique rule the repeated value."""
    text = lambda columns: F.concat_ws("|", *columns)
    found = [F.when(~F.col(c).isin(*allowed), F.struct(F.lit(rule).alias("rule"), text(key).alias("key"), F.lit(True).alias("broken"))) for rule, (c, allowed) in sets.items()]
    for rule, columns in unique.items():
        whole = F.lit(True)
        for c in columns:
            whole &= F.col(c).isNotNull()
        found.append(F.when(whole, F.struct(F.lit(rule).alias("rule"), text(columns).alias("key"), F.lit(False).alias("broken"))))
    each = rows.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")
    counts = each.groupBy("rule", "key").agg(F.count("*").alias("n"), F.bool_or("broken").alias("broken"))
    return counts.filter("broken or n > 1").select("rule", "key")


def duplicate_keys(rows: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *key).alias("key"))


def orphans(rows: DataFrame, key: Sequence[str], parents: DataFrame, column: str, rule: str) -> DataFrame:
    missing = rows.filter(F.col(column).isNotNull()).join(parents.select(column).distinct(), column, "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.concat_ws("|", *key).alias("key"))


def outside_set(rows: DataFrame, key: Sequence[str], column: str, allowed: Sequence, rule: str) -> DataFrame:
    return rows.filter(~F.col(column).isin(*allowed)).select(F.lit(rule).alias("rule"), F.concat_ws("|", *key).alias("key"))
