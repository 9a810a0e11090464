"""Near-duplicate documents by HyperMinHash (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import SPACED_WORDS, by_bytes, chunks, folded_bytes, if_small, materialised, own_texts, shingle_sets, table, unused, word_hashes
from tidepool.llm.near_dup import SKETCH_FIELDS, classes, sketch_columns


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            raw = folded_bytes(batch.column("text").to_pylist())
            for a, b in chunks(raw):
                sets = shingle_sets(*word_hashes(raw[a:b], SPACED_WORDS), k)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(a, b - a)} | sketch_columns(sets))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            raw = folded_bytes(batch.column("text").to_pylist())
            for a, b in chunks(raw):
                sets = shingle_sets(*word_hashes(raw[a:b], SPACED_WORDS), k)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(a, b - a), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _components(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component, n) of every row (id, text), of any ordered type of id; rows of one id should have one text."""
    kind = rows.schema["id"].dataType.simpleString()
    sketches = materialised(rows.mapInArrow(_sketches(k), f"id {kind}, {SKETCH_FIELDS}"), "sketches")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = rows.join(if_small(materialised(ids, "ids")), "id", "left_semi")
        return wanted.mapInArrow(_sets(k), f"id {kind}, shingles binary").dropDuplicates(["id"])

    found = classes(sketches.select("id", "n", "lo", "hi", "registers"), sets_of, percent)
    return found.union(sketches.filter("n = 0").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Words are split at spaces and lower-cased in A-Z; a set holds the distinct k-word shingles, or the whole
    sequence if there are fewer words. Documents are linked at `percent` Jaccard similarity and a component's
    smallest doc_id is kept. Null and empty texts have an empty set, are linked with nothing and kept. Rows with a
    null doc_id take no part. Rows that share a doc_id are given one row each, and each is linked by its own text.
    Other columns are ignored.
    """
    rows = own_texts(docs.filter("doc_id is not null").select("doc_id", "text"))
    found = _components(rows.select(F.struct("doc_id", "own").alias("id"), "text"), k, percent)
    own, first = F.col("id.doc_id"), F.col("component.doc_id")
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), first.alias("component_id"), (own == first).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with recursive d as materialized (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents where doc_id is not null),
s as materialized (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as k from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
links as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by 1, 2)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id, d.doc_id <= coalesce(m.c, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join (select a, min(b) as c from reach group by a) m on m.a = d.doc_id
"""


def _key() -> Column:
    """Orders rows by doc_id with nulls last, then by a fingerprint of the text. No part is null."""
    of_id, of_text = F.coalesce("doc_id", F.lit(0).cast("long")), F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), of_id.alias("doc_id"), of_text.alias("text"))
    return key.cast("struct<none: boolean, doc_id: bigint, text: binary>")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies; all columns stay.

    Every row counts by itself and by its own text, whether or not it has a doc_id or shares one. The row that is
    first by doc_id, nulls last, and then by a fingerprint of its text stays; of rows equal in both, the least by the
    other columns. A row with a null doc_id goes only if another row near to it stays. Rows without words all stay.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key, row = unused(docs, "key", "row")
    keyed = docs.filter(worded).withColumn(key, _key())
    found = _components(keyed.select(F.col(key).alias("id"), "text"), k, percent)
    kept = materialised(found.filter("id = component").groupBy(F.col("id").alias(key)).agg(F.count("*").alias("c")), "kept")
    single = keyed.join(kept.filter("c = 1").select(key), key, "left_semi")
    equal = keyed.join(if_small(kept.filter("c > 1").select(key)), key, "left_semi")
    first = equal.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return docs.filter(~worded).union(single.select(*docs.columns)).union(first)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, as one_of_each says, with five-word shingles."""
    return one_of_each(docs)
