"""Exact top-k inner-product search by columnar branch and bound (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import materialised, table

TOP = 5
SCALE = 256
#: Bytes of the queries of one pass over the vectors, which bounds what is broadcast and what the driver holds.
QUERY_BYTES = 16_000_000
#: Dimensions accumulated between two compactions.
DIMENSIONS = 16
#: Vectors that are scored in full first, to have a bound to cut with.
FIRST = 64


def quantised(ids: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(scale * x) of the rows with an id and only finite components."""
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)  # nulls would make them floats
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & named
    out = {}
    for d in np.unique(lengths[good & (lengths > 0)]):
        rows = np.flatnonzero(good & (lengths == d))
        x = np.floor(values[offsets[rows][:, None] + np.arange(d)] * scale)
        fine = np.isfinite(x).all(axis=1)
        out[int(d)] = ids[rows[fine]], x[fine]
    return out


class Search:
    """The best scores so far of a block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, top: int):
        self.ids, self.queries, self.top = ids, queries, top
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)  # scores and vector ids
        d = queries.shape[1]
        self.blocks = [slice(a, min(a + DIMENSIONS, d)) for a in range(0, d, DIMENSIONS)]
        self.rest = [np.sqrt((queries[:, b.stop :] ** 2).sum(axis=1)) for b in self.blocks]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        for a in (slice(0, FIRST), slice(FIRST, None)):
            if len(part := order[a]):
                self._add(ids[part], vectors[part])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        most = np.abs(vectors).max(initial=0) * np.abs(self.queries).max(initial=0) * vectors.shape[1]
        kind = np.float64 if most < 2**53 else np.int64  # both are exact; floats multiply faster
        columns = np.ascontiguousarray(vectors.T).astype(kind)
        rest = [np.sqrt((vectors[:, b.stop :] ** 2).sum(axis=1)) for b in self.blocks]
        queries = self.queries.astype(kind)
        for lo in range(0, len(queries), 256):
            first = queries[lo : lo + 256, self.blocks[0]] @ columns[self.blocks[0]]
            for i, row in enumerate(first, lo):
                self._bound(i, queries[i], row, ids, columns, rest)

    def _bound(self, i: int, query: np.ndarray, partial: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: list[np.ndarray]) -> None:
        """Keeps the vectors whose partial score and largest possible remainder still reach the k-th best score."""
        scores, found = self.best[i]
        least = scores[-1] if len(scores) == self.top else None
        alive = None
        for n, block in enumerate(self.blocks):
            if n:
                part = columns[block] if alive is None else columns[block][:, alive]
                partial = partial + query[block] @ part
            if least is not None:
                mass = rest[n] if alive is None else rest[n][alive]
                keep = partial + mass * self.rest[n][i] * (1 + 1e-9) + 1e-6 >= least
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    partial = partial[keep]
                    if not len(alive):
                        return
        own = ids if alive is None else ids[alive]
        other = own != self.ids[i]
        scores = np.concatenate((scores, partial[other].astype(np.int64)))
        found = np.concatenate((found, own[other]))
        order = np.lexsort((found, -scores))[: self.top]
        self.best[i] = scores[order], found[order]


def _search(queries: Broadcast, scale: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(ids, x, top) for d, (ids, x) in queries.value.items()}
        for batch in batches:
            for d, (ids, x) in quantised(batch.column("vec_id"), batch.column("embedding"), scale).items():
                if d in searches and len(ids):
                    searches[d].add(ids, x)
        for s in searches.values():
            n = [len(scores) for scores, _ in s.best]
            if sum(n):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(s.ids, n)), "vec_id": pa.array(np.concatenate([v for _, v in s.best])), "score": pa.array(np.concatenate([x for x, _ in s.best]))})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `top` vectors by integer inner product of floor(scale * x), ties
    to the smaller vec_id, without vectors of the query's own id.

    Rows with a null id, a null or empty vector, or null, infinite or NaN components take no part; queries meet
    vectors of their own dimension only. Repeated query ids count once, repeated vectors are ranked one by one.
    Queries go in blocks of about QUERY_BYTES, each one pass over all vectors in which every task keeps its own
    best; of several blocks each is searched, written and freed before the next. Products must fit 63 bits. A table without queries gives no rows.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null and embedding is not null")
    rows, asked = usable(vectors), usable(queries)
    parts = (asked.agg(F.sum(F.size("embedding").cast("long") * 8 + 8)).first()[0] or 0) // QUERY_BYTES + 1
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= top)
    found = None
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).dropDuplicates(["vec_id"]).toArrow()
        if block.num_rows == 0:
            continue
        ids = block.column("vec_id").combine_chunks()
        sent = spark.sparkContext.broadcast(quantised(ids, block.column("embedding").combine_chunks(), scale))
        own = ranked(rows.mapInArrow(_search(sent, scale, top), "query_id long, vec_id long, score long"))
        if parts > 1:  # one block at a time on the driver and the executors
            own = materialised(own, "best")
            sent.destroy()
        found = own if found is None else found.union(own)
    if found is None:
        found = ranked(rows.filter("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")))
    return found.select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e)
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
