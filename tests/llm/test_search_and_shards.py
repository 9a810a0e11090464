"""Exact search, sharding and packing against brute force and their laws."""

from __future__ import annotations

import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tests.conftest import SF
from tidepool.llm import packing, sharding, topk


def scores(vectors, queries, top):
    out = {}
    for q, x in queries:
        best = sorted((-int(np.dot(np.floor(np.float64(x) * 256), np.floor(np.float64(y) * 256))), v) for v, y in vectors if v != q and len(y) == len(x))[:top]
        out |= {(q, i + 1): (v, -s) for i, (s, v) in enumerate(best)}
    return out


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def test_search_equals_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = {(q, r): (v, s) for q, r, v, s in con.sql(topk.OP2_SQL).fetchall()}
    assert found(topk.op2_exact_topk(spark, SF)) == want


@pytest.mark.parametrize("d", [1, 3, 16, 40])
def test_search_with_ties_and_many_blocks(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, d) / 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert found(topk.top_k(df, df.filter("vec_id % 50 = 0"))) == scores(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_search_of_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, []), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [3.0, 4.0]), (None, [9.0, 9.0]), (4, [1.0]), (5, [3.0, 4.0]), (200, [1e4, 1e4]), (6, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "score")
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert found(topk.top_k(df, df.filter("vec_id % 50 = 0"))) == scores(good, [g for g in good if g[0] % 50 == 0], 5)
    assert topk.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found(topk.top_k(df, df.filter("vec_id = 0"))) == {(0, 1): (1, 256 * 512)}


def test_shards(spark):
    rows = sharding.op8_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and 0 <= r.shard < 16
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_the_winners_of_the_law(spark):
    """Every key's shard recomputed with another implementation of the hash."""
    weights = [1.0, 2.5, 1.0, 0.5]

    def winner(key):
        def score(shard):
            h = xxhash.xxh64(struct.pack("<i", shard), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
            return -weights[shard] / math.log(((h >> 11) + 0.5) / 2.0**53)

        return max(range(4), key=score)

    docs = spark.createDataFrame([(i * i - 50, "x") for i in range(500)], "doc_id long, text string")
    assert all(r.shard == winner(r.doc_id) for r in sharding.sharded(docs, weights).collect())


def test_blocks_of_queries_are_freed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 90)
    rows = [(i, [float(i * 7 % 11), float(i % 5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(topk.top_k(df, df.filter("vec_id % 10 = 0"))) == scores(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_shards_by_weight_and_by_key_alone(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    counts = {r.shard: r["count"] for r in sharding.sharded(ids, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert counts[1] / 20_000 == pytest.approx(0.75, abs=0.02)
    whole = {r.doc_id: r.shard for r in sharding.sharded(ids, [1.0] * 16).collect()}
    part = sharding.sharded(ids.filter("doc_id % 7 = 3"), [1.0] * 16).collect()
    assert all(whole[r.doc_id] == r.shard for r in part)
    moved = sharding.sharded(ids, [1.0] * 16).filter("grown_shard <> shard").count()
    assert moved / 20_000 == pytest.approx(1 / 17, abs=0.01)


def test_slots_stay_gapless_over_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_GROUP", 4)
    ids = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    slots = {}
    for r in sharding.sharded(ids, [1.0] * 16).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_awkward_rows(awkward, nothing):
    rows = sharding.sharded(awkward, [1.0] * 16).collect()
    assert len(rows) == awkward.count() and next(r for r in rows if r.doc_id == 0).size == 1
    assert sharding.sharded(nothing, [1.0] * 16).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing._vocabulary())


def holds(rows, texts, tokenizer):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(sequences), sum(r.length for r in rows)


def test_packing_is_a_round_trip(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, tokens = holds(packing.op5_packing(spark, SF).collect(), texts, tokenizer)
    assert tokens / (4096 * n) > 0.95


def test_packing_of_awkward_rows(spark, awkward, nothing, tokenizer):
    rows = awkward.dropDuplicates(["doc_id"])
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    holds(packing.packed(rows, packing._vocabulary()).collect(), texts, tokenizer)
    assert packing.packed(awkward, packing._vocabulary()).count() > awkward.count()
    assert packing.packed(nothing, packing._vocabulary()).count() == 0


def test_words_alone_encode_as_in_the_text(tokenizer):
    encoder = packing.Encoder(packing._vocabulary())
    for text in ["It's they're WE'LL don't ''s x'd", "a.b,c;;d -- e__f 12 3.4 ÉÀß ñandú", "<|endoftext|> x", "ß²½ ªº µ ÿ Ĳ ŉ", "é    x", "a'b 'tis 's", "x" * 300]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    sizes = [5, 7, 5, 2, 4, 2, 5, 1, 6]
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(10)
        room[b] -= sizes[i]
        want[i] = b
    assert packing.first_fit_decreasing(sizes, 10) == want
