"""How two tokenizers cut the same texts, and which of their tokens end together (operator 13).

Every task cuts its texts into runs. A run holds its pair-document records in side-major order, by B id, then A id, then
document, compressed with zstd, and is one row of a written table. Counts go through Spark's shuffle, which deals the
pairs of the runs by hash, spills and merges them: first each pair's count, then the highest count of each B id. What
flows back to a run is one row for each of its distinct pairs, so a pair that stands in every document is no larger
group than there are runs.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, if_small, materialised, salted_join, table

#: Bytes of text of one run, and of the texts that are encoded together.
RUN_BYTES = 8_000_000
#: Segments that a worker remembers; it starts afresh when there are more. Longer segments are not remembered.
REMEMBERED, LONGEST = 500_000, 64
#: Bits of an A id in a pair's code, and of a document's number in a record's.
A_BITS, DOC_BITS = 20, 23
#: A text may be cut before a space that follows a sign which is surely no white space: no token of either kind
#: reaches across, and white space before a word stays with it. The last space of a text is no segment of its own.
_CUT = re.compile(r"(?<=[!-~\w]) (?!\Z)")
#: Segments of these characters are encoded by the second implementation of A, which splits them by the pattern below as
#: the first one does; it takes a tenth of the time. Characters that versions of Unicode class differently are left out.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1\xa4-\xb1\xb4\xb6-\xb8\xba\xbb\xbf-įĲ-ňŊ-ž]*")
# Fixed value: how byte-level encoding splits a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_DOC = "struct<doc_id: long, n_a: long, n_b: long, n_groups: long, groups_sha256: string>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 signs for themselves, the
    others by letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Segments:
    """Both tokenizers, and what is known of segments of texts: ids, groups and links."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.a = Tokenizer.from_file(vocabulary)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode() for t, i in self.a.get_vocab().items()}
        ranks = {raw: i for i, raw in self.bytes_a.items() if i not in self.a.get_added_tokens_decoder()}
        self.fast = tiktoken.Encoding("fast", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes.fromhex(m[1]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in pieces}
        self.apart = not any(re.search("[^▁]▁", p) for _, p in pieces)  # else no cut is safe
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.good, self.codes = array("q"), array("q"), array("q"), array("b"), array("q")

    def of(self, text: str) -> list[str]:
        """The segments of a text with a space before it, each without the space that it begins with."""
        return _CUT.split(text) if self.apart else [text]

    def learn(self, segments: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [s for s in segments if s not in self.known]
        for part in (new[i : i + 2000] for i in range(0, len(new), 2000)):
            for segment, ids_b in zip(part, self.b.encode(part, num_threads=1), strict=True):
                self._add(segment, self.ids_a(segment), ids_b)

    def ids_a(self, segment: str) -> list[int]:
        return self.fast.encode_ordinary(f" {segment}") if _PLAIN.fullmatch(segment) else self.a.encode(f" {segment}", add_special_tokens=False).ids

    def _add(self, segment: str, ids_a: list[int], ids_b: list[int]) -> None:
        raw = f" {segment}".encode()
        own_a, own_b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        good = b"".join(own_a) == raw and b"".join(own_b) == raw
        groups, codes, i, j, m, at = [], self.codes, 0, 0, 0, 0
        if good:
            ends_b = list(itertools.accumulate(map(len, own_b)))
            for n, one in enumerate(own_a, 1):
                at += len(one)
                while ends_b[m] < at:
                    m += 1
                if ends_b[m] == at:
                    m += 1
                    a, b = ids_a[n - 1], ids_b[m - 1]
                    groups.append(f"{a}|{b}" if n - i == m - j == 1 else f"{','.join(map(str, ids_a[i:n]))}|{','.join(map(str, ids_b[j:m]))}")
                    codes.append(b << A_BITS | a)
                    i, j = n, m
        self.known[segment] = len(self.texts)
        self.texts.append(";".join(groups))
        self.n_a.append(len(ids_a))
        self.n_b.append(len(ids_b))
        self.n_groups.append(len(groups))
        self.good.append(good)

    def aligned(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray]:
        """Each text's tokens of both kinds, its groups and their digest; and the records of all texts, sorted: code
        of the pair and number of the text, and how many of the text's links hold the pair."""
        cut = [self.of(t) if t else [] for t in texts]
        self.learn({s for segments in cut for s in segments if len(s) <= LONGEST})
        mark, codes_mark = len(self.texts), len(self.codes)
        for segments in cut:
            long = {s for s in segments if len(s) > LONGEST}
            self.learn_long(long)
        places = [[self.known[s] for s in segments] for segments in cut]
        n_a, n_b, n_groups, good, codes = (np.array(x, dtype=np.int64) for x in (self.n_a, self.n_b, self.n_groups, self.good, self.codes))
        starts = np.cumsum(n_groups) - n_groups
        documents, found = [], []
        for number, at in enumerate(places):
            own = np.array(at, dtype=np.int64)
            if not len(own) or not good[own].all():
                documents.append((0, 0, 0, ""))
                continue
            digest = hashlib.sha256(";".join([self.texts[i] for i in at]).encode()).hexdigest()
            counts = n_groups[own]
            documents.append((int(n_a[own].sum()), int(n_b[own].sum()), int(counts.sum()), digest))
            every = np.arange(int(counts.sum())) + np.repeat(starts[own] - (np.cumsum(counts) - counts), counts)
            found.append(codes[every] << DOC_BITS | number)
        self.forget_from(mark, codes_mark)
        keys, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return documents, keys, times

    def learn_long(self, segments: set[str]) -> None:
        for s in segments:
            if s not in self.known:
                self._add(s, self.ids_a(s), self.b.encode(s))

    def forget_from(self, mark: int, codes_mark: int) -> None:
        """Forgets the long segments that were learned last."""
        for s in [s for s, i in self.known.items() if i >= mark] if len(self.texts) > mark else ():
            del self.known[s]
        del self.texts[mark:], self.codes[codes_mark:]
        for x in (self.n_a, self.n_b, self.n_groups, self.good):
            del x[mark:]


@cache
def _segments(vocabulary: str, model: str) -> Segments:
    return Segments(vocabulary, model)


def _packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted records as differences, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(keys, prepend=np.int64(0)).tobytes() + times.astype(np.uint32).tobytes())


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _runs(vocabulary: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, number = _segments(vocabulary, model), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks([t or "" for t in texts], RUN_BYTES):
                documents, keys, times = segments.aligned(texts[a:b])
                docs = [{"doc_id": d, "n_a": x[0], "n_b": x[1], "n_groups": x[2], "groups_sha256": x[3]} for d, x in zip(ids[a:b], documents, strict=True)]
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]))
                yield pa.RecordBatch.from_pydict({"run": pa.array([number], pa.int64()), "docs": pa.array([docs], kind), "records": pa.array([_packed(keys, times)], pa.binary())})
                number += 1

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's distinct pairs with how many of its links hold them."""
    for batch in batches:
        for number, block in zip(batch.column("run").to_pylist(), batch.column("records").to_pylist(), strict=True):
            keys, times = _unpacked(block)
            if len(keys):
                code = keys >> DOC_BITS
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(first), number)), "code": pa.array(code[first]), "c": pa.array(np.add.reduceat(times, first))})


def _given_back(runs: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one run with what its pairs' counts give each of them."""
    code, n, best = (counted.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    code, n, best = code[order], n[order], best[order]
    out = []
    for docs, block in zip(runs.column("docs").to_pylist(), runs.column("records").to_pylist(), strict=True):
        keys, times = _unpacked(block)
        at, doc = np.searchsorted(code, keys >> DOC_BITS), keys & ((1 << DOC_BITS) - 1)
        sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        np.add.at(sums, doc, times * n[at])
        np.add.at(bests, doc, times * best[at])
        out += [d | {"n_links": d["n_groups"], "n_best": int(x), "count_sum": int(y)} for d, x, y in zip(docs, bests, sums, strict=True)]
    fields = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _RESULT.split(", ")]
    return pa.Table.from_pylist(out, schema=pa.schema(fields))


def alignments(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A and B encode a space and the text. Where tokens of both end at the same byte, a group ends, and its last tokens
    are linked; no other tokens end together, so there are as many links as groups. A pair's count is the number of
    links of all documents that hold it; n_best counts the links whose pair has the highest count of its B id, ties
    included; count_sum adds up the counts of all links. Texts that are null or empty, or whose joined tokens give
    other bytes, have zeros and an empty digest. Every row counts by itself, also if it repeats another one or has no
    doc_id. Columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    runs = materialised(rows.mapInArrow(_runs(vocabulary, model), f"run long, docs array<{_DOC}>, records binary"), "runs")
    pairs = runs.select("run", "records").mapInArrow(_pairs, "run long, code long, c long")
    totals = pairs.groupBy("code").agg(F.sum("c").alias("n"), F.count("*").alias("runs"))
    highest = F.max("n").over(W.partitionBy(F.shiftright("code", A_BITS)))  # of a B id at most one row for each A id
    counted = materialised(totals.withColumn("best", (F.col("n") == highest).cast("long")), "counted")
    wanted, small = pairs.select("run", "code"), if_small(counted)
    back = salted_join(wanted, counted, "code", count="runs") if small is counted else wanted.join(small, "code")
    return runs.groupBy("run").cogroup(back.select("run", "code", "n", "best").groupBy("run")).applyInArrow(_given_back, _RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), byte_vocabulary(), piece_model())
