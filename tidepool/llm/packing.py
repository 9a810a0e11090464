"""Packing of tokenised documents into fixed-length sequences by first-fit decreasing (operator 5)."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import materialised, table

SEQUENCE = 4096
END = 2
#: Pieces packed together, on average.
PIECES_A_GROUP = 4000
#: Words whose ids a worker keeps; the memory is emptied when it is full.
KNOWN_WORDS = 800_000

#: Words of the tokenizer's own split, for texts within the characters below.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Texts of only these characters are split by the pattern above exactly as the tokenizer splits them.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1\xa4-\xb1\xb4\xb6-\xb8\xba\xbb\xbf-įĲ-ňŊ-ž]*")


class _Known(dict):
    """Ids, as little-endian 32-bit bytes, of runs of characters between spaces; new ones are split into the
    tokenizer's words, which its model tokenizes one by one."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = tokenizer.model
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, run: str) -> bytes:
        if len(run) > 1 and run[-1] in ".,;:!?)" and run[:-1].isalpha():
            ids = self[run[:-1]] + self[run[-1]]
        else:
            found: list[int] = []
            for word in (run,) if run.isalpha() else _WORD.findall(run):
                found += [t.id for t in self.model.tokenize(word if word.isascii() else self.as_bytes(word)[0][0])]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(run) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[run] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, with the ids of words remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """The ids of the whole text. No token crosses white space, so runs between spaces are encoded one by one; a
        text with characters on which the two splits might differ, or with a special token's brackets, goes to the
        tokenizer as it is."""
        if "<|" in text or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, length: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        tail = np.asarray([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + tail
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if with_ids else None))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in list(zip(names, columns, kinds, strict=True))[: 5 + with_ids]})

    return run


class Bins:
    """First fit over open bins: a tournament tree holds the largest room below each node, so the first bin with
    enough room is found by one walk down."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        i = 1
        while i < self.leaves:
            i = 2 * i if self.room[2 * i] >= size else 2 * i + 1
        bin_ = i - self.leaves
        self.room[i] -= size
        while i > 1:
            i //= 2
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        return bin_


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, sizes taken from the largest, ties in order."""
    bins, out = Bins(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.put(sizes[i])
    return out


def _pack(capacity: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first")
        bins = first_fit_decreasing(pieces["length"].tolist(), capacity)
        pieces["sequence_id"] = (int(key[0]) << 32) + np.asarray(bins, dtype=np.int64)
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        return pieces.drop(columns="bucket")

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its token ids and the end id. Longer documents are cut at multiples of `length`; pieces are packed
    first-fit decreasing in random groups of about PIECES_A_GROUP. A null or empty text is the end id alone; rows
    with null or repeated doc_ids are packed like any others; an empty table gives no rows.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = materialised(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length, end, with_ids), fields), "pieces")
    groups = pieces.count() // PIECES_A_GROUP + 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(_pack(length), fields + ", sequence_id long, offset long")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), _vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left."""
    return packed(docs, _vocabulary())
