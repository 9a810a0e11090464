"""Shared helpers of the training-data operators: tables, materialised steps and batch-wise word hashing.

Word hashing works on whole Arrow batches with numpy. A word's 64-bit hash is the sum of the mixed values of its
8-byte blocks, each mixed with its place, mixed once more with the word's length, so bytes and blocks that change
places change the hash. Words are split at byte classes, which is exact for UTF-8 because both word patterns in use
treat every non-ASCII character as part of a word.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import shared_dir

#: Bytes hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20240501)
_ODD = _RANDOM.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STEPS: dict[str, SparkSession] = {}
_SCOPE = threading.local()


def _drop(paths: Sequence[str]) -> None:
    """Deletes step folders, wherever they are; one that is gone already is no error."""
    for path in paths:
        spark = _STEPS.pop(path, None)
        if spark is not None:
            with contextlib.suppress(Exception):  # at exit the session may have ended
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(lambda: _drop(list(_STEPS)))


@contextlib.contextmanager
def steps_until_written() -> Iterator[None]:
    """Steps written inside are deleted at the end. For callers that write their result within."""
    before, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        _drop(_SCOPE.paths)
        _SCOPE.paths = before


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors. The folder is
    deleted when the surrounding `steps_until_written` or the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STEPS[path] = spark
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_texts(rows: DataFrame, name: str = "own") -> DataFrame:
    """rows (doc_id, text, ...) with a column, so that (doc_id, own) names one text: a hash of the text, or 0 in all
    rows if no doc_id has several texts. Rows equal in both are one document. Null ids are left aside."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    return rows.withColumn(name, F.lit(0).cast("long") if texts.filter("low <> high").isEmpty() else own)


#: Most bytes of keys that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: Rows of one key that one task may read; a key with more is dealt over several.
HOT_ROWS = 20_000


def if_small(keys: DataFrame) -> DataFrame:
    """keys marked for broadcast where rows, strings and arrays together are counted to be few bytes. Call it on
    materialised keys."""
    wide = [F.octet_length(c) if t in ("string", "binary") else F.size(c) * 12 for c, t in keys.dtypes if t in ("string", "binary") or t.startswith("array")]
    size = F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(24 + 8 * len(keys.columns))).cast("long"))
    return F.broadcast(keys) if (keys.agg(size).first()[0] or 0) <= BROADCAST_BYTES else keys


def salted_join(many: DataFrame, one: DataFrame, on: str, hot: int = HOT_ROWS, count: str | None = None) -> DataFrame:
    """Inner join of many rows a key with `one`, which has few. A key of more than `hot` rows in `many` is dealt over
    several tasks, and its rows of `one` are repeated in each. `count` names the column of `one` that holds each key's
    number of rows; without it they are counted, which reads `many` once more."""
    (salt,) = unused(many.join(one.limit(0), on), "salt")
    counted = one.select(on, F.col(count).alias(salt)) if count else many.groupBy(on).agg(F.count("*").alias(salt))
    often = counted.filter(F.col(salt) > hot).withColumn(salt, F.ceil(F.col(salt) / hot).cast("int"))
    if often.isEmpty():
        return many.join(one, on)
    often = if_small(materialised(often, "hot"))
    share = F.pmod(F.xxhash64(*[c for c in many.columns if c != on]), F.coalesce(salt, F.lit(1))).cast("int")
    dealt = many.join(often, on, "left").withColumn(salt, share)
    copies = one.join(often, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salt, F.lit(1)) - 1)))
    return dealt.join(copies, [on, salt]).drop(salt)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo a number: the fixed train / held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """True for bytes that belong to words: all but those in the given inclusive ranges."""
    words = np.ones(256, dtype=bool)
    for low, high in outside:
        words[low : high + 1] = False
    return words


#: [^\x20\x09-\x0D]+
SPACED_WORDS = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text lower-cased in A-Z
PLAIN_WORDS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of at most `limit` bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of neighbouring rows of at most `limit` bytes in a column (a larger row is alone), so
    that a task holds few of a batch's texts as Python strings, however long they are. What Arrow has freed meanwhile
    goes back after each batch, as workers live on into the next stages."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def folded_bytes(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased (bytes.lower touches ASCII only); null as empty."""
    return [b"" if t is None else t.encode("utf-8").lower() for t in texts]


def word_hashes(raw: Sequence[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (len(raw) + 1 entries)."""
    return placed_word_hashes(raw, words)[:2]


def _words(raw: Sequence[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a newline after each as one buffer, where each text begins (len(raw) + 1 entries), and the first
    and one past the last byte of each word and its hash."""
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = words[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
    hashes = _hashed(buf, starts, ends - starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    return buf, text_starts, starts, ends, hashes


def placed_word_hashes(raw: Sequence[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, and each word's first and one past its last code point in its text."""
    buf, text_starts, starts, ends, hashes = _words(raw, words)
    bounds = np.searchsorted(starts, text_starts)
    if not len(starts):
        return hashes, bounds, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if (buf < 0x80).all():
        point, origin = np.arange(len(buf) + 1), text_starts
    else:
        point = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # code points before each byte
        origin = point[text_starts]
    own = np.repeat(origin[:-1], np.diff(bounds))
    return hashes, bounds, point[starts] - own, point[ends] - own


def line_word_hashes(raw: Sequence[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each line's words begin (one more entry), each line's text, and where each text's
    lines begin (one more entry). Newlines must not be parts of words."""
    buf, text_starts, starts, _, hashes = _words(raw, words)
    line_starts = np.concatenate(([0], np.flatnonzero(buf == 10) + 1))  # the last one is the buffer's end
    firsts = np.searchsorted(line_starts, text_starts)
    owner = np.repeat(np.arange(len(raw)), np.diff(firsts))
    return hashes, np.searchsorted(starts, line_starts), owner, firsts


_KEEP = np.array([0, *((1 << (8 * n)) - 1 for n in range(1, 9))], dtype=np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _hashed(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words at the given starts. A word is read in blocks of eight bytes, the last one cut to length."""
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))
    total = mix((eight[starts] & _KEEP[np.minimum(lengths, 8)]) ^ _PLACE)
    if len(longer := np.flatnonzero(lengths > 8)):
        blocks = (lengths[longer] - 1) // 8
        first = np.cumsum(blocks) - blocks
        at = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks) + 1
        begin = np.repeat(starts[longer], blocks) + 8 * at
        left = np.repeat(lengths[longer], blocks) - 8 * at
        value = mix((eight[begin] & _KEEP[np.minimum(left, 8)]) ^ mix((at + 1).astype(np.uint64) * _PLACE))
        total[longer] += np.add.reduceat(value, first)
    return mix(total ^ (lengths.astype(np.uint64) * _PLACE))


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as hashes; fewer words count as one shingle, none as no shingle."""
    return shingles_between(hashes, bounds[:-1], bounds[1:], k)


def shingles_between(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """shingle_sets of given runs of words."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled += hashes[j : n - k + 1 + j] * _ODD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(begins, ends, strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
