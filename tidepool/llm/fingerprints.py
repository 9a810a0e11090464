"""Document fingerprints from improbable features (operator 12).

Every byte window of a text has an entropy level; windows of levels that are rare in the whole corpus are improbable. A
window is chosen if it is the most improbable one of enough neighbourhoods that it lies in. Chosen windows are hashed
into Bloom filters, a new one being chained on where the last is full, and two fingerprints are compared by the bits
their filters share beyond what chance gives. All of a batch's texts are worked on together with numpy.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, if_small, materialised, mix, salted_join, table

#: Bytes of a window, and windows of a neighbourhood.
WINDOW, NEIGHBOURS = 16, 32
#: Neighbourhoods of which a window has to be the most improbable one, and windows that a text with fewer gets.
POPULAR, FEWEST = 8, 16
LEVELS = 512
#: Bits of a filter, hash functions, and features of a full filter.
BITS, HASHES, FEATURES = 2048, 5, 160
#: Share of the span between chance and the most possible that common bits must exceed.
CUT = 0.1
#: Text of one range of documents, and how many ranges there may be: their bounds go to every task.
RANGE_BYTES, RANGES = 64_000_000, 50_000
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ODD = np.random.default_rng(12).integers(0, 2**64, size=WINDOW, dtype=np.uint64) | np.uint64(1)


def _entropy_gains(window: int) -> np.ndarray:
    """What the c-th equal byte of a window adds to the sum of c * log2(c), in 1/65536."""
    whole = [round(65536 * c * math.log2(c)) if c else 0 for c in range(window + 1)]
    return np.diff(np.array(whole, dtype=np.int64), prepend=0)


_GAIN = _entropy_gains(WINDOW)
_MOST = int(_GAIN.sum())


def window_levels(buf: np.ndarray) -> np.ndarray:
    """The entropy level of the window at each place of a buffer of at least WINDOW bytes: LEVELS - 1 if all its bytes
    differ, 0 if all are equal. The sum of c * log2(c) over a window's bytes changes by one byte in and one out."""
    before, after = np.ones((2, len(buf)), np.uint8)  # equal bytes among the last and the next WINDOW, itself included
    for k in range(1, WINDOW):
        same = (buf[k:] == buf[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    total = np.concatenate(([0], np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[: len(buf) - WINDOW]])))
    total += sum(int(_GAIN[: c + 1].sum()) for c in np.bincount(buf[:WINDOW]))
    return (_MOST - total) * (LEVELS - 1) // _MOST


def _least_places(rank: np.ndarray, reach: int) -> np.ndarray:
    """The place of the first least rank of each `reach` neighbours, by doubling."""
    key, span = (rank.astype(np.int64) << 32) | np.arange(len(rank)), 1
    while span < reach:
        step = min(span, reach - span)
        key = np.minimum(key[: len(key) - step], key[step:])
        span += step
    return key & 0xFFFFFFFF


def _joined(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, shorter ones filled up to a window by zeros; where each begins; and how many
    windows it has."""
    filled = [r.ljust(WINDOW, b"\0") if r else r for r in raws]
    lengths = np.array([len(r) for r in filled], dtype=np.int64)
    return np.frombuffer(b"".join(filled), np.uint8), np.cumsum(lengths) - lengths, np.maximum(lengths - WINDOW + 1, 0)


def level_counts(raws: Sequence[bytes]) -> np.ndarray:
    """How many windows of the texts have each level; windows lie inside one text."""
    buf, starts, windows = _joined(raws)
    if not len(buf):
        return np.zeros(LEVELS, np.int64)
    levels = window_levels(buf)
    own = np.zeros(len(buf) + 1, np.int64)
    np.add.at(own, starts, (windows > 0).astype(np.int64))
    np.add.at(own, starts + windows, -(windows > 0).astype(np.int64))
    return np.bincount(levels[np.cumsum(own)[: len(levels)] > 0], minlength=LEVELS)


def chosen_windows(levels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of one text's chosen windows, in order: those that are the first most improbable one of at least POPULAR
    of the neighbourhoods in the text; of fewer than FEWEST such, the FEWEST that are so most often, and then the most
    improbable ones."""
    own = rank[levels]
    reach = min(NEIGHBOURS, len(own))
    popular = np.bincount(_least_places(own, reach), minlength=len(own))
    found = np.flatnonzero(popular >= POPULAR)
    if len(found) < FEWEST:
        found = np.sort(np.lexsort((np.arange(len(own)), own, -popular))[:FEWEST])
    return found


def digests(raws: Sequence[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the number of features in each filter of its chain, and the filters' bits as bytes. Features are
    taken in the text's order, equal ones once. A text without bytes has no filter."""
    buf, starts, windows = _joined(raws)
    if not len(buf):
        return [(np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8))] * len(raws)
    levels = window_levels(buf)
    places, sizes = [], []
    for start, n in zip(starts.tolist(), windows.tolist(), strict=True):
        at = chosen_windows(levels[start : start + n], rank) + start if n else np.zeros(0, np.int64)
        places.append(at)
        sizes.append(len(at))
    at = np.concatenate(places)
    value = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        value += (buf[at + j].astype(np.uint64) + np.uint64(1)) * _ODD[j]
    value = mix(value)
    owner = np.repeat(np.arange(len(raws)), sizes)
    first = np.zeros(len(at), bool)
    first[np.unique(mix(value + owner.astype(np.uint64) * _ODD[0]), return_index=True)[1]] = True
    value, owner = value[first], owner[first]
    counts = np.bincount(owner, minlength=len(raws))
    chain = (counts + FEATURES - 1) // FEATURES
    base, begin = np.cumsum(chain) - chain, np.cumsum(counts) - counts
    filter_ = base[owner] + (np.arange(len(owner)) - begin[owner]) // FEATURES
    bits = np.zeros((int(chain.sum()), BITS), bool)
    for j in range(HASHES):
        bits[filter_, (value >> np.uint64(11 * j)).astype(np.int64) & (BITS - 1)] = True
    packed, full = np.packbits(bits, axis=1), np.bincount(filter_, minlength=len(bits))
    return [(full[a : a + n], packed[a : a + n]) for a, n in zip(base.tolist(), chain.tolist(), strict=True)]


def written(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: of each filter the number of features and the bits, base64."""
    return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(*digest, strict=True))


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split(":") for x in fingerprint.split(",")] if fingerprint else []
    bits = np.frombuffer(b"".join(base64.b64decode(b) for _, b in parts), np.uint8)
    return np.array([int(n) for n, _ in parts], np.int64), bits.reshape(-1, BITS // 8)


def _by_chance(x: int, y: np.ndarray) -> np.ndarray:
    """Bits that filters of x and y features share by chance."""
    p = 1 - 1 / BITS
    return BITS * (1 - p ** (HASHES * x) - p ** (HASHES * y) + p ** (HASHES * (x + y)))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1: each filter of the shorter chain against its best partner in the other one, the mean weighted by
    features. Partners are compared by their common bits, less those by chance, as a share of the most possible.
    Equal fingerprints have 1, also without features; one without features is like no other."""
    if len(a[0]) > len(b[0]) or (len(a[0]) == len(b[0]) and a[0].sum() > b[0].sum()):
        a, b = b, a
    if len(a[0]) == len(b[0]) and (a[1] == b[1]).all():
        return 1.0
    if not len(a[0]):
        return 0.0
    x, y = (np.ascontiguousarray(bits).view(np.uint64) for bits in (a[1], b[1]))
    set_in_y, total = np.bitwise_count(y).sum(axis=1), 0.0
    for n, bits in zip(a[0].tolist(), x, strict=True):
        common = np.bitwise_count(bits & y).sum(axis=1)
        most = np.minimum(np.bitwise_count(bits).sum(), set_in_y)
        chance = _by_chance(n, b[0].astype(float))
        least = chance + CUT * np.maximum(most - chance, 0)
        total += n * max(0.0, float(np.max((common - least) / np.maximum(most - least, 1e-9))))
    return min(1.0, total / float(a[0].sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS, np.int64)
    for batch in batches:
        raw = [(t.as_py() or "").encode() for t in batch.column("text")]
        for a, b in chunks(raw):
            counts += level_counts(raw[a:b])
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"level": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level, the rarest first, by the windows of all texts. At most LEVELS rows are counted
    in each task and in all."""
    counts = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(_counted, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank


def edited(text: str, other: str) -> str:
    """text with its last third of code points replaced by the first as many of the other one."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _fingerprinted(rank: np.ndarray):
    """Rows of ranges one after the other, each in order and closed by the row that follows it: each row but the
    closing ones with its fingerprint and those of its edited text and of the next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "closing", "doc_id", "text", "own")), strict=True))
            rows = [last, *rows] if last else rows
            for a, b in chunks([r[3] for r in rows]):
                part = rows[a : b + 1]  # and the first of the next chunk, which follows this one's last
                yield from results(part)
            last = rows[-1] if rows else last

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(i, r) for i, (r, following) in enumerate(zip(rows, rows[1:], strict=False)) if not r[1] and r[0] == following[0]]
        if not pairs:
            return
        texts = [edited(r[3], rows[i + 1][3]).encode() for i, r in pairs]
        own, changed = digests([r[3].encode() for r in rows], rank), digests(texts, rank)
        yield pa.RecordBatch.from_pydict({
            "own": pa.array([r[4] for _, r in pairs], pa.int64()), "doc_id": pa.array([r[2] for _, r in pairs], pa.int64()), "n_chars": pa.array([len(r[3]) for _, r in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]), "fingerprint": pa.array([written(own[i]) for i, _ in pairs]), "edited_fingerprint": pa.array([written(x) for x in changed]),
            "near_edited": pa.array([likeness(own[i], x) for (i, _), x in zip(pairs, changed, strict=True)]), "near_next": pa.array([likeness(own[i], own[i + 1]) for i, _ in pairs]),
        })

    return run


def _range_of(bounds: pd.DataFrame):
    """Which range a row lies in, by the first rows of the ranges."""
    firsts = [tuple(map(int, b)) for b in bounds.itertuples(index=False, name=None)]

    @F.pandas_udf("int")
    def found(none: pd.Series, back: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(firsts, key) - 1 for key in zip(none.tolist(), back.tolist(), own.tolist(), strict=True)], dtype="int32")

    return found


def _order() -> list[Column]:
    """Descending doc_id with nulls last, then a hash of the text."""
    back = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    return [F.col("doc_id").isNull().cast("int").alias("none"), back.alias("back"), F.xxhash64("text").alias("own")]


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is that of the next smaller doc_id, after the smallest the largest. Texts under one doc_id follow
    each other by a hash of the text, null ids come last; rows equal in doc_id and text are one document with a row
    each. A single document is its own next one. Null texts count as empty. `rank` ranks entropy levels (`rarity`, of
    docs if none is given). Other columns are ignored.

    Documents are dealt into ranges of the order by the first rows of each, which are found on ids alone; every range
    also gets a copy of the row that follows it, so texts are shuffled once and no task sees more than its range.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rank = rarity(rows) if rank is None else rank
    keys = materialised(rows.select(*_order(), F.octet_length("text").alias("bytes")).groupBy("none", "back", "own").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes")), "keys")
    size = keys.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("c").alias("c")).first()
    if not size.n:
        return docs.sparkSession.createDataFrame([], _RESULT)
    ranges = int(min(RANGES, size.bytes // RANGE_BYTES + 1, size.n))
    dealt = keys.repartitionByRange(ranges, "none", "back", "own").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("none", "back", "own")).alias("first"))
    bounds = dealt.select("first.*").toPandas().sort_values(["none", "back", "own"])
    n = len(bounds)
    keyed = rows.select("*", *_order())
    place = ["none", "back", "own"]
    again = if_small(keys.filter("c > 1").select(*place))
    if size.c > 1:  # rows equal in id and text: one stands for them all
        equal = keyed.join(again, place, "left_semi").dropDuplicates(place)
        every, keyed = keyed, keyed.join(again, place, "left_anti").unionByName(equal)
    firsts = keyed.sparkSession.createDataFrame(bounds, "none int, back long, own long").withColumn("opens", F.lit(True))
    placed = keyed.join(F.broadcast(firsts), place, "left").withColumn("range", _range_of(bounds)("none", "back", "own"))
    own, copy = F.struct("range", F.lit(False).alias("closing")), F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("closing"))
    both = placed.select("doc_id", "text", "none", "back", "own", F.explode(F.when(F.col("opens"), F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    sorted_ = both.select("doc_id", "text", "none", "back", "own", "at.range", "at.closing").repartitionById(n, "range").sortWithinPartitions("range", "closing", "none", "back", "own")
    found = sorted_.select("range", "closing", "doc_id", "own", "text").mapInArrow(_fingerprinted(rank), f"own long, {_RESULT}")
    if size.c == 1:
        return found.drop("own")
    found = materialised(found.withColumns({"none": F.col("doc_id").isNull().cast("int"), "back": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))}), "fingerprints")
    one = found.join(again, place, "left_semi").withColumn("key", F.struct(*place)).drop(*place)
    copies = salted_join(every.join(again, place, "left_semi").select(F.struct(*place).alias("key")), one, "key").drop("key")
    single = found.join(again, place, "left_anti").drop(*place)
    return single.unionByName(copies)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
