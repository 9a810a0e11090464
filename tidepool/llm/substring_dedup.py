"""Passages repeated within or across documents (operator 1).

Near copies of paragraphs are found by MinHash banding: long lines, and blocks of neighbouring short lines. A passage
that was set into other paragraphs has no paragraph of its own there, so windows at content-defined anchors find it as
well, by equality: windows overlap, so near matches of them would link every text with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import SPACED_WORDS, chunks, folded_bytes, if_small, materialised, mix, own_texts, placed_word_hashes, salted_join, shingles_between, table, unused, word_hashes
from tidepool.llm.near_dup import SKETCH_FIELDS, classes, sketch_columns

#: Bands of four registers; a pair at similarity 0.8 is missed once in forty thousand, at 0.9 never in practice.
PARAGRAPH_BANDS = 20
_ODD_NUMBERS = np.random.default_rng(23).integers(0, 2**64, size=(3, 64), dtype=np.uint64) | np.uint64(1)
_ANCHOR_ODD, _WINDOW_ODD = _ODD_NUMBERS[0], _ODD_NUMBERS[1:]
_ID = pa.struct([("doc_id", pa.int64()), ("own", pa.int64()), ("part", pa.int32())])
_PLACE = "struct<doc_id: long, own: long, part: int>"


def _closing(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The lines after which a block of short lines ends: on average one in four, chosen by the least of their words'
    hashes, so that copies are cut alike whatever stands before them, and mostly where a few words differ too."""
    out, some = np.zeros(len(bounds) - 1, dtype=bool), np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = (mix(np.minimum.reduceat(mix(hashes), bounds[some])) & np.uint64(3)) == 0
    return out


def _paragraphs(texts: list[str | None], a: int, b: int, lines: list[bytes], hashes: np.ndarray, bounds: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, first line, start, length, first word, one past the last) of the paragraphs of at least `min_words` words.
    A line of so many words is one; shorter lines in a row are joined up to a blank line, a long one, or a closing one."""
    bounds_, closing, at = bounds.tolist(), _closing(hashes, bounds).tolist(), 0
    for i in range(a, b):
        start, block = 0, None
        for part, line in enumerate((texts[i] or "").split("\n")):
            first, last, stop = bounds_[at], bounds_[at + 1], start + len(line)
            words = last - first
            if block and not 0 < words < min_words:
                yield i, *block
                block = None
            if words >= min_words:
                yield i, part, start, stop - start, first, last
            elif words:
                block = (part, start, stop - start, first, last) if block is None else (block[0], block[1], stop - block[1], block[3], last)
                if closing[at]:
                    yield i, *block
                    block = None
            start, at = stop + 1, at + 1
        if block:
            yield i, *block


def _paragraph_sets(texts: list[str | None], k: int, min_words: int, wanted: list[set[int]] | None = None) -> Iterator[tuple[list[tuple[int, int, int, int]], list[np.ndarray]]]:
    """For each chunk of texts: (row, first line, start, length) and the shingle set of every paragraph long enough."""
    for a, b in chunks(raw := folded_bytes(texts)):
        lines = [line for i in range(a, b) for line in raw[i].split(b"\n")]
        hashes, bounds = word_hashes(lines, SPACED_WORDS)
        found = [p for p in _paragraphs(texts, a, b, lines, hashes, bounds, min_words) if p[5] - p[4] >= min_words and (wanted is None or p[1] in wanted[p[0]])]
        yield [p[:4] for p in found], shingles_between(hashes, [p[4] for p in found], [p[5] for p in found], k)


def _ids(batch: pa.RecordBatch, where: list[tuple[int, int, int, int]]) -> pa.Array:
    at = pa.array([w[0] for w in where], pa.int64())
    texts = [batch.column(c).take(at) for c in ("doc_id", "own")]
    return pa.StructArray.from_arrays([*texts, pa.array([w[1] for w in where], pa.int32())], fields=list(_ID))


def _sketches(k: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, sets in _paragraph_sets(batch.column("text").to_pylist(), k, min_words):
                spans = {"start": pa.array([w[2] for w in where], pa.int64()), "length": pa.array([w[3] for w in where], pa.int64())}
                yield pa.RecordBatch.from_pydict({"id": _ids(batch, where)} | spans | sketch_columns(sets, PARAGRAPH_BANDS))

    return run


def _sets(k: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [set(x) for x in batch.column("parts").to_pylist()]
            for where, sets in _paragraph_sets(batch.column("text").to_pylist(), k, min_words, wanted):
                yield pa.RecordBatch.from_pydict({"id": _ids(batch, where), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def repeated_paragraphs(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 50) -> DataFrame:
    """Every paragraph of at least `min_words` words that has a near copy: doc_id, own, paragraph, start, length (code
    points), first_doc_id, first_paragraph, removed.

    Paragraphs are lines, or blocks of shorter lines in a row, which end at blank lines, long ones, and about every
    fourth one, chosen by its words; a block is named by its first line. Near copies share `percent` of their distinct k-word shingles (words split at spaces,
    A-Z lower-cased). The earliest paragraph of each connected group, by doc_id and place, stays; the others are
    removed. Null, empty and short texts give no row; rows with a null doc_id take no part. Different texts under one
    doc_id are documents of their own, told apart by the column `own`; rows equal in both count once. Other columns
    are ignored.
    """
    rows = own_texts(docs.select("doc_id", "text").filter("doc_id is not null"))
    schema = f"id {_PLACE}, start long, length long, {SKETCH_FIELDS}"
    sketches = materialised(rows.mapInArrow(_sketches(k, min_words), schema), "paragraphs")

    def sets_of(ids: DataFrame) -> DataFrame:
        parts = materialised(ids.groupBy("id.doc_id", "id.own").agg(F.collect_set("id.part").alias("parts")), "ids")
        found = rows.join(if_small(parts), ["doc_id", "own"]).select("doc_id", "own", "text", "parts").mapInArrow(_sets(k, min_words), f"id {_PLACE}, shingles binary")
        return found.dropDuplicates(["id"])

    found = materialised(classes(sketches.drop("start", "length"), sets_of, percent, PARAGRAPH_BANDS), "classes")
    groups = found.groupBy("component").agg(F.max("id").alias("last")).filter("last <> component").select("component")
    spans = sketches.select("id", "start", "length").dropDuplicates(["id"])
    return found.join(groups, "component").dropDuplicates(["id"]).join(spans, "id").select(
        F.col("id.doc_id").alias("doc_id"), F.col("id.own").alias("own"), F.col("id.part").alias("paragraph"), "start", "length",
        F.col("component.doc_id").alias("first_doc_id"), F.col("component.part").alias("first_paragraph"),
        (F.col("id") != F.col("component")).alias("removed"),
    )


def _anchors(hashes: np.ndarray, bounds: np.ndarray, words: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, whose hash of four words is the least of some `reach` neighbouring ones of the same text and
    that `words` words of it follow from; and the text of each."""
    n = len(hashes) - 3
    if n < reach:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    local = mix(sum((hashes[j : n + j] * _ANCHOR_ODD[j] for j in range(4)), np.zeros(n, np.uint64)))
    begin = np.arange(n - reach + 1)
    least = begin + np.lib.stride_tricks.sliding_window_view(local, reach).argmin(axis=1)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    at = np.unique(least[begin + reach + 3 <= bounds[owner + 1]])
    owner = np.searchsorted(bounds, at, side="right") - 1
    fits = at + words <= bounds[owner + 1]
    return at[fits], owner[fits]


def _windows(words: int, reach: int):
    """Windows of `words` words that begin at anchors. A passage of `words` + `reach` - 1 words or more holds at least
    one such window, wherever it stands, and the same one in every copy. Anchors of a text lie at most `reach` words
    apart, so neighbouring windows overlap if `reach` is at most `words`; what follows the first of equal windows in a
    row is one span of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, own, raw = batch.column("doc_id"), batch.column("own"), folded_bytes(batch.column("text").to_pylist())
            for a, b in chunks(raw):
                hashes, bounds, first, last = placed_word_hashes(raw[a:b], SPACED_WORDS)
                at, owner = _anchors(hashes, bounds, words, reach)
                lo, hi = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for j in range(words):
                    lo += hashes[at + j] * _WINDOW_ODD[0, j]
                    hi += hashes[at + j] * _WINDOW_ODD[1, j]
                # a text that repeats itself has runs of equal windows: the first is one row, all others together one span
                new = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (owner[1:] != owner[:-1])
                begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), new)))
                ends = np.concatenate((begins[1:], [len(at)])) - 1
                more = ends > begins
                x, y = np.concatenate((begins, begins[more] + 1)), np.concatenate((begins, ends[more]))
                for i in range(0, len(x), 50_000):
                    p, q = x[i : i + 50_000], y[i : i + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lo": pa.array(mix(lo[p]).view(np.int64)), "hi": pa.array(mix(hi[p]).view(np.int64)), "doc_id": docs.take(pa.array(owner[p] + a)), "own": own.take(pa.array(owner[p] + a)),
                        "start": pa.array(first[at[p]].astype(np.int64)), "stop": pa.array(last[at[q] + words - 1].astype(np.int64)),
                    })

    return run


def repeated_passages(docs: DataFrame, words: int = 32, reach: int = 20) -> DataFrame:
    """Passages of at least `words` words that occur again, whatever paragraphs they stand in: doc_id, own, start,
    length (code points), first_doc_id, removed.

    Anchored windows are grouped by a 128-bit hash of their words; every passage of `words` + `reach` - 1 words that
    occurs twice is found; up to `reach` - 1 words at either end may lie outside its windows. The occurrence that is earliest by doc_id and place stays. Windows that overlap or touch
    and fare alike are one passage. Equal windows in a row, as in a line over and over, all count: of the earliest
    such run the first window stays. Nulls, empty and short texts give no row. Texts of one doc_id are told apart by
    `own`, as in repeated_paragraphs.
    """
    texts = own_texts(docs.select("doc_id", "text").filter("doc_id is not null"))
    rows = texts.mapInArrow(_windows(words, reach), "lo long, hi long, doc_id long, own long, start long, stop long")
    rows = rows.withColumn("window", F.struct("lo", "hi")).drop("lo", "hi")
    place = F.struct("doc_id", "own", "start")
    firsts = rows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first <> last").drop("last")
    met = salted_join(rows, materialised(firsts, "first_windows"), "window", count="n")
    found = materialised(met.select("doc_id", "own", "start", "stop", "first", (place != F.col("first")).alias("removed")), "windows")
    alike = W.partitionBy("doc_id", "own", "removed").orderBy("start", "stop")
    apart = F.col("start") > F.coalesce(F.max("stop").over(alike.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1
    numbered = found.withColumn("passage", F.sum(apart.cast("int")).over(alike.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "own", "removed", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("first.doc_id", "start").alias("first_doc_id"))
    return merged.select("doc_id", "own", "start", (F.col("stop") - F.col("start")).alias("length"), "first_doc_id", "removed")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated paragraphs and passages together: doc_id, own, kind, paragraph, start, length, first_doc_id,
    first_paragraph, removed; passages have no paragraph numbers."""
    none = F.lit(None).cast("int")
    columns = ["doc_id", "own", "kind", "paragraph", "start", "length", "first_doc_id", "first_paragraph", "removed"]
    lines = repeated_paragraphs(docs).withColumn("kind", F.lit("paragraph"))
    passages = repeated_passages(docs).withColumns({"kind": F.lit("passage"), "paragraph": none, "first_paragraph": none})
    return lines.select(*columns).union(passages.select(*columns))


def _cut(gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist(), strict=True):
                at, parts = 0, []
                for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in spans or ()):
                    parts.append((text or "")[at : max(at, start)])
                    at = max(at, stop)
                texts.append(text if not spans else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == "text" else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with removed paragraphs and passages cut from their texts; all rows and columns stay. Each text is cut by
    its own spans, also if it shares its doc_id with another one."""
    gone, own = unused(docs, "gone", "own")
    spans = repeats(docs).filter("removed").groupBy("doc_id", F.col("own").alias(own)).agg(F.collect_list(F.struct("start", "length")).alias(gone))
    joined = own_texts(docs, own).join(spans, ["doc_id", own], "left").select(*docs.columns, gone)
    return joined.mapInArrow(_cut(gone), joined.schema).select(*docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("own")
