"""Line deduplication by a deletion-neighbourhood join on words (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import SPACED_WORDS, by_bytes, chunks, folded_bytes, if_small, line_word_hashes, materialised, mix, own_texts, salted_join, table, unused

#: Words from which on one word of a line may differ; of a shorter line one word is too large a part.
FUZZY_WORDS = 8
_ODD = 0x9E3779B97F4A7C15
_SALT = np.uint64(0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out, value = [], 1
    for _ in range(n):
        out.append(value)
        value = value * base % 2**64
    return np.array(out, dtype=np.uint64)


class _Lines:
    """The words of a chunk's lines with running sums of word hashes times a power of their place in the line, of
    which differences give the hash of any run of a line's words."""

    def __init__(self, raw: list[bytes]):
        self.hashes, self.bounds, self.owner, self.firsts = line_word_hashes(raw, SPACED_WORDS)
        self.n = np.diff(self.bounds)
        self.number = np.arange(len(self.n)) - self.firsts[self.owner]
        self.place = np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.n)
        longest = int(self.n.max(initial=0)) + 1
        powers, self.inverse = _powers(_ODD, longest), _powers(pow(_ODD, -1, 2**64), longest)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[self.place], dtype=np.uint64)))

    def identity(self, salt: np.uint64) -> np.ndarray:
        """A 64-bit fingerprint of each line's words and their places."""
        each = mix(self.hashes ^ mix(self.place.astype(np.uint64) * _SALT + salt))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.n.astype(np.uint64))

    def halves(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (lines, 4) of the first and last halves of lines of at least `least` words, and which of them count.
        Two lines within one word of each other share their first or last half at the shorter one's half length."""
        a, b = self.bounds[:-1], self.bounds[1:]
        keys = []
        for half in (self.n // 2, np.maximum(self.n - 1, 0) // 2):
            size = 2 * half.astype(np.uint64)
            keys.append(self.sums[a + half] - self.sums[a] + size)
            keys.append((self.sums[b] - self.sums[b - half]) * self.inverse[self.n - half] + size + np.uint64(1))
        fuzzy = (self.n >= least) & (self.n > 0)
        return mix(np.stack(keys, axis=1)), np.stack([fuzzy, fuzzy, fuzzy & (self.n % 2 == 0), fuzzy & (self.n % 2 == 0)], axis=1)

    def wanted(self, of_text: list[list[int]]) -> np.ndarray:
        """Which lines are among the numbers given for each text."""
        out = np.zeros(len(self.n), dtype=bool)
        at = [self.firsts[i] + np.asarray(x, dtype=np.int64) for i, x in enumerate(of_text) if x]
        out[np.concatenate(at) if at else []] = True
        return out


def _occurrences(least: int):
    """Each line with words: its place, a 128-bit fingerprint of its words, and the keys of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            docs, own, raw = batch.column("doc_id"), batch.column("own"), folded_bytes(batch.column("text").to_pylist())
            for a, b in chunks(raw):
                lines = _Lines(raw[a:b])
                rows = np.flatnonzero(lines.n)
                keys, counting = lines.halves(least)
                counting = counting[rows]
                offsets = np.concatenate(([0], np.cumsum(counting.sum(axis=1)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": docs.take(pa.array(lines.owner[rows] + a)), "own": own.take(pa.array(lines.owner[rows] + a)), "line": pa.array(lines.number[rows]), "n": pa.array(lines.n[rows]),
                    "lo": pa.array(lines.identity(np.uint64(1))[rows].view(np.int64)), "hi": pa.array(lines.identity(np.uint64(2))[rows].view(np.int64)),
                    "halves": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[rows][counting].view(np.int64))),
                })

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deletion neighbourhood: a key for the line as it is (place -1) and for the line without each word."""
    for batch in by_bytes(batches):
        docs, own, wanted = batch.column("doc_id"), batch.column("own"), batch.column("lines").to_pylist()
        raw = folded_bytes(batch.column("text").to_pylist())
        for a, b in chunks(raw):
            lines = _Lines(raw[a:b])
            asked = lines.wanted(wanted[a:b]) & (lines.n > 0)
            rows = np.flatnonzero(asked)
            word = np.flatnonzero(np.repeat(asked, lines.n))
            line = np.repeat(np.arange(len(lines.n)), lines.n)[word]
            start, stop, size = lines.bounds[line], lines.bounds[line + 1], lines.n.astype(np.uint64)
            without = lines.sums[word] - lines.sums[start] + (lines.sums[stop] - lines.sums[word + 1]) * lines.inverse[np.ones(len(word), int)] if len(word) else np.zeros(0, np.uint64)
            keys = np.concatenate((lines.sums[lines.bounds[rows + 1]] - lines.sums[lines.bounds[rows]] + size[rows], without + size[line] - np.uint64(1)))
            places = np.concatenate((np.full(len(rows), -1), lines.place[word])).astype(np.int32)
            line = np.concatenate((rows, line))
            for i in range(0, len(line), 100_000):
                part = line[i : i + 100_000]
                texts = pa.array(lines.owner[part] + a)
                yield pa.RecordBatch.from_pydict({"key": pa.array(mix(keys[i : i + 100_000]).view(np.int64)), "place": pa.array(places[i : i + 100_000]), "doc_id": docs.take(texts), "own": own.take(texts), "line": pa.array(lines.number[part])})


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        docs, own, wanted = batch.column("doc_id"), batch.column("own"), batch.column("lines").to_pylist()
        raw = folded_bytes(batch.column("text").to_pylist())
        rows, numbers, words = [], [], []
        for i, (text, asked) in enumerate(zip(raw, wanted, strict=True)):
            lines = text.split(b"\n")
            rows += [i] * len(asked)
            numbers += asked
            words += [lines[n] for n in asked]
        for i in range(0, len(rows), 10_000):
            texts = pa.array(rows[i : i + 10_000], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": docs.take(texts), "own": own.take(texts), "line": pa.array(numbers[i : i + 10_000], pa.int64()), "words": pa.array(words[i : i + 10_000], pa.binary())})


def within_one_word(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    a, b = a[head:], b[head:]
    return a[1:] == b[1:] if len(a) == len(b) else (a[1:] == b if len(a) > len(b) else a == b[1:])


_SPACES = bytes.maketrans(b"\x0b\x0c\r\t\n", b"     ")


def _split(line: bytes) -> list[bytes]:
    return [w for w in line.translate(_SPACES).split(b" ") if w]


def _verified(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(map(_split, batch.column("words_a").to_pylist()), map(_split, batch.column("words_b").to_pylist()), strict=True)
            keep = pa.array([min(len(a), len(b)) >= least and within_one_word(a, b) for a, b in both], pa.bool_())
            yield batch.select(["later", "earlier"]).filter(keep)

    return run


_AT = "struct<doc_id: long, own: long, line: long>"


def removed_lines(docs: DataFrame, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """doc_id, own, line, n_words, first_doc_id, first_line, equal of every line that goes.

    A line goes if an earlier line (by doc_id, then line number) has the same words, or words within one insertion,
    deletion or replacement, both lines having at least `fuzzy_words` words (1 for all lines). first_* names the
    earliest such line, equal ones before others. Words are split at spaces, A-Z lower-cased. Lines without words,
    null and empty texts give no row; rows with a null doc_id take no part. Different texts under one doc_id are
    documents of their own, told apart and ordered by the column `own`; rows equal in both have the same lines at the
    same places. Columns other than doc_id and text are ignored.
    """
    rows = own_texts(docs.select("doc_id", "text").filter("doc_id is not null"))
    fields = "doc_id long, own long, line long, n long, lo long, hi long, halves array<long>"
    lines = materialised(rows.mapInArrow(_occurrences(fuzzy_words), fields).withColumn("words", F.struct("lo", "hi", "n")).drop("lo", "hi"), "lines")
    at = F.struct("doc_id", "own", "line")
    firsts = materialised(lines.groupBy("words").agg(F.min(F.struct(at.alias("at"), "halves")).alias("m"), F.count("*").alias("c")).select("words", "m.at", "m.halves", "c"), "firsts")

    halves = firsts.select("at", F.explode("halves").alias("key"))
    common = halves.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    met = salted_join(halves, materialised(common, "halves"), "key", count="c").select("at.doc_id", "at.own", "at.line")
    places = if_small(materialised(met.groupBy("doc_id", "own").agg(F.collect_set("line").alias("lines")), "places"))
    near = materialised(rows.join(places, ["doc_id", "own"]).select("doc_id", "own", "text", "lines"), "near")
    words = near.mapInArrow(_line_words, "doc_id long, own long, line long, words binary").select(at.alias("at"), "words").dropDuplicates(["at"])

    variants = materialised(near.mapInArrow(_variants, "key long, place int, doc_id long, own long, line long").select("key", "place", at.alias("at")), "variants")
    gap = variants.filter("place >= 0").select(F.struct("key", "place").alias("gap"), "at")
    replaced = gap.groupBy("gap").agg(F.min("at").alias("first"), F.count("*").alias("c")).filter("c > 1")
    by_place = salted_join(gap, materialised(replaced, "replaced"), "gap", count="c").filter(F.col("at") > F.col("first")).select(F.col("at").alias("later"), F.col("first").alias("earlier"))
    whole = variants.filter("place = -1").select("key", F.col("at").alias("whole"))
    shorter = variants.filter("place >= 0").select("key", "at")
    by_length = salted_join(shorter.join(whole.select("key").distinct(), "key", "left_semi"), whole, "key").select(F.greatest("at", "whole").alias("later"), F.least("at", "whole").alias("earlier"))
    pairs = materialised(by_place.union(by_length).filter("later <> earlier").distinct(), "pairs")
    texts = salted_join(pairs.join(words.select(F.col("at").alias("later"), F.col("words").alias("words_b")), "later"), words.select(F.col("at").alias("earlier"), F.col("words").alias("words_a")), "earlier", 2000)
    good = texts.select("later", "earlier", "words_a", "words_b").mapInArrow(_verified(fuzzy_words), f"later {_AT}, earlier {_AT}")
    earliest = good.groupBy(F.col("later").alias("at")).agg(F.min("earlier").alias("near"))

    known = materialised(firsts.select("words", "at", "c").join(earliest, "at", "left").filter("c > 1 or near is not null"), "known")
    placed = salted_join(lines.select("doc_id", "own", "line", "words"), known, "words", count="c")
    equal = at != F.col("at")
    first = F.when(equal, F.col("at")).otherwise(F.col("near"))
    return placed.filter(equal | F.col("near").isNotNull()).select("doc_id", "own", "line", F.col("words.n").alias("n_words"), first["doc_id"].alias("first_doc_id"), first["line"].alias("first_line"), equal.alias("equal"))


def without_repeated_lines(docs: DataFrame, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """docs with the lines that go cut from their texts. Rows of which no line with words is left go too; rows whose
    text had no words from the start, or whose doc_id is null, stay as they are. Texts that share a doc_id are cut each
    by its own lines; rows equal in both are cut alike."""
    gone, own = unused(docs, "gone", "own")
    lines = removed_lines(docs, fuzzy_words).groupBy("doc_id", F.col("own").alias(own)).agg(F.collect_set("line").alias(gone))
    joined = own_texts(docs, own).join(lines, ["doc_id", own], "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i.cast("long")))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    left = F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(table(spark, sf_dir, "documents")).drop("own")


_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
with t as (select doc_id, string_split(text, chr(10)) as parts from documents where doc_id is not null and text is not null),
l as (select doc_id, i - 1 as line, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from (select doc_id, unnest(range(1, len(parts) + 1)) as i, unnest(parts) as line from t)),
lines as (select *, array_to_string(ws, ' ') as k, len(ws) as n from l where len(ws) > 0),
firsts as (select k, any_value(ws) as ws, any_value(n) as n, min((doc_id, line)) as pos from lines group by k),
v as (select pos, n, i, array_to_string(list_concat(ws[1 : i - 1], ws[i + 1 : n]), ' ') as k from (select pos, n, ws, unnest(range(1, n + 1)) as i from firsts where n >= {FUZZY_WORDS})),
pairs as (
  select a.pos as x, b.pos as y from v a join v b on a.n = b.n and a.i = b.i and a.k = b.k and a.pos <> b.pos
  union all select v.pos, f.pos from v join firsts f on f.k = v.k and f.n = v.n - 1 and f.n >= {FUZZY_WORDS}
  union all select f.pos, v.pos from v join firsts f on f.k = v.k and f.n = v.n - 1 and f.n >= {FUZZY_WORDS}
),
near as (select x as pos, min(y) as near from pairs where y < x group by x)
select doc_id, line, n as n_words, case when same then f1 else n1 end as first_doc_id, case when same then f2 else n2 end as first_line, same as equal from (
  select doc_id, line, lines.n, (doc_id, line) <> pos as same, pos[1] as f1, pos[2] as f2, near[1] as n1, near[2] as n2, near is not null as has
  from lines join (select k, pos from firsts) f using (k) left join near using (pos)) where same or has
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines from the texts, as without_repeated_lines says: null ids and texts stay, of equal lines the
    one first by doc_id and place stays, and only rows equal in doc_id and text are cut alike."""
    return without_repeated_lines(docs)
