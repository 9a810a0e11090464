"""Spelling variants of words by asymmetric chunks (operator 11).

Of two words within one edit, the shorter one (or either, if equally long) is cut into two disjoint chunks, and one edit
leaves one of them whole. The other word contributes its positional grams of the chunks' lengths: it holds the first
chunk at its own place, or the second one shifted by the difference of lengths, none or one. Words that meet in a
chunk are verified by their edit distance. Where too many words share a chunk, what the chunk leaves open is cut into two
chunks again, down to single letters, so no group's pairs grow with the square of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import if_small, materialised, table

SHORTEST, LEAST = 5, 3
#: Pairs of words that one chunk may give before its words are told apart by a further chunk.
PAIRS_A_CHUNK = 10_000
#: Words that a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000
#: One run of letters in this many is misspelt.
MISSPELT = 97
_RUN = re.compile("[a-zÀ-ÿ]+")


def _counted(shortest: int, misspelt: int):
    """How often each word occurs, counted in the task first."""

    def handed(totals: Counter[str]) -> pa.RecordBatch:
        words = [w for w in totals if len(w) >= shortest]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([totals[w] for w in words], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, crc32 = Counter[str](), zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                runs = Counter(_RUN.findall((text.as_py() or "").encode().lower().decode()))
                own = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word in [w for w in runs if not crc32(w.encode(), own) % misspelt]:
                    at = crc32(word.encode(), own) % len(word)
                    totals[word[:at] + word[at + 1 :]] += runs.pop(word)
                totals.update(runs)
                if len(totals) > COUNTED_AT_ONCE:
                    yield handed(totals)
                    totals.clear()
        yield handed(totals)

    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspelt: int = MISSPELT) -> DataFrame:
    """word, n: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z, as they occur in all
    texts, with at least `shortest` code points and `least` occurrences. One run in `misspelt`, chosen by the crc32 of
    its document's id and itself, lacks one letter. Null texts hold none; a null doc_id counts as an empty one."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted(shortest, misspelt), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _open_words(words: DataFrame) -> DataFrame:
    """Each word in its parts: for partners of its own length (d = 0), and as the shorter and the longer word of a pair
    (d = 1). The edit lies between `low` and `high`, places in the shorter word."""
    parts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(long).alias("long"), (F.length("word") - int(long)).alias("high")) for d, long in ((0, False), (1, False), (1, True))])
    return words.select("word", "n", F.explode(parts).alias("p")).select("word", "n", "p.d", "p.long", F.lit(0).alias("low"), "p.high")


def _chunked(rows: DataFrame) -> DataFrame:
    """What is open is cut into two chunks; each in turn is taken as whole, which leaves the other one open. The key
    names all that is fixed then: what lies before the open part, and what lies behind it, shifted in the longer word."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    cut = rows.select("word", "n", "d", "long", F.explode(halves).alias("open")).select("word", "n", "d", "long", "open.low", "open.high")
    behind = F.substring("word", F.col("high") + F.col("long").cast("int") + 1, F.length("word"))
    return cut.withColumn("key", F.xxhash64("d", "low", "high", F.substring("word", F.lit(1), F.col("low")), behind))


def near_words(words: DataFrame, most: int = PAIRS_A_CHUNK) -> DataFrame:
    """a, n_a, b, n_b of every two words (word, n; words distinct) with exactly one inserted, deleted or replaced code
    point between them, each pair once."""
    found, rows = None, _chunked(_open_words(words))
    while True:
        short, long = F.count_if(~F.col("long")), F.when(F.first("d") == 0, F.count("*")).otherwise(F.count_if(F.col("long")))
        groups = rows.groupBy("key").agg(short.alias("short"), long.alias("longer"), F.max(F.col("high") - F.col("low")).alias("width"))
        wide = materialised(groups.filter((F.col("short") * F.col("longer") > most) & (F.col("width") > 1)).select("key"), "wide")
        last = wide.isEmpty()
        narrow = rows if last else rows.join(if_small(wide), "key", "left_anti")
        a = narrow.filter(~F.col("long")).select("key", "d", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = narrow.filter((F.col("d") == 0) | F.col("long")).select("key", F.col("d").alias("d_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = a.join(b, "key").filter((F.col("d") == F.col("d_b")) & ((F.col("d") == 1) | (F.col("a") < F.col("b"))))
        pairs = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        found = pairs if found is None else found.union(pairs)
        if last:
            return found.distinct()
        rows = materialised(_chunked(rows.join(if_small(wide), "key", "left_semi")), "chunks")


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the last of the forms that follow each other. Each
    round doubles how far a word sees; a form occurs at least twice as often as its word, so chains are short."""
    seen = materialised(forms.select("word", F.col("form").alias("root")), "roots")
    while not seen.join(seen.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        onwards = if_small(seen.select(F.col("word").alias("root"), F.col("root").alias("next")))
        seen = materialised(seen.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return seen


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n; words distinct).

    Words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its near
    word of largest n, ties going to the smallest in code-point order, if that n is at least twice the word's own; its
    root is the last of the forms that follow each other, or the word itself. n_near counts near words. An empty table
    gives no rows.
    """
    pairs = materialised(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    good = -F.col("best.n") >= 2 * F.col("n")
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    named = materialised(named, "named")
    out = named.join(_rooted(named.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(materialised(vocabulary(table(spark, sf_dir, "documents")), "words"))


# The crc32 goes byte by byte through a table that the query makes; letters are one or two bytes of UTF-8. Words are
# near if they agree without one letter each, at the same place, or if one agrees with the other without a letter.
_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] when unicode(c) < 2048 then [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] else [0] end))"
_CRC = "list_reduce({}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), {})"

OP11_SQL = f"""
with recursive steps as (select list_transform(range(0, 256), lambda x: list_reduce(range(0, 8), lambda c, i: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, x)) as t),
d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents where text is not null),
runs as (select doc_id, run, count(*) as n from d group by doc_id, run),
ids as (select doc_id, t, {_CRC.format(_BYTES.format("coalesce(cast(doc_id as varchar), '') || ':'"), "4294967295")} as own from (select distinct doc_id from runs), steps),
hashed as (select run, n, xor({_CRC.format(_BYTES.format("run"), "own")}, 4294967295) as h from runs join ids on runs.doc_id is not distinct from ids.doc_id),
w as materialized (
  select word, cast(sum(n) as bigint) as n from (select case when h % {MISSPELT} = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed)
  group by word having length(word) >= {SHORTEST} and sum(n) >= {LEAST}
),
v as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as k from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
pairs as materialized (
  select distinct * from (
    select a.word as a, a.n as n_a, b.word as b, b.n as n_b from v a join v b on a.k = b.k and a.i = b.i and a.word <> b.word
    union all select v.word, v.n, w.word, w.n from v join w on v.k = w.word
    union all select w.word, w.n, v.word, v.n from v join w on v.k = w.word)
),
best as (select a as word, count(*) as n_near, max(n_b) as most from pairs group by a),
forms as (select a as word, min(b) as form from pairs join best on a = word and n_b = most group by a),
named as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 2 * w.n then forms.form end as form, case when most >= 2 * w.n then most end as form_n
  from w left join best on best.word = w.word left join forms on forms.word = w.word
),
up as (select word, form as root from named where form is not null union all select up.word, named.form from up join named on named.word = up.root where named.form is not null),
roots as (select up.word, up.root from up join named on named.word = up.root where named.form is null)
select named.word, form, coalesce(root, named.word) as root, n, n_near, form_n from named left join roots on roots.word = named.word
"""
