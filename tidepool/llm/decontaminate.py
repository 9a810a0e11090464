"""Benchmark decontamination with a generalised suffix automaton of the test items (operator 4)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import PLAIN_WORDS, by_bytes, chunks, folded_bytes, mix, placed_word_hashes, table, unused, word_hashes

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents holds, so that what is broadcast has a bound. More text
#: makes more passes.
PASS_BYTES = 16_000_000
#: Bytes of items in one automaton, and automata that a worker keeps. An automaton is built when a document has a
#: window of its items.
AUTOMATON_BYTES, AUTOMATA = 250_000, 8
#: The pipeline cuts matches of so many words or more from documents that stay.
LONG_MATCH = 50


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ODD = np.random.default_rng(41).integers(0, 2**64, size=4096, dtype=np.uint64) | np.uint64(1)


class SuffixAutomaton:
    """Suffix automaton of several sequences of word ids.

    `windows[v]` is the state that holds the `window`-word suffix of every match of that length in v;
    `items[u]` the items in which the strings of u occur (kept for window states and whole short items);
    `shorts[v]` the (length, state) of whole items shorter than the window that end wherever v matches.
    """

    def __init__(self, sequences: Sequence[tuple[int, Sequence[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for item, words in sequences:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append((item, path))
        self._label(ends, window)

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the longest string of p followed by w, cloned from its class if that holds longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _label(self, ends: list[tuple[int, list[int]]], window: int) -> None:
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.windows = [-1] * n
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.windows[v] = v if self.length[up] < window else self.windows[up]
        self.items: dict[int, set[int]] = {}
        whole: dict[int, int] = {}
        for item, path in ends:
            if not path:
                continue
            if len(path) < window:
                # the state of a whole item also stands for its occurrences in other items' text
                whole[path[-1]] = len(path)
                self.items.setdefault(path[-1], set()).add(item)
            for v in path:
                if self.windows[v] >= 0:
                    self.items.setdefault(self.windows[v], set()).add(item)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order:
            own = ((whole[v], v),) if v in whole else ()
            self.shorts[v] = own + self.shorts[self.link[v]]

    def matches(self, words: Sequence[int], window: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each window or whole short item that ends at a word."""
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            else:
                matched = 0
            if matched >= window:
                u = self.windows[state]
                yield i + 1, window, u
            for length, u in self.shorts[state]:
                if matched >= length:
                    yield i + 1, length, u

    def longest(self, words: Sequence[int], least: int) -> Iterator[tuple[int, int]]:
        """(begin, end) of each match of at least `least` words that no word before or after it extends."""
        state = matched = 0
        for i, w in enumerate(words):
            if matched >= least and w not in self.next[state]:
                yield i - matched, i
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            else:
                matched = 0
        if matched >= least:
            yield len(words) - matched, len(words)


class Part:
    """The automaton of some items over ids of their real words."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int):
        self.names, self.window, self.ids = [name for name, _ in items], window, {}
        sequences = [(i, [self.ids.setdefault(w, len(self.ids)) for w in _WORD.findall(text)]) for i, (_, text) in enumerate(items)]
        self.automaton = SuffixAutomaton(sequences, window)

    def found(self, words: Sequence[bytes], least: int | None) -> tuple[list[tuple[int, int]], set[str], list[tuple[int, int]]]:
        """Hit spans in words, items that occur, and the longest matches of at least `least` words."""
        ids, spans, names = [self.ids.get(w, -1) for w in words], [], set()
        for stop, length, state in self.automaton.matches(ids, self.window):
            spans.append((stop - length, stop))
            names.update(self.names[x] for x in self.automaton.items[state])
        return spans, names, [*self.automaton.longest(ids, least)] if least else []


class Matcher:
    """Finds the windows of items by hash and hands runs of words around them to the items' automata.

    Equal words have equal hashes, so no window is overlooked; what is reported was matched by real words."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int):
        self.window, self.parts, self.built = window, [], {}
        size = AUTOMATON_BYTES
        for item in items:
            if size + len(item[1]) > AUTOMATON_BYTES and (size or not self.parts):
                self.parts.append([])
                size = 0
            self.parts[-1].append(item)
            size += len(item[1])
        hashes, bounds = word_hashes([t for part in self.parts for _, t in part], PLAIN_WORDS)
        of_item = np.repeat(np.arange(len(self.parts)), [len(p) for p in self.parts])
        self.vocabulary = np.unique(hashes)
        lengths = np.diff(bounds)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({min(int(x), window) for x in lengths if x}):
            own = np.flatnonzero(lengths >= n) if n == window else np.flatnonzero(lengths == n)
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1] - n + 1) for i in own])
            part = np.repeat(of_item[own], [lengths[i] - n + 1 for i in own])
            pairs = np.unique(np.stack([self._rolled(hashes, at, n), part.astype(np.uint64)], axis=1), axis=0)
            self.windows[n] = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)

    @staticmethod
    def _rolled(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            out += hashes[at + j] * _ODD[j % len(_ODD)]
        return mix(out)

    def _part(self, i: int) -> Part:
        part = self.built.pop(i, None) or Part(self.parts[i], self.window)
        self.built[i] = part  # the one used last stands at the end
        if len(self.built) > AUTOMATA:
            del self.built[next(iter(self.built))]
        return part

    def _wanted(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """For each text with windows of items, the parts they belong to."""
        out: dict[int, set[int]] = {}
        if not len(self.vocabulary):
            return out
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        # words in a row that are known and belong to one text
        unknown = np.concatenate(([0], np.cumsum(self.vocabulary[ids] != hashes)))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for n, (keys, parts) in self.windows.items():
            at = np.arange(max(0, len(hashes) - n + 1))
            at = at[(unknown[at + n] == unknown[at]) & (text[at] == text[at + n - 1])] if len(at) else at
            rolled = self._rolled(hashes, at, n)
            low, high = np.searchsorted(keys, rolled), np.searchsorted(keys, rolled, side="right")
            for i in np.flatnonzero(high > low):
                out.setdefault(int(text[at[i]]), set()).update(parts[low[i] : high[i]].tolist())
        return out

    def scan(self, raw: Sequence[bytes], least: int | None = None) -> Iterator[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
        """For each text its number of words, disjoint hit spans in words, the items that occur, and with `least` begin
        and end in code points of the longest matches of at least so many words; overlapping ones are one."""
        hashes, bounds = word_hashes(raw, PLAIN_WORDS)
        wanted = self._wanted(hashes, bounds)
        for i, text in enumerate(raw):
            spans, names, long = [], set(), []
            if i in wanted:
                words = _WORD.findall(text)
                for part in sorted(wanted[i]):
                    own = self._part(part).found(words, least)
                    spans += own[0]
                    names |= own[1]
                    long += own[2]
            if long:
                _, _, first, last = placed_word_hashes([text], PLAIN_WORDS)
                long = merged([(int(first[a]), int(last[b - 1])) for a, b in long])
            yield int(bounds[i + 1] - bounds[i]), merged(spans), names, long


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: Broadcast, window: int) -> Matcher:
    """One automaton a worker process, kept until another is asked for."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, window)
    return _MATCHERS[key]


_FOUND = "struct<n_words: bigint, spans: array<bigint>, items: array<string>, matches: array<bigint>>"


def _pass(key: str, items: Broadcast, window: int, least: int | None, name: str):
    """Adds to the column of the given name: n_words, spans (begin, end, begin, end, ... in words), items, matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, window)
        for batch in by_bytes(batches):
            raw, rows = folded_bytes(batch.column("text").to_pylist()), []
            before = batch.column(name).to_pylist()
            for a, b in chunks(raw):
                for i, (n, spans, names, long) in enumerate(matcher.scan(raw[a:b], least), a):
                    pairs = [(old[::2], old[1::2], new) for old, new in ((before[i]["spans"], spans), (before[i]["matches"], long))]
                    both = [[x for s in merged([*zip(begin, end, strict=True), *new]) for x in s] for begin, end, new in pairs]
                    rows.append({"n_words": n, "spans": both[0], "items": sorted({*before[i]["items"], *names}), "matches": both[1]})
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int | None = None, name: str = "contamination") -> DataFrame:
    """docs with a column of the given name, with underscores after it where docs has such a column: n_words, spans
    (hit words as begin, end pairs in a flat list), items (ids as text) and matches.

    Words are lower-cased in A-Z and split at ASCII bytes other than letters and digits. A window is `window`
    consecutive words of an item, or the whole of a shorter one. Null and empty texts have no words; items with a
    null id or without words never match; repeated rows are judged one by one. With `least`, matches is a flat list
    of begin and end in code points of the longest matches of at least so many words; overlapping ones are one.
    """
    if least is not None and least < window:
        raise ValueError("least must not be below the window")
    spark, (name,) = docs.sparkSession, unused(docs, name)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")).filter("item is not null and words is not null")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = total // PASS_BYTES + 1
    none = F.named_struct(F.lit("n_words"), F.lit(0).cast("long"), F.lit("spans"), F.array().cast("array<bigint>"), F.lit("items"), F.array().cast("array<string>"), F.lit("matches"), F.array().cast("array<bigint>"))
    out = docs.withColumn(name, none.cast(_FOUND))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "words").collect()  # at most about PASS_BYTES
        sent = spark.sparkContext.broadcast([(r.item, r.words.encode("utf-8").lower()) for r in own])
        key = hashlib.sha256(repr([window, sent.value]).encode()).hexdigest()
        out = out.mapInArrow(_pass(key, sent, window, least, name), out.schema)
    return out


def n_hit(spans: str) -> Column:
    """Hit words of the flat begin, end list: odd places count positive, even ones negative."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs; contaminated if at least
    a twentieth of the words are hit."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window, name="found").select("doc_id", "found.*").withColumn("n_hit", n_hit("spans"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, limit: int | None = None) -> DataFrame:
    """docs without the rows of which at least `share` of the words is hit. With `limit`, the longest matches of at
    least so many words are cut from the texts of the others; otherwise they stay as they are. Null and empty texts
    and null ids stay; repeated rows fare alike."""
    name, edges = unused(docs, "contamination", "edges")
    found = contamination(docs, benchmark, window, limit, name)
    hits, long = n_hit(f"{name}.spans"), F.col(f"{name}.matches")
    left = found.filter(~((hits > 0) & (hits >= F.lit(share) * F.col(f"{name}.n_words"))))
    if limit:
        left = left.withColumn(edges, F.concat(F.array(F.lit(0).cast("long")), long, F.array(F.length("text").cast("long"))))
        piece = f"substring(text, cast({edges}[2 * i] + 1 as int), cast({edges}[2 * i + 1] - {edges}[2 * i] as int))"
        cut = F.expr(f"array_join(transform(sequence(0, cast(size({name}.matches) / 2 as int)), i -> {piece}), '')")
        left = left.withColumn("text", F.when(F.size(long) > 0, cut).otherwise(F.col("text")))
    return left.select(*docs.columns)


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
b as (select cast(item_id as varchar) as item, {_WORDS.format("text")} as ws from benchmark where item_id is not null and text is not null),
win as (select distinct item, least(len(ws), 13) as n, array_to_string(ws[i : i + 12], ' ') as k from (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
dw as (select r, i, n, array_to_string(ws[i : i + n - 1], ' ') as k from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from win))),
hits as (select r, i, n, item from dw join win using (n, k)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hits)) group by r),
names as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words using (r) left join names using (r)
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates, and cuts long matches from the others."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), limit=LONG_MATCH)
