"""Toxicity by a learned weighted lexicon, matched with Aho-Corasick on folded text (operator 7)."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import bucket_of, by_bytes, materialised, table, unused

#: Labelled rows that the lexicon and its calibration are learned from: those with the lowest hashes.
LABELLED_ROWS = 8000
#: Entries of a lexicon, and exception phrases, those of most evidence first.
ENTRIES = 2000
#: Toxic documents an entry must occur in, and its least log odds ratio.
LEAST_DOCUMENTS, LEAST_LOG_ODDS = 4, 2.5
SHORTEST, LONGEST = 3, 10

# Characters that stand for Latin letters (Cyrillic, Greek, full-width), and digits or signs for letters.
HOMOGLYPHS = dict(
    zip(
        "авеѕіјкмнорсԁтухԛԝɡαεικνορτυχ",
        "abesijkmhopcdtyxqwgaeiknoptux",
        strict=True,
    )
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": " "}

_FOLD = {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b for a, b in SUBSTITUTES.items()}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$"}
_FOLD |= {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}


def folded(text: str | None) -> str:
    """Compatibility forms (such as mathematical letters) and look-alikes as plain letters, lower case, digits as
    letters, ASCII punctuation as spaces, a space at both ends."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """Entries are word beginnings (' abc') or whole words (' abc ') with weights; exceptions are phrases in which
    an entry doesn't count. `bias` and `slopes` turn a document's features into a probability."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -3.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        """Values are (length, weight, exception) of every entry and phrase."""
        if not self.entries:
            return None
        found = ahocorasick.Automaton()
        words = {f" {phrase} ": (len(phrase) + 2, 0.0, True) for phrase in self.exceptions}
        for entry, value in ({e: (len(e), w, False) for e, w in self.entries.items()} | words).items():
            found.add_word(entry, value)
        found.make_automaton()
        return found


def matches(text: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """The weight of each word of a folded text that an entry matches, by the place of the space before it. All
    matches are taken, so that neighbours may share a space; of a word's entries the longest counts, and a word
    inside an exception phrase counts for nothing."""
    longest: dict[int, tuple[int, float]] = {}
    excepted: set[int] = set()
    for end, (length, weight, exception) in automaton.iter(text):
        start = end - length + 1
        if exception:
            excepted.update(i for i in range(start, end) if text[i] == " ")
        elif longest.get(start, (0, 0.0))[0] < length:
            longest[start] = length, weight
    return {start: weight for start, (_, weight) in longest.items() if start not in excepted}


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """Summed weight on a log scale, weight per hundred characters on a log scale, and the largest weight."""
    if automaton is None:
        return 0.0, 0.0, 0.0
    weights = matches(text, automaton).values()
    total = math.fsum(weights)
    return math.log1p(total), math.log1p(100 * total / len(text)), max(weights, default=0.0)


def _terms(text: str) -> set[str]:
    out = set()
    for word in set(text.split()):
        if len(word) <= LONGEST:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by label: counted in the task first."""
    counts = Counter[str](), Counter[str]()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_terms(folded(text)))
    terms = list({*counts[0], *counts[1]})
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "toxic": pa.array([counts[1][t] for t in part], pa.int64()), "clean": pa.array([counts[0][t] for t in part], pa.int64())})


def _choose(rows: Sequence, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights by log odds; an entry is left out if a shorter beginning of it carries as much evidence."""
    odds = {r.term: math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1)) for r in rows}
    out: dict[str, float] = {}
    for term in sorted(odds, key=len):
        shorter = [term[:n] for n in range(SHORTEST + 1, len(term)) if term[:n] in out]
        if not shorter or odds[term] > max(out[s] for s in shorter) + 0.7:
            out[term] = odds[term]
    return out


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Lexicon:
    """A lexicon from at most `rows` labelled documents outside the held-out fold. Rows with a null doc_id, text
    or label are left out, and so are documents whose label rows contradict; without any, nothing is toxic."""
    own = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic"))
    own = own.filter("low = toxic").filter(bucket_of("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic")
    sample = materialised(docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(own), "doc_id").select("text", "toxic"), "labelled")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return Lexicon()
    terms = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.ln((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.ln((F.col("clean") + 0.5) / (n_clean + 1))
    strong = terms.filter(F.col("toxic") >= LEAST_DOCUMENTS).filter(odds >= LEAST_LOG_ODDS)
    chosen = strong.orderBy((odds * F.sqrt("toxic")).desc(), "term").limit(ENTRIES).collect()
    lexicon = Lexicon(_choose(chosen, n_toxic, n_clean))
    lexicon.exceptions = _exceptions(sample, lexicon)
    fields = "x array<double>, toxic long"
    rows_ = sample.mapInArrow(_labelled_features(lexicon), fields).toArrow()  # three numbers of at most `rows` texts
    x = np.array(rows_.column("x").to_pylist(), dtype=np.float64).reshape(-1, 3)
    order = np.lexsort((rows_.column("toxic").to_numpy(), *x.T))
    lexicon.bias, lexicon.slopes = _calibrate(x[order], rows_.column("toxic").to_numpy()[order].astype(np.float64))
    return lexicon


def _labelled_features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [features(folded(t.as_py()), automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "toxic": batch.column("toxic").cast(pa.int64())})

    return run


def _phrases(lexicon: Lexicon):
    """Phrases of a matched word and the word before it, with how many toxic and clean texts they occur in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = lexicon.automaton(), (Counter[str](), Counter[str]())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                text, phrases = folded(text.as_py()), set()
                for start in matches(text, automaton):
                    begin = max(0, start - 40)
                    before = text[begin:start].split()
                    if begin and not text[begin - 1 : begin + 1].count(" "):
                        before = before[1:]  # a word that the slice cut
                    if before:
                        phrases.add(f"{before[-1]} {text[start + 1 : text.find(' ', start + 1)]}")
                seen[toxic].update(phrases)
        every = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_pydict({"phrase": pa.array(every, pa.string()), "toxic": pa.array([seen[1][p] for p in every], pa.int64()), "clean": pa.array([seen[0][p] for p in every], pa.int64())})

    return run


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Phrases of an entry's word and the word before it that occur in clean documents (three at least) and in no
    toxic one, although the entry itself speaks for toxicity."""
    if not lexicon.entries:
        return frozenset()
    counts = sample.mapInArrow(_phrases(lexicon), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.filter("clean >= 3 and toxic = 0").orderBy(F.desc("clean"), "phrase").limit(ENTRIES).collect()
    return frozenset(r.phrase for r in found)


def _score(lexicon: Lexicon, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in by_bytes(batches):
            x = [features(folded(t.as_py()), automaton) for t in batch.column("text")]
            z = lexicon.bias + np.array(x, dtype=np.float64).reshape(-1, 3) @ np.array(lexicon.slopes)
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([score if f.name == name else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return run


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """docs with the probability of being toxic as a column of the given name, with underscores after it where docs
    has such a column. Null and empty texts have that of a text without any entry. Every row, repeated or not, is
    scored from its text alone."""
    (name,) = unused(docs, name)
    out = docs.withColumn(name, F.lit(0.0))
    return out.mapInArrow(_score(lexicon, name), out.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")), "score")
    return found.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic. Null and empty texts and null ids stay; each of repeated rows is
    judged from its own text."""
    (name,) = unused(docs, "toxicity")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), name).filter(F.col(name) < 0.5).drop(name)
