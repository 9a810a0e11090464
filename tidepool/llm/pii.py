"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import table, unused

KINDS = ("email", "ip", "card", "phone")
#: What the field looks for: the kinds of the patterns, and passwords, tokens and access keys.
LABELS = (*KINDS, "secret")
#: Documents with digits or @ that the field is trained on (those with the lowest hashes); half the
#: regions of them that are learned from, each also in another writing.
TRAINING_DOCUMENTS, TRAINING_REGIONS = 1500, 500
EPOCHS, RATE = 6, 0.3
#: Most tokens of an entity, and how far apart two anchors of one region may be.
LONGEST, GAP = 16, 12

Span = tuple[str, int, int]

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Writings of secrets that the field is taught with; it generalises from their features.
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:(?i:password|passwd|token|secret|api_?key)\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9]{8,})|(AKIA[0-9A-Z]{12,}))(?![A-Za-z0-9_])")
_RUN = re.compile(r"(?<![^\W_])[A-Za-z0-9]{8,}(?![^\W_])")
_NAMED = re.compile(r"(?i:pass|pwd|token|secret|key|auth|credential)[a-z_-]{0,6}\W{0,4}\Z")

_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[^\s]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping in each kind; failing matches are dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of eight or more letters and digits, with at least one of each, as secrets are."""
    for m in _RUN.finditer(text, start, len(text) if end is None else end):
        if _DIGIT.search(m.group()) and not m.group().isdigit():
            yield m.start(), m.end()


def _word_around(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch with letters and digits that touch it, at most 64 on each side."""
    low, high = max(0, start - 64), min(len(text), end + 64)
    while start > low and text[start - 1].isalnum():
        start -= 1
    while end < high and text[end].isalnum():
        end += 1
    return start, end


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around words with digits or @ with a few characters on both sides, apart from each other."""
    start = end = -1
    for m in _ANCHOR.finditer(text):
        if m.end() <= end:
            continue
        low, high = _word_around(text, m.start(), m.end())
        if end >= 0 and low - end > 2 * GAP:
            yield max(0, start - GAP), min(len(text), end + GAP)
            start = low
        elif end < 0:
            start = low
        end = max(end, high)
    if end >= 0:
        yield max(0, start - GAP), min(len(text), end + GAP)


FEATURES = 40


def _features(text: str, start: int, end: int) -> np.ndarray:
    """Whole-span features of a candidate entity."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, parts = len(digits), s.split(".")
    before, after = text[start - 1 : start], text[end : end + 1]
    local, _, domain = s.partition("@")
    quads = len(parts) == 4 and all(p.isdigit() for p in parts)
    spaced = [len(p) for p in re.split(r"[^0-9]+", s) if p]
    run = n < len(s) and n > 0 and s.isascii() and s.isalnum()
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) if run else 0
    x = (
        1, "@" in s, s.count("@") == 1 and bool(local) and _DOMAIN.fullmatch(domain) is not None, bool(re.search("[^\\W\\d_]", s)),
        s[0] == "+", s[0] == "(", "(" in s and ")" in s, "(" in s and ")" not in s, " " in s, "-" in s, "." in s,
        n < 7, 7 <= n <= 8, 9 <= n <= 11, n == 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        12 <= n <= 19 and luhn(digits), quads, quads and all(map(_small, parts)), s.isdigit(),
        before.isalnum() or before in ("_", "@"), after.isalnum() or after in ("_", "@"), before in ("=", '"', "+", "#", "$"),
        after == "." and text[end + 1 : end + 2].isalnum(), before in (".", "-", "(") and text[start - 2 : start - 1].isalnum(),
        spaced[-2:] == [3, 4], len(spaced) > 2 and len(set(spaced)) == 1, after in (")", "-") and text[end + 1 : end + 2].isdigit(),
        run, run and len(s) >= 12, run and len(s) >= 16, run and len(s) >= 24, run and changes >= 3, run and changes >= 6, run and s.isupper(), run and not s.isupper() and not s.islower(),
        run and _NAMED.search(text, max(0, start - 16), start) is not None, run and before in ("=", ":", '"', "'"),
    )
    return np.array(x, dtype=np.float64)


@dataclass
class Region:
    """Tokens of a stretch of text, its candidate entities (first token, one past the last), and their features."""

    tokens: list[tuple[int, int]]
    candidates: list[tuple[int, int]]
    x: np.ndarray
    plain: np.ndarray  # (tokens, 3): word or space, digits, other sign

    @classmethod
    def of(cls, text: str, start: int, end: int) -> Region:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        heads = [text[a] for a, _ in tokens]
        digit = [c.isascii() and c.isdigit() for c in heads]
        digits = np.concatenate(([0], np.cumsum([(b - a) * d for (a, b), d in zip(tokens, digit, strict=True)])))
        signs = np.concatenate(([0], np.cumsum([c == "@" for c in heads])))
        candidates = []
        for i, c in enumerate(heads):
            if not (digit[i] or c.isalpha() or c in "+("):
                continue
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                if (digit[j - 1] or heads[j - 1].isalpha()) and (digits[j] - digits[i] >= 7 or signs[j] > signs[i] or (digits[j] - digits[i] >= 4 and j - i == 7)):
                    if signs[j] == signs[i] and (c.isalpha() or heads[j - 1].isalpha()):
                        continue
                    candidates.append((i, j))
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        known = set(candidates)
        candidates += [c for a, b in runs(text, start, end) if a in first and b in last and (c := (first[a], last[b])) not in known]
        x = np.array([_features(text, tokens[i][0], tokens[j - 1][1]) for i, j in candidates]).reshape(-1, FEATURES)
        plain = np.array([[c.isalpha() or c.isspace(), d, not (d or c.isalpha() or c.isspace())] for c, d in zip(heads, digit, strict=True)], dtype=np.float64)
        return cls(tokens, candidates, x, plain.reshape(-1, 3))


def _lse(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    out = np.log(np.exp(x - m).sum(axis=axis, keepdims=True) + 1e-300) + m
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


@dataclass
class SemiMarkovField:
    """Scores of segmentations: whole-span weights of each kind, weights of tokens outside entities, and weights of
    neighbouring segments' labels (0 outside, then the kinds)."""

    spans: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(LABELS))))
    outside: np.ndarray = field(default_factory=lambda: np.zeros(3))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS) + 1, len(LABELS) + 1)))

    def _into(self, r: Region) -> list[list[int]]:
        into: list[list[int]] = [[] for _ in range(len(r.tokens) + 1)]
        for c, (_, j) in enumerate(r.candidates):
            into[j].append(c)
        return into

    def best(self, r: Region) -> list[tuple[int, int, int]]:
        """(first token, one past the last, kind) of the entities of the best segmentation."""
        n, labels = len(r.tokens), len(LABELS) + 1
        score, out = r.x @ self.spans, r.plain @ self.outside
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0
        back: list[list[tuple[int, int]]] = [[(-1, -1)] * labels for _ in range(n + 1)]
        into = self._into(r)
        for j in range(1, n + 1):
            by = best[j - 1] + self.moves[:, 0]
            p = int(by.argmax())
            best[j, 0], back[j][0] = by[p] + out[j - 1], (j - 1, p)
            for c in into[j]:
                i = r.candidates[c][0]
                by2 = best[i][:, None] + self.moves[:, 1:]
                p2 = by2.argmax(axis=0)
                for k in range(labels - 1):
                    v = by2[p2[k], k] + score[c, k]
                    if v > best[j, k + 1]:
                        best[j, k + 1], back[j][k + 1] = v, (i, int(p2[k]))
        found, j, label = [], n, int(best[n].argmax())
        while j > 0:
            i, p = back[j][label]
            if label:
                found.append((i, j, label - 1))
            j, label = i, p
        return found[::-1]

    def step(self, r: Region, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log likelihood of the gold entities, by forward and backward sums."""
        n, labels = len(r.tokens), len(LABELS) + 1
        score, out, into = r.x @ self.spans, r.plain @ self.outside, self._into(r)
        forth, back = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        forth[0, 0], back[n] = 0, 0
        for j in range(1, n + 1):
            forth[j, 0] = _lse(forth[j - 1] + self.moves[:, 0]) + out[j - 1]
            if into[j]:
                forth[j, 1:] = _lse(np.stack([_lse(forth[r.candidates[c][0]][:, None] + self.moves[:, 1:], 0) + score[c] for c in into[j]]), 0)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, _) in enumerate(r.candidates):
            starts[i].append(c)
        for i in range(n - 1, -1, -1):
            ways = [self.moves[:, 0] + out[i] + back[i + 1, 0]]
            ways += [_lse(self.moves[:, 1:] + score[c] + back[r.candidates[c][1], 1:], 1) for c in starts[i]]
            back[i] = _lse(np.stack(ways), 0)
        z = _lse(forth[n])
        d_spans, d_out, d_moves = np.zeros_like(self.spans), np.zeros(3), np.zeros_like(self.moves)
        for j in range(n):
            p = np.exp(forth[j] + self.moves[:, 0] + out[j] + back[j + 1, 0] - z)
            d_moves[:, 0] -= p
            d_out -= p.sum() * r.plain[j]
        for c, (i, j) in enumerate(r.candidates):
            p = np.exp(forth[i][:, None] + self.moves[:, 1:] + score[c] + back[j, 1:] - z)
            d_moves[:, 1:] -= p
            d_spans -= np.outer(r.x[c], p.sum(axis=0))
        ends = {i: (j, k) for (i, j), k in gold.items()}
        at = last = 0
        while at < n:
            if at in ends:
                j, k = ends[at]
                d_spans[:, k] += r.x[r.candidates.index((at, j))]
                d_moves[last, k + 1] += 1
                at, last = j, k + 1
            else:
                d_out += r.plain[at]
                d_moves[last, 0] += 1
                at, last = at + 1, 0
        self.spans += rate * (d_spans - 1e-3 * self.spans)
        self.outside += rate * d_out
        self.moves += rate * d_moves


def gold_of(r: Region, spans: Sequence[Span]) -> dict[tuple[int, int], int]:
    """The base spans that are candidates of the region; of overlapping ones the first."""
    starts, ends = {a: i for i, (a, _) in enumerate(r.tokens)}, {b: i + 1 for i, (_, b) in enumerate(r.tokens)}
    out, free, candidates = {}, 0, set(r.candidates)
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a in starts and b in ends and starts[a] >= free and (starts[a], ends[b]) in candidates:
            out[starts[a], ends[b]] = LABELS.index(kind)
            free = ends[b]
    return out


def labelled(text: str) -> list[Span]:
    """Base spans as training labels: cards and phone numbers are looked for with addresses blanked out, which would
    otherwise run into them."""
    first = [s for s in base_spans(text) if s[0] in ("email", "ip")]
    blank = text
    for _, a, b in first:
        blank = blank[:a] + "|" * (b - a) + blank[b:]
    named = [("secret", *m.span(1 if m.group(1) else 2)) for m in _SECRET.finditer(text)]
    named = [s for s in named if _DIGIT.search(text[s[1] : s[2]]) and not text[s[1] : s[2]].isdigit()]
    return sorted(first + named + [s for s in base_spans(blank) if s[0] in ("card", "phone")], key=lambda s: s[1])


#: Ways to write a phone number of three parts, and what to put between a card number's four groups.
_PHONES, _CARD_GAPS = ("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}"), (" ", ".", "-", "/")
#: Ordinary runs of letters and digits, which are no secrets.
_PLAIN_RUNS = ("section12b", "model2000x", "covid19cases", "version10", "2ndedition", "mp3player", "windows95", "chapter7page12", "h264video", "20thcentury")


def _varied(text: str, spans: Sequence[Span], turn: int, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with one labelled span written in another usual way that the patterns may miss, or with a secret
    replaced by another one, or by an ordinary run, which then is no span."""
    order = [*range(turn % max(1, len(spans)), len(spans)), *range(turn % max(1, len(spans)))]
    for at in order:
        kind, a, b = spans[at]
        digits, gone = "".join(c for c in text[a:b] if c.isdigit()), False
        if kind == "phone" and len(digits) >= 10:
            new = _PHONES[turn % 4].format(digits[-10:-7], digits[-7:-4], digits[-4:])
        elif kind == "card" and len(digits) == 16:
            new = _CARD_GAPS[turn % 4].join(digits[i : i + 4] for i in range(0, 16, 4))
        elif kind == "secret" and (gone := turn % 3 == 0):
            new = _PLAIN_RUNS[turn // 3 % len(_PLAIN_RUNS)]
        elif kind == "secret":
            letters = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMN23456789")[turn % 3]
            new = "".join(rng.choice(list(letters), int(rng.integers(12, 44))))
            new = new if _DIGIT.search(new) and not new.isdigit() else f"a1{new}"
        else:
            continue
        before = text[:a].rsplit("=", 1)[0].rsplit(":", 1)[0] + " " if gone else text[:a]
        moved = [(k, s, e) for k, s, e in spans if e <= len(before)] + [(kind, len(before), len(before) + len(new))] * (not gone)
        shift = len(before) + len(new) - b
        return before + new + text[b:], moved + [(k, s + shift, e + shift) for k, s, e in spans if s >= b]
    return text, list(spans)


def train(texts: Sequence[str]) -> SemiMarkovField:
    """A field that agrees with the base patterns on the texts' regions, and with varied writings of them."""
    rng, samples = np.random.default_rng(9), []
    for t in texts:
        if len(samples) >= 2 * TRAINING_REGIONS:
            break
        for start, end in regions(t):
            part = t[start:end]
            spans = labelled(part)
            for turn in range(1 + bool(spans)):
                text, own = (part, spans) if not turn else _varied(part, spans, len(samples) // 2, rng)
                r = Region.of(text, 0, len(text))
                if r.candidates and len(r.tokens) < 400:
                    samples.append((r, gold_of(r, own)))
    model = SemiMarkovField()
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            model.step(*samples[i], RATE / (1 + epoch))
    return model


def fit(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> SemiMarkovField:
    """Trained on the regions of at most `documents` texts with a digit or @; without any it adds no spans."""
    anchored = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    ids = anchored.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)  # ids first: few bytes are sorted
    rows = anchored.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_region_texts, "part string").orderBy(F.xxhash64("part"), "part").limit(4 * TRAINING_REGIONS).toArrow()
    return train(rows.column("part").to_pylist())


def _region_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [t[a:b] for t in batch.column("text").to_pylist() for a, b in regions(t) if b - a < 500]
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.string())})


def spans_of(text: str, model: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: the field's entities that overlap no base span join them."""
    base = base_spans(text)
    added: list[Span] = []
    for start, end in regions(text):
        own = [s for s in base if s[1] < end and s[2] > start]
        r = Region.of(text, start, end)
        if not r.candidates:
            continue
        for i, j, k in model.best(r):
            a, b = r.tokens[i][0], r.tokens[j - 1][1]
            if all(b <= s[1] or a >= s[2] for s in own):
                added.append((LABELS[k], a, b))
    return base, sorted({*base, *added}, key=lambda s: (s[1], LABELS.index(s[0]), s[2]))


#: The fields of a document's personal data.
FOUND = "struct<base: string, spans: string, " + ", ".join(f"n_{k}: bigint" for k in (*LABELS, "spans")) + ">"


def _find(model: SemiMarkovField, name: str):
    names = ["base", "spans", *(f"n_{k}" for k in (*LABELS, "spans"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column("text"):
                own, every = spans_of(t.as_py() or "", model)
                joined = (",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in (own, every))
                rows.append((*joined, *(sum(s[0] == k for s in own) for k in KINDS), sum(s[0] == "secret" for s in every), len(every)))
            columns = [pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.string() if i < 2 else pa.int64()) for i in range(len(names))]
            new = pa.StructArray.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([new if f.name == name else batch.column(i) for i, f in enumerate(batch.schema)], names=batch.schema.names)

    return run


def found(docs: DataFrame, model: SemiMarkovField, name: str = "found") -> DataFrame:
    """docs with a column of the given name, with underscores after it where docs has such a column: base and spans
    (kind:start:end in code points, comma-joined), counts of the base kinds, of secrets, and of all spans. Null and
    empty texts have none; every row is searched on its own."""
    (name,) = unused(docs, name)
    out = docs.withColumn(name, F.lit(None).cast(FOUND))
    return out.mapInArrow(_find(model, name), out.schema)


def masked(docs: DataFrame, model: SemiMarkovField) -> DataFrame:
    """docs with every span replaced by its kind in brackets; other columns and rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                done, parts = 0, []
                for kind, a, b in spans_of(t or "", model)[1]:
                    if a >= done:
                        parts += [t[done:a], f"[{kind}]"]
                    done = max(done, b)
                out.append(None if t is None else "".join([*parts, t[done:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if f.name == "text" else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = found(docs, fit(docs)).select("doc_id", "found.*")
    counts = [F.col(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_spans")
