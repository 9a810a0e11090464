"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import bucket_of, table, unused

#: Documents that the network is trained on (those with the lowest hashes) and windows taken from all over each.
TRAINING_DOCUMENTS, WINDOWS_A_DOCUMENT = 2000, 6
#: Bytes read from one state to the next reset; every byte of a text lies in exactly one window.
WINDOW = 64
HIDDEN = 8
STEPS, BATCH, RATE = 350, 128, 0.02
#: Windows that run side by side.
SIDE = 4096
UNKNOWN = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Two gated recurrent units, one in each direction, and a softmax over languages at every byte.

    In each direction: update z, reset r = sigmoid(byte[z, r] + U[z, r] h), n = tanh(byte[n] + r * (U[n] h)),
    h = n + z * (h - n). `inputs` holds (256, 3 HIDDEN) a direction, `recurrent` (3 HIDDEN, HIDDEN).
    """

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray  # (languages, 2 HIDDEN)
    bias: np.ndarray

    @classmethod
    def random(cls, languages: list[str], hidden: int, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(languages, [small(256, 3 * hidden) for _ in range(2)], [small(3 * hidden, hidden) for _ in range(2)], small(len(languages), 2 * hidden), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]

    def states(self, windows: np.ndarray, direction: int, each: bool = False) -> np.ndarray:
        """Hidden states of windows (T, N) of bytes: their sums over time (HIDDEN, N), or all of them (T, HIDDEN, N)."""
        t_max, n = windows.shape
        hidden = self.recurrent[0].shape[1]
        # sigmoid(x) = (1 + tanh(x / 2)) / 2: halving the gates' rows leaves one tanh for both
        half = np.ones((3 * hidden, 1), np.float32)
        half[: 2 * hidden] = 0.5
        bytes_ = np.ascontiguousarray(self.inputs[direction].T * half)
        u = np.ascontiguousarray(self.recurrent[direction] * half)
        h, total = np.zeros((hidden, n), np.float32), np.zeros((hidden, n), np.float32)
        x, g = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        every = np.empty((t_max, hidden, n), np.float32) if each else None
        gates, cand = slice(0, 2 * hidden), slice(2 * hidden, None)
        for t in range(t_max) if direction == 0 else range(t_max - 1, -1, -1):
            np.take(bytes_, windows[t], axis=1, out=x, mode="clip")
            np.dot(u, h, out=g)
            x[gates] += g[gates]
            np.tanh(x[gates], out=x[gates])
            x[gates] += 1
            x[gates] *= 0.5
            g[cand] *= x[hidden : 2 * hidden]
            x[cand] += g[cand]
            np.tanh(x[cand], out=x[cand])
            h -= x[cand]
            h *= x[:hidden]
            h += x[cand]
            if every is None:
                total += h
            else:
                every[t] = h
        return total if every is None else every

    def window_sums(self, windows: np.ndarray) -> np.ndarray:
        """Log odds of the languages summed over the positions of windows (T, N): (languages, N)."""
        both = np.concatenate([self.states(windows, 0), self.states(windows, 1)])
        return self.out @ both + len(windows) * self.bias[:, None]

    def label_positions(self, text: str) -> list[str]:
        """The likeliest language at every byte of a text."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.intp)
        out: list[str] = []
        for a in range(0, len(raw), WINDOW):
            window = raw[a : a + WINDOW, None]
            h = np.concatenate([self.states(window, d, each=True) for d in range(2)], axis=1)
            out += [self.languages[i] for i in (np.einsum("kh,thn->tk", self.out, h) + self.bias).argmax(axis=1)]
        return out

    def probabilities(self, texts: Sequence[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, languages): the normalised geometric mean over all positions. Softmax
        denominators cancel in it, so log odds are summed. Empty texts get the uniform distribution."""
        sums = np.zeros((len(texts), len(self.languages)))
        lengths = np.array([len(t) for t in texts])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        full = lengths // WINDOW
        owner = np.repeat(np.arange(len(texts)), full)
        at = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)) * WINDOW
        jobs = [(WINDOW, owner, at)]
        rest = lengths % WINDOW
        jobs += [(int(r), rows := np.flatnonzero(rest == r), starts[rows] + full[rows] * WINDOW) for r in np.unique(rest[rest > 0])]
        for length, rows, begin in jobs:
            for i in range(0, len(rows), SIDE):
                windows = buf[begin[i : i + SIDE] + np.arange(length)[:, None]].astype(np.intp)
                np.add.at(sums, rows[i : i + SIDE], self.window_sums(windows).T)
        mean = sums / np.maximum(lengths, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
    t_max, n = windows.shape
    k, hidden = len(net.languages), net.recurrent[0].shape[1]
    tapes, hs = [], []
    for d in range(2):
        h, tape, out = np.zeros((hidden, n), np.float32), [], np.empty((t_max, hidden, n), np.float32)
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            x, g = net.inputs[d].T[:, windows[t]], net.recurrent[d] @ h
            zr = 1 / (1 + np.exp(-(x[: 2 * hidden] + g[: 2 * hidden])))
            z, r = zr[:hidden], zr[hidden:]
            c = np.tanh(x[2 * hidden :] + r * g[2 * hidden :])
            new = c + z * (h - c)
            tape.append((t, h, z, r, c, g[2 * hidden :]))
            out[t] = h = new
        tapes.append(tape)
        hs.append(out)
    both = np.concatenate(hs, axis=1)
    logits = np.einsum("kh,thn->tkn", net.out, both) + net.bias[None, :, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    right = p[:, labels, np.arange(n)]
    loss = float(-np.log(right + 1e-12).mean())
    p[:, labels, np.arange(n)] -= 1
    p /= t_max * n
    d_out, d_bias = np.einsum("tkn,thn->kh", p, both), p.sum(axis=(0, 2))
    d_both = np.einsum("kh,tkn->thn", net.out, p)
    d_inputs, d_recurrent = [], []
    for d in range(2):
        d_in, d_u = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(net.recurrent[d])
        d_h, own = np.zeros((hidden, n), np.float32), d_both[:, d * hidden : (d + 1) * hidden]
        for t, before, z, r, c, gc in reversed(tapes[d]):
            d_h = d_h + own[t]
            d_z = d_h * (before - c) * z * (1 - z)
            d_c = d_h * (1 - z) * (1 - c * c)
            d_r = d_c * gc * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c])
            d_g = np.concatenate([d_z, d_r, d_c * r])
            np.add.at(d_in, windows[t], d_x.T)
            d_u += d_g @ before.T
            d_h = d_h * z + net.recurrent[d].T @ d_g
        d_inputs.append(d_in)
        d_recurrent.append(d_u)
    return loss, [*d_inputs, *d_recurrent, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS) -> Network:
    """Adam on batches with each language equally often. windows: (N, T) bytes, labels: indices of languages."""
    net, rng = Network.random(languages, hidden), np.random.default_rng(5)
    of = [np.flatnonzero(labels == i) for i in range(len(languages))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        classes = rng.integers(0, len(languages), BATCH)
        rows = np.array([of[c][rng.integers(0, len(of[c]))] for c in classes])
        _, grads = _gradients(net, windows[rows].T.astype(np.intp), classes)
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread over the whole of each document; a shorter text is repeated to fill one."""
    for batch in batches:
        langs, parts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8")
            if not raw:
                continue
            if len(raw) < WINDOW:
                raw = (raw + b" ") * (WINDOW // len(raw) + 1)
            for at in np.unique(np.linspace(0, len(raw) - WINDOW, WINDOWS_A_DOCUMENT).astype(int)):
                langs.append(lang)
                parts.append(raw[at : at + WINDOW])
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.binary())})


def fit(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> Network | None:
    """A network trained on at most `documents` documents with text and language outside the held-out fold; None
    without any. Languages outside that sample are not learned."""
    learn = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null").filter(bucket_of("doc_id", 3) != 1)
    ids = learn.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)  # ids first: few bytes are sorted
    sample = learn.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_windows, "lang string, part binary").toArrow()
    langs = sample.column("lang").to_pylist()
    if not langs:
        return None
    languages = sorted(set(langs))
    windows = np.frombuffer(b"".join(sample.column("part").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([languages.index(x) for x in langs]), languages)


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text or ""))  # the pattern also takes signs like ²


def _predict(net: Network | None, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if net else []
            at, size = 0, 0
            for end, i in enumerate(rows, 1):  # about 256 KB side by side
                size += len(texts[i])
                if size >= 262_144 or end == len(rows):
                    p = net.probabilities([texts[j].encode("utf-8") for j in rows[at:end]])
                    for j, q in zip(rows[at:end], p, strict=True):
                        lang[j], score[j] = net.languages[int(q.argmax())], float(q.max())
                    at, size = end, 0
            new = dict(zip(names, (pa.array(lang, pa.string()), pa.array(score, pa.float64())), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return run


def predicted(docs: DataFrame, net: Network | None, names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its pooled probability as columns of the given names, with underscores after them
    where docs has such columns. Null texts and texts without a letter are `und` with score 0; every row is judged
    from its text alone."""
    names = unused(docs, *names)
    out = docs.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    return out.mapInArrow(_predict(net, names), out.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predicted(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
