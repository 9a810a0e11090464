"""Spelling variants, document fingerprints and token alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tidepool.llm import common, fingerprints, spelling_variants, token_alignment


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    near = {w: [] for w in words}
    names = sorted(words)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def as_found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("most", [10_000, 1])
def test_variants_are_those_of_all_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(spelling_variants.near_words, "__defaults__", (most,))
    rng = random.Random(most)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = {w: rng.choice([3, 4, 8, 16, 40]) for w in base}
    for w in base:
        for _ in range(4):
            at, c = rng.randrange(len(w) + 1), rng.choice("abcéz")
            v = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.setdefault(v, rng.randint(3, 50))
    words |= {"aaaaaa" + c: 5 + i for i, c in enumerate("bcdefghijklmnop")} | {"x" * 3000 + "ab": 3, "x" * 3000 + "b": 9, "x" * 2999 + "ab": 20}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_found(spelling_variants.variants(df)) == grouped(words)


def test_variants_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_found(spelling_variants.op11_spelling_variants(spark, SF)) == grouped(counted(rows))


def test_vocabulary_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(spelling_variants, "COUNTED_AT_ONCE", 2)
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(i, "Straße STRASSE straße ÀÉÎ÷×ab élan vital") for i in range(40)] + [(None, "nobody nobody nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling_variants.vocabulary(docs).collect()}
    assert got == counted(rows) and {"straße", "ÀÉÎ÷×ab", "vital", "nobody"} <= got.keys()
    assert spelling_variants.vocabulary(nothing).count() == 0 and spelling_variants.variants(spelling_variants.vocabulary(nothing)).count() == 0


def aligned(rows):
    """Each text encoded as a whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.byte_vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.piece_model())
    letters = token_alignment._byte_letters()
    links, out, every = [], [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            out.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [{len(b"".join(raw[: i + 1])): i + 1 for i in range(len(raw))} if len(raw) < 300 else dict(zip(__import__("itertools").accumulate(map(len, raw)), range(1, len(raw) + 1), strict=True)) for raw in (raw_a, raw_b)]
        both = sorted(ends[0].keys() & ends[1].keys())
        cuts = [(0, 0), *((ends[0][e], ends[1][e]) for e in both)]
        digest = ";".join(f"{','.join(map(str, ids_a[i:j]))}|{','.join(map(str, ids_b[k:m]))}" for (i, k), (j, m) in zip(cuts, cuts[1:], strict=False))
        links.append([(ids_a[i - 1], ids_b[j - 1]) for i, j in cuts[1:]])
        every.update(links[-1])
        out.append((doc_id, len(ids_a), len(ids_b), len(both), hashlib.sha256(digest.encode()).hexdigest()))
    highest = {}
    for (_, y), n in every.items():
        highest[y] = max(n, highest.get(y, 0))
    sums = [(len(own), sum(every[p] == highest[p[1]] for p in own), sum(every[p] for p in own)) for own in links]
    return sorted(((*x[:4], *s, x[4]) for x, s in zip(out, sums, strict=True)), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [
    "<|endoftext|> it's 12 ½ ² don't  two   spaces", "tab\tand\nlines \n next\r\n  nbsp 　wide  em", "▁ lower block ▁x", "<s> <0x41> </s> <unk>", "a\x00b\x0bc\x1c d\x85 e",
    "日本語 \U0001f600 \U0001f469‍\U0001f469 end", " leading and trailing  ", "x" * 5000, "word " * 3000, "é ́ ​﻿ bom", "'s 's 't i'LL 1234567 ...!!! ___a_", "    \x1d \x1e",
]


def test_alignment_of_odd_texts(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(token_alignment, "RUN_BYTES", 300)
    rows = [(i % 5, t) for i, t in enumerate(ODD)] + [(None, ODD[0]), (3, None), (4, ""), (0, ODD[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths = token_alignment.byte_vocabulary(), token_alignment.piece_model()
    got = token_alignment.alignments(docs, *paths)
    assert found(got) == aligned(rows)
    assert token_alignment.alignments(nothing, *paths).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(token_alignment.alignments(awkward, *paths)) == aligned(rows)


def test_alignment_of_given_documents(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 500)
    monkeypatch.setattr(token_alignment, "RUN_BYTES", 60_000)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common.salted_join, "__defaults__", (3, None))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(token_alignment.op13_token_alignment(spark, SF)) == aligned(rows)


W, N, P, FEW = fingerprints.WINDOW, fingerprints.NEIGHBOURS, fingerprints.POPULAR, fingerprints.FEWEST


def levels_of(raw):
    most = round(65536 * W * math.log2(W))
    sums = [sum(round(65536 * c * math.log2(c)) for c in Counter(raw[i : i + W]).values()) for i in range(len(raw) - W + 1)]
    return [(most - s) * (fingerprints.LEVELS - 1) // most for s in sums]


def features(raw, rank):
    """The chosen windows of a text, by looking at every neighbourhood."""
    raw = raw.ljust(W, b"\0") if raw else raw
    own = [int(rank[x]) for x in levels_of(raw)]
    reach = min(N, len(own))
    popular = Counter(min(range(i, i + reach), key=lambda j: (own[j], j)) for i in range(len(own) - reach + 1)) if own else {}
    found = [i for i in range(len(own)) if popular[i] >= P]
    if len(found) < FEW:
        found = sorted(sorted(range(len(own)), key=lambda i: (-popular[i], own[i], i))[:FEW])
    return list(dict.fromkeys(raw[i : i + W] for i in found))


def test_windows_are_those_of_a_naive_search():
    rng = random.Random(3)
    raws = [b"", b"a", b"\0" * 15, b"aaaaaaaaaaaaaaaaaaaaaaaaaaa", "É ñ 日本語 ".encode() * 9] + [bytes(rng.choice(b"abcd efgh") for _ in range(rng.randint(1, 900))) for _ in range(25)] + [rng.randbytes(5000)]
    filled = [r.ljust(W, b"\0") if r else r for r in raws]
    assert fingerprints.level_counts(raws).tolist() == [Counter(x for r in filled for x in levels_of(r))[level] for level in range(fingerprints.LEVELS)]
    rank = np.array(rng.sample(range(fingerprints.LEVELS), fingerprints.LEVELS))
    for raw, (counts, bits) in zip(raws, fingerprints.digests(raws, rank), strict=True):
        own = features(raw, rank)
        assert counts.tolist() == [len(own[i : i + fingerprints.FEATURES]) for i in range(0, len(own), fingerprints.FEATURES)]
        alone = fingerprints.digests([raw], rank)[0]
        assert (alone[0] == counts).all() and (alone[1] == bits).all()
        text = fingerprints.written((counts, bits))
        assert fingerprints.written(fingerprints.read(text)) == text
        for n, one in zip(counts.tolist(), bits, strict=True):
            assert 0 < np.unpackbits(one).sum() <= n * fingerprints.HASHES


def ring(spark, rows):
    """(doc_id, text) and the text after it, by descending id, nulls last, then the hash that the operator orders by."""
    df = spark.createDataFrame(sorted({(d, t or "") for d, t in rows}, key=repr), "doc_id long, text string")
    order = sorted(df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    return {(r.doc_id, r.text): s.text for r, s in zip(order, order[1:] + order[:1], strict=True)}


def fingerprinted(spark, rows, rank):
    following = ring(spark, rows)
    text_of = lambda t: fingerprints.written(fingerprints.digests([t.encode()], rank)[0])
    near = lambda a, b: fingerprints.likeness(fingerprints.read(a), fingerprints.read(b))
    out = []
    for d, t in rows:
        t = t or ""
        after, n = following[d, t], len(t) // 3
        new = t[: len(t) - n] + after[:n]
        own, changed = text_of(t), text_of(new)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), own, changed, near(own, changed), near(own, text_of(after))))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("size", [64_000_000, 3000])
def test_fingerprints_of_given_documents(spark, size, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rank = fingerprints.rarity(spark.read.parquet(f"{SF}/documents.parquet"))
    counts = fingerprints.level_counts([(t or "").encode() for _, t in rows])
    assert rank.tolist() == np.argsort(np.lexsort((np.arange(len(counts)), counts))).tolist()
    got = fingerprints.op12_document_fingerprints(spark, SF)
    assert got.columns == COLUMNS
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == fingerprinted(spark, rows, rank)
    long = [r for r in got if r[1] >= 300]
    assert min(r[5] for r in long) > 0.3 and np.median([r[6] for r in long]) < 0.02


def test_fingerprints_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    rank = np.arange(fingerprints.LEVELS)
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(7, "several"), (7, "texts of one id"), (5, "same"), (5, "same"), (5, "same"), (None, "two words"), (None, None), (-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprints(docs, rank)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=repr) == fingerprinted(spark, rows, rank)
    assert fingerprints.fingerprints(nothing).count() == 0 and fingerprints.fingerprints(nothing).columns == COLUMNS
    (one,) = fingerprints.fingerprints(spark.createDataFrame([(1, "a text alone, and its own next one")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.n_chars == 34


def test_equal_and_unrelated_texts(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000))
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000))
    rank = np.arange(fingerprints.LEVELS)
    a, b, c, part = fingerprints.digests([text.encode(), other.encode(), text.encode(), text[9000:].encode()], rank)
    assert len(a[0]) > 5 and fingerprints.likeness(a, c) == 1.0 and fingerprints.likeness(a, b) < 0.02 and fingerprints.likeness(a, part) > 0.4
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    empty = fingerprints.digests([b""], rank)[0]
    assert fingerprints.likeness(empty, empty) == 1.0 and fingerprints.likeness(empty, a) == 0.0
