"""Near-duplicate, substring and line deduplication against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from tidepool.llm import common, line_dedup, minhash_dedup, near_dup, substring_dedup


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(sets, percent=80):
    """Components by all pairs; keys in order."""
    keys, parent = sorted(sets), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def near_copies(seed, n=60):
    """A text, copies of it with more and more words changed, chains of copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(i // 6):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text))
        if i % 10 == 9:
            base = text
    return out + [" ".join(word() for _ in range(50)) for _ in range(20)]


def test_near_duplicates_are_the_components(spark):
    texts = near_copies(1) + near_copies(2, 30)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = classes({i * 3: shingles(t, 4) for i, t in enumerate(texts)})
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minhash_dedup.near_duplicates(docs, 4).collect()}
    assert got == {k: (c, len(shingles(texts[k // 3], 4)), c == k) for k, c in want.items()}


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = classes({i: shingles(t, 4) for i, t in texts.items()})
    got = {r.doc_id: r.component_id for r in minhash_dedup.op3_minhash_near_dedup(spark, SF).collect()}
    assert got == want


def test_wide_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common.salted_join, "__defaults__", (3, None))
    rng = random.Random(31)
    template = [f"t{rng.randrange(10**6)}" for _ in range(88)]
    family = [" ".join([*template, *(f"f{i}x{rng.randrange(10**6)}" for _ in range(12 if i % 3 else 4))]) for i in range(40)]
    texts = near_copies(3) + family
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, 4).collect()}
    assert got == classes({i: shingles(t, 4) for i, t in enumerate(texts)})


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for common in (10, 200, 360):
        b = np.concatenate([a[:common], rng.integers(0, 2**63, 400 - common, dtype=np.uint64)])
        same = np.mean(near_dup.compressed(near_dup.registers_of(a, 512)) == near_dup.compressed(near_dup.registers_of(b, 512)))
        assert same == pytest.approx(common / (800 - common), abs=0.08)
    one = near_dup.registers_of(a[:1], 128)
    assert (one == near_dup.registers_of(a[:1], 128)).all() and len(one) == 128


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = minhash_dedup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.filter("doc_id is not null").count()
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[0, 0].kept and by[1, 0].component_id == 1 and not by[4, 1].kept and by[4, 1].component_id == 1
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_stage_keeps_one_row_of_each_group(spark, awkward, nothing):
    rng = random.Random(9)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (fill(100) for _ in range(5))
    rows = [
        (1, a, "x"), (5, a + " more", "x"), (None, a, "x"),  # copies of an earlier document
        (2, b, "z"), (2, b, "y"), (2, c, "x"),  # equal rows, and another text of their id
        (None, d, "x"), (None, d, "x"), (None, e, "x"),  # without an id, two of them equal
        (1, c + " more", "x"),  # an earlier copy under an id that is kept for another text
        (None, None, "x"), (None, "", "x"), (3, " ", "x"), (3, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = minhash_dedup.stage(spark, docs, SF)
    want = [(1, a, "x"), (2, b, "y"), (None, d, "x"), (None, e, "x"), (1, c + " more", "x"), *rows[-4:]]
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    out = minhash_dedup.stage(spark, awkward, SF)
    texts = [r.text for r in awkward.collect()]
    assert out.columns == awkward.columns and sorted(repr(r.text) for r in out.collect()) == sorted(map(repr, [*{t for t in texts if words(t)}, *(t for t in texts if not words(t))]))
    assert minhash_dedup.stage(spark, nothing, SF).count() == 0


def test_repeated_paragraphs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(70)]
    changed = [*passage[:30], "changed", *passage[31:]]
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{fill(80)}\n{' '.join(passage)}", f"{' '.join(changed)}\n{fill(60)}", fill(90), f"{fill(20)}\n{' '.join(passage).upper()}\n{fill(20)}", f"{' '.join(passage[:30])}\n{fill(60)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.start, r.length, r.first_doc_id, r.removed) for r in substring_dedup.repeated_paragraphs(docs).collect())
    at = texts[0].index("\n") + 1
    assert got == [(0, 1, at, len(texts[0]) - at, 0, False), (1, 0, 0, len(" ".join(changed)), 0, True), (3, 1, texts[3].index("\n") + 1, len(" ".join(passage)), 0, True)]
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert left[0] == texts[0] and left[2] == texts[2] and left[1].strip() == texts[1].split("\n")[1]
    assert left[3] == "\n\n".join(texts[3].split("\n")[::2])


def repeated_windows(texts, n):
    """Texts of which some n words in a row occur earlier, in another text or in their own."""
    seen, out = {}, set()
    for d, t in sorted(texts.items()):
        w = words(t)
        for i in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[i : i + n]), (d, i))
            if first != (d, i):
                out.add(d)
    return out


def test_passages_inside_other_paragraphs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(5))
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = {}
    for d in range(0, 60, 2):
        passage = fill(rng.choice([20, 51, 52, 60, 120]))
        for k in range(2):
            texts[d + k] = f"{fill(rng.randint(0, 90))} {passage if k else passage.upper()} {fill(rng.randint(0, 90))}\n{fill(10)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    removed_ = {r.doc_id for r in got if r.removed}
    assert repeated_windows(texts, 51) <= removed_ <= repeated_windows(texts, 32)
    for r in got:
        mine, first = (lower(texts[d]) for d in (r.doc_id, r.first_doc_id))
        assert mine[r.start : r.start + r.length] in first and r.removed == (r.doc_id % 2 == 1)


def words_seen_before(texts, n):
    """For each text the runs (begin, end) of words that lie in n words in a row which occur earlier."""
    seen, out = {}, {}
    for d, t in sorted(texts.items()):
        w, runs = words(t), []
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), (d, i)) != (d, i):
                if runs and i <= runs[-1][1] - n + 1:
                    runs[-1][1] = i + n
                else:
                    runs.append([i, i + n])
        out[d] = runs
    return out


@pytest.mark.parametrize("period", [1, 3, 6, 7, 19, 20, 23])
def test_text_that_repeats_itself_is_found_whole(spark, period):
    rng = random.Random(period)
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(7))
    fill = lambda n: [word() for _ in range(n)]
    line = fill(period)
    texts = {0: fill(30) + (line * 400)[:380] + fill(30), 1: fill(25) + (line * 400)[2:330] + fill(40), 2: fill(90)}
    texts = {d: " ".join(w) for d, w in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = {d: set() for d in texts}
    for r in substring_dedup.repeated_passages(docs).filter("removed").collect():
        at = len(words(texts[r.doc_id][: r.start]))
        gone[r.doc_id] |= set(range(at, at + len(words(texts[r.doc_id][r.start : r.start + r.length]))))
    sure, possible = words_seen_before(texts, 51), words_seen_before(texts, 32)
    assert len(sure[0]) == len(sure[1]) == 1 and not possible[2]
    for d in texts:
        assert {i for a, b in sure[d] for i in range(a + 19, b - 19)} <= gone[d] <= {i for a, b in possible[d] for i in range(a, b)}


def test_passages_of_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id for r in substring_dedup.op1_substring_dedup(spark, SF).filter("removed and kind = 'passage'").collect()}
    assert repeated_windows(texts, 51) <= got <= repeated_windows(texts, 32)


def paragraphs(text):
    """(first line, words) of long lines and of blocks of short ones."""

    def closes(line):
        hashes, bounds = common.word_hashes([line.encode().lower()], common.SPACED_WORDS)
        return bool(substring_dedup._closing(hashes, bounds)[0])

    out, block = [], []
    for n, line in enumerate([*(text or "").split("\n"), ""]):
        if block and not 0 < len(words(line)) < 50:
            out.append((block[0][0], " ".join(x for _, x in block)))
            block = []
        if len(words(line)) >= 50:
            out.append((n, line))
        elif words(line):
            block.append((n, line))
            if closes(line):
                out.append((block[0][0], " ".join(x for _, x in block)))
                block = []
    return [(n, p) for n, p in out if len(words(p)) >= 50]


def test_near_copies_of_short_lines_are_found(spark):
    rng = random.Random(15)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    lines = [fill(20) for _ in range(24)]
    changed = [f"{x} more" if i % 2 else x for i, x in enumerate(lines)]  # no 32 words in a row stay
    docs = spark.createDataFrame([(0, "\n".join([fill(9), *lines])), (1, "\n".join([*changed, fill(70)])), (2, fill(400))], "doc_id long, text string")
    got = substring_dedup.repeated_paragraphs(docs).collect()
    gone = [r for r in got if r.removed]
    assert gone and {r.doc_id for r in gone} == {1} and {r.first_doc_id for r in got} == {0}


def test_result_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (sorted(map(tuple, substring_dedup.repeats(d).collect()), key=repr) for d in (docs.coalesce(1), docs.orderBy(docs.doc_id % 7, docs.doc_id.desc()).repartition(13)))
    assert one == many and one


def test_repeated_paragraphs_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = {(r.doc_id, n): shingles(p, 5) for r in docs for n, p in paragraphs(r.text)}
    want = {k: c for k, c in classes(sets).items()}
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    got = {(r.doc_id, r.paragraph): (r.first_doc_id, r.first_paragraph) for r in substring_dedup.repeated_paragraphs(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {k: c for k, c in want.items() if sizes[c] > 1}


def test_repeated_paragraphs_of_awkward_rows(awkward, nothing):
    assert substring_dedup.repeated_paragraphs(awkward).filter("doc_id <> 7").count() == 0
    assert substring_dedup.repeated_paragraphs(nothing).count() == 0 and substring_dedup.repeated_passages(nothing).count() == 0
    assert {r.doc_id for r in substring_dedup.repeated_passages(awkward).collect()} <= {7}
    out = substring_dedup.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()


def removed(texts, fuzzy=8):
    """Lines that go, by comparing every line with all earlier ones."""
    lines = [(d, n, words(line)) for d, t in sorted(texts.items()) for n, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for d, n, w in lines:
        first.setdefault(tuple(w), (d, n))
    out = set()
    for d, n, w in lines:
        w = tuple(w)
        if first[w] < (d, n):
            out.add((d, n, *first[w], True))
            continue
        near = [at for v, at in first.items() if at < first[w] and v != w and min(len(v), len(w)) >= fuzzy and line_dedup.within_one_word([x.encode() for x in v], [x.encode() for x in w])]
        if near:
            out.add((d, n, *min(near), False))
    return out


@pytest.mark.parametrize("fuzzy", [8, 3, 1])
def test_removed_lines_against_brute_force(spark, fuzzy):
    rng = random.Random(11)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    texts = {}
    for d in range(60):
        lines = []
        for _ in range(5):
            w = rng.choice(base).split()
            change = rng.random()
            if change < 0.25:
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 3))
            elif change < 0.4:
                w.insert(rng.randrange(len(w) + 1), "more")
            elif change < 0.55:
                del w[rng.randrange(len(w))]
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        texts[d] = "\n".join(lines)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.line, r.first_doc_id, r.first_line, r.equal) for r in line_dedup.removed_lines(docs, fuzzy).collect()}
    assert got == removed(texts, fuzzy)


def test_edit_distance_of_one_word():
    split = lambda s: [x.encode() for x in s.split()]
    for a, b, near in [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("b c", "a b c", True), ("a b c", "a b", True), ("a b c", "c b a", False), ("a b", "b a", False), ("a b c d", "a b", False), ("a b c d", "b c d e", False), ("", "a", True)]:
        assert line_dedup.within_one_word(split(a), split(b)) is near


def test_long_words_and_texts_without_spaces_are_told_apart(spark):
    """Words whose blocks or distant bytes change places, and repeated patterns, must not be taken for equal."""
    x, cjk = "x" * 255, ["日本語" * 30 + chr(0x4E00 + i) for i in range(8)]
    turn = [0]
    while len(turn) < 2048:
        turn += [1 - t for t in turn]
    pattern = lambda flip: " ".join("ab"[t ^ flip] for t in turn)
    texts = {0: f"A{x}B", 1: f"B{x}A", 2: "".join(cjk), 3: "".join(reversed(cjk)), 4: pattern(0), 5: pattern(1), 6: "".join("ab"[t] for t in turn), 7: "".join("ab"[1 - t] for t in turn)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, 4).collect()} == classes({d: shingles(t, 4) for d, t in texts.items()})
    assert line_dedup.removed_lines(docs).count() == 0
    assert substring_dedup.repeats(docs.filter("doc_id not in (4, 5)")).count() == 0


def test_lines_of_awkward_rows(spark, awkward, nothing):
    assert line_dedup.removed_lines(nothing).count() == 0
    out = line_dedup.without_repeated_lines(awkward)
    assert out.columns == awkward.columns
    left = {(r.doc_id, r.text) for r in out.collect()}
    assert (0, None) in left and (1, "") in left and (9, "\n\n\nline\n\n") in left and (4, "one") not in left
    assert line_dedup.without_repeated_lines(nothing).count() == 0
