"""Different texts under one doc_id, equal rows, and ids beside nulls, against brute force."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_dedup import classes, removed, shingles, words
from tidepool.llm import line_dedup, minhash_dedup, substring_dedup, topk, toxicity


def prose(seed):
    rng = random.Random(seed)
    return lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def changed(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def test_every_text_of_an_id_is_linked(spark):
    fill = prose(41)
    a, b, c = fill(90), fill(90), fill(90)
    rows = [(1, a), (1, b), (2, changed(b, 40)), (3, changed(a, 7)), (4, c), (4, c), (5, changed(c, 60)), (6, fill(60)), (6, None), (6, "")]
    want = classes({(d, i): shingles(t, 4) for i, (d, t) in enumerate(rows)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == sorted((d, len(shingles(t, 4)), want[d, i][0], want[d, i][0] == d) for i, (d, t) in enumerate(rows))
    assert (2, 87, 1, False) in got and (3, 87, 1, False) in got


def test_every_text_of_an_id_is_searched_for_passages(spark):
    fill = prose(42)
    a, b, c = fill(80), fill(80), fill(80)
    rows = [(1, a), (1, b), (2, changed(b, 30)), (3, changed(a, 50)), (4, c), (4, c), (5, fill(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.first_doc_id, r.removed) for r in substring_dedup.repeated_paragraphs(docs).collect())
    assert got == [(1, 1, False), (1, 1, False), (2, 1, True), (3, 1, True)]
    texts = sorted((r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert texts == sorted([(1, a), (1, b), (2, ""), (3, ""), (4, c), (4, c), rows[-1]])
    inside = spark.createDataFrame([(1, f"{fill(9)} {a} {fill(9)}"), (1, f"{fill(9)} {b} {fill(9)}"), (1, f"{fill(9)} {b} {fill(9)}"), (2, f"{fill(30)} {b}"), (3, c), (3, c)], "doc_id long, text string")
    found = [(r.doc_id, r.first_doc_id, r.removed) for r in substring_dedup.repeated_passages(inside).collect()]
    assert {d for d, _, gone in found if gone} == {1, 2} and not [d for d, *_ in found if d == 3]


def test_lines_of_every_text_of_an_id(spark):
    fill = prose(43)
    lines = [fill(9) for _ in range(12)]
    rows = [
        (1, "\n".join([lines[0], lines[1], "once only"])), (1, "\n".join([lines[0], lines[2], "another line"])),
        (1, "\n".join([lines[0], lines[2], "another line"])), (2, "\n".join([changed(lines[1], 3), lines[3]])),
        (5, "\n".join([changed(lines[2], 4), lines[3], lines[4]])), (6, lines[4]), (6, lines[5]), (7, None), (7, lines[5]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {(r.doc_id, r.text): r.own for r in line_dedup.own_texts(docs).collect()}
    single = list(dict.fromkeys(rows))
    found = line_dedup.removed_lines(docs).collect()
    want = removed({(d, own[d, t]): t for d, t in single})
    assert {((r.doc_id, r.own), r.line, r.first_doc_id, r.first_line, r.equal) for r in found} == {(d, n, f[0], m, e) for d, n, f, m, e in want}
    gone = {(d, n) for d, n, *_ in want}
    left = ["\n".join(x for n, x in enumerate(t.split("\n")) if ((d, own[d, t]), n) not in gone) if t else t for d, t in rows]
    kept = sorted(((d, x) for (d, t), x in zip(rows, left, strict=True) if not t or words(x)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs).collect()), key=repr) == kept
    assert "once only" in "".join(x or "" for _, x in kept) and "another line" in "".join(x or "" for _, x in kept)


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 2**53 + 1
    rows = [(big, [1.0, 2.0]), (None, [5.0, 5.0]), (50, [1.0, 1.0]), (big + 2, [0.5, 1.0]), (100, None), (150, [1.0, float("nan")]), (200, [3.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0 or vec_id is null")).collect()}
    assert got == {(50, 1, big), (50, 2, big + 2)}


@pytest.mark.parametrize("before", ["", "word " * 3, "word " * 7, "word " * 30, "w" * 39 + " ", "w" * 60 + " "])
def test_exception_phrases_wherever_they_stand(before):
    import pyarrow as pa

    lexicon = toxicity.Lexicon({" vile": 3.0})
    batch = pa.RecordBatch.from_pydict({"text": [f"{before}not vile at all", f"vile {before}", f"{before}{'u' * 45} vile"], "toxic": [0, 1, 0]})
    (out,) = toxicity._phrases(lexicon)(iter([batch]))
    got = {(r["phrase"], r["toxic"], r["clean"]) for r in out.to_pylist()}
    assert got == {("not vile", 0, 1)}
