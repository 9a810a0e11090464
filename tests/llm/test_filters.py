"""Decontamination, toxicity, languages and personal data against brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidepool.llm import decontaminate, language_id, pii, toxicity

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def judged(texts, items, window=13):
    split = lambda t: re.findall(PLAIN, (t or "").encode().lower().decode())
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for doc, text in texts:
        w, names = split(text), set()
        hit = np.zeros(len(w), bool)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    names |= found
                    hit[i : i + n] = True
        n = int(hit.sum())
        out[doc] = (len(w), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out


def test_contamination_of_given_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = judged([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert {r[0]: tuple(r[1:]) for r in decontaminate.op4_benchmark_decontamination(spark, SF).collect()} == want


@pytest.mark.parametrize(("passes", "limit"), [(2_000_000, 2_000_000), (60, 60), (2_000_000, 20)])
def test_contamination_with_short_and_nested_items(spark, monkeypatch, passes, limit):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", passes)
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 3, 5, 8, 20]))) for i in range(3, 12)] + [(50, None), (None, "a b a"), (51, "a a a b b b a b")]
    texts = [(i, line(rng.randint(0, 40)) + rng.choice(["", " c ", "."]) + line(10)) for i in range(60)] + [(90, None), (91, ""), (92, "c " * 5000 + line(30))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in decontaminate.judged(docs, bench, 6).collect()}
    assert got == judged(texts, items, 6)


def test_decontaminated_keeps_clean_rows_as_they_are(spark, awkward, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontaminate.decontaminated(awkward, bench)
    assert out.columns == awkward.columns and sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert decontaminate.decontaminated(nothing, bench).count() == 0
    assert decontaminate.judged(awkward, bench.filter("false")).filter("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("size", [2_000_000, 4_000])
def test_long_matches_are_cut_from_documents_that_stay(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
    fill = lambda n, seed: " ".join(f"b日{random.Random(seed * 100_003 + i).randrange(10**9)}😀" for i in range(n))
    item, other = fill(300, 1), fill(80, 2)
    part = lambda a, b: " ".join(item.split(" ")[a:b])
    a, b, c = fill(12_000, 3), fill(8_000, 4), fill(3_000, 5)
    texts = {
        0: (f"{a} {item.upper()}, {b}", f"{a} , {b}"), 1: (f"{part(10, 60)} {a} {other}\n{b} {part(0, 70)}", f" {a} \n{b} "), 2: (f"{a} {part(5, 54)} {b}",) * 2,
        3: (f"{c} {item}", None), 4: (c, c), 5: (None, None), 6: ("", ""),
    }
    docs = spark.createDataFrame([(d, t[0], 1) for d, t in texts.items()], "doc_id long, text string, n long")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, limit=50).collect()}
    assert got == {d: t[1] for d, t in texts.items() if d != 3}
    assert {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench).collect()} == {d: t[0] for d, t in texts.items() if d != 3}


def test_toxicity_on_the_held_out_fold(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_learns_and_folds(spark):
    clean = [(i, f"ordinary words number {i}") for i in range(200)]
    bad = [(i, f"ordinary vilething words number {i}") for i in range(200, 300)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300)] + [(5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = spark.createDataFrame([(1, "such a V1l3th1ng"), (2, "such a ѵilething vіlethіng"), (3, "a fine thing"), (4, None), (5, "")], "doc_id long, text string")
    score = {r.doc_id: r["toxicity"] for r in toxicity.scored(tests, model).collect()}
    assert score[1] > 0.5 and score[3] < 0.5 and score[3] == score[4] == score[5]


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({" vile": 3.0}, frozenset({"not vile"}))
    found = lexicon.automaton()
    assert toxicity.features(toxicity.folded("it is vile"), found)[2] == 3.0
    assert toxicity.features(toxicity.folded("it is not vile at all"), found)[2] == 0.0


def naive_matches(text, lexicon):
    """By every place where a word begins: its longest entry, if no phrase that holds the word is there."""
    out = {}
    for i, c in enumerate(text):
        own = [e for e in lexicon.entries if c == " " and text.startswith(e, i)]
        inside = any(text.startswith(f" {p} ", j) and j <= i < j + len(p) + 1 for p in lexicon.exceptions for j in range(i + 1))
        if own and not inside:
            out[i] = lexicon.entries[max(own, key=len)]
    return out


def test_matches_equal_a_naive_search():
    rng = random.Random(12)
    lexicon = toxicity.Lexicon({" vile": 3.0, " vile ": 5.0, " nasty ": 2.0, " na": 1.0, " n": 0.5}, frozenset({"not vile", "so so", "nasty nasty"}))
    found = lexicon.automaton()
    for _ in range(2000):
        text = toxicity.folded(" ".join(rng.choice(["vile", "nasty", "not", "so", "villa", "vilest", "n", "nap", ""]) for _ in range(rng.randint(0, 9))))
        assert toxicity.matches(text, found) == naive_matches(text, lexicon), text
    assert sum(toxicity.matches(toxicity.folded("vile nasty vile nasty"), found).values()) == 14.0
    assert sum(toxicity.matches(toxicity.folded("not vile nasty"), found).values()) == 2.0
    assert toxicity.folded("𝐯𝐢𝐥𝐞 ｎａｓｔｙ") == " vile nasty "


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    out = toxicity.scored(awkward, model)
    assert out.count() == awkward.count() and out.filter("toxicity >= 0.5").count() == 0
    assert toxicity.scored(nothing, model).count() == 0 and toxicity.fit(nothing, labels).entries == {}


def test_languages_on_the_held_out_fold(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.op9_language_id(spark, sf).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_network_gradients_and_inference():
    rng = np.random.default_rng(0)
    net = language_id.Network.random(["a", "b", "c"], 3)
    windows, labels = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 5)
    loss, grads = language_id._gradients(net, windows, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            old = p[at]
            if p.shape[0] == 256:
                at = (int(windows[0, 0]), at[1])
                old = p[at]
            p[at] = old + 1e-2
            up = language_id._gradients(net, windows, labels)[0]
            p[at] = old - 1e-2
            down = language_id._gradients(net, windows, labels)[0]
            p[at] = old
            assert (up - down) / 2e-2 == pytest.approx(float(g[at]), abs=2e-3)
    texts = [bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (1, 63, 64, 65, 200)]
    together = net.probabilities(texts)
    for i, t in enumerate(texts):
        assert together[i] == pytest.approx(net.probabilities([t])[0], abs=1e-5)
    assert len(net.label_positions("é" * 40)) == 80


def test_languages_of_awkward_rows(spark, awkward, nothing):
    net = language_id.train(np.tile(np.arange(64, dtype=np.uint8), (4, 1)) + 60, np.array([0, 1, 0, 1]), ["de", "en"], steps=2)
    assert [language_id.has_letter(t) for t in (None, "", "12 ²½", "1a", "é", "日")] == [False, False, False, True, True, True]
    rows = {(r.doc_id, r.text): r for r in language_id.predicted(awkward, net).collect()}
    assert rows[0, None]["lang_pred"] == rows[1, ""]["lang_pred"] == "und" and rows[3, "one"]["lang_pred"] in ("de", "en")
    assert language_id.predicted(nothing, net).count() == 0 and language_id.fit(nothing) is None
    assert language_id.predicted(awkward, None).filter(F.col("lang_pred") != "und").count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_patterns_on_random_strings():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["@", ".", "a", "-", " ", "+", "1", "25", "4111 1111 1111 1111", "10.0.0.1", "(", "٣", "é", "x.y", "+1 555 123-4567"]) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == base(text), text


def test_personal_data_of_given_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op10_pii(spark, SF).collect():
        want = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)
        assert set(joined.split(",")) <= {*r.spans.split(","), ""}


@pytest.fixture(scope="module")
def field():
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "of", "call", "12", "in 2024", "jane.d@mail.example.org", "+1 (434) 555-2368", "10.20.30.40", "4111 1111 1111 1111"]) for _ in range(12))
    return pii.train([text() for _ in range(150)])


def test_field_finds_boundaries_and_types(field):
    for text, kind, want in [("call +1 (434) 555-2368 now", "phone", "+1 (434) 555-2368"), ("host 10.20.30.40 is up", "ip", "10.20.30.40"), ("to jo.e@mail.example.org, please", "email", "jo.e@mail.example.org"), ("call +1 (434) 555-2368 190.1.2.3 now", "phone", "+1 (434) 555-2368")]:
        spans = pii.spans_of(text, field)[1]
        assert any(k == kind and text[a:b] == want for k, a, b in spans), (text, spans)
    assert pii.spans_of("nothing in 2024, chapter 12", field)[1] == []


def planted(seed, n=300):
    """Texts with writings that the base patterns miss, and ordinary ones with digits; the spans of the former."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(["river", "tomorrow", "they", "of", "green", "said", "in"])
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n - 2)) + "a7"

    def luhn():
        while not pii.luhn(x := "4" + digits(15)):
            pass
        return ".".join(x[i : i + 4] for i in range(0, 16, 4))

    out = []
    for i in range(n):
        kind, new = [
            ("phone", f"({digits(3)}) 555-{digits(4)}"), ("phone", f"{digits(3)}-555-{digits(4)}"), ("card", luhn()), ("secret", run("0123456789abcdef", 32)), ("secret", run("ABCDEFGHJK0123456789", 20)),
            (None, f"{1900 + i % 100}"), (None, rng.choice(["windows98", "chapter12a", "room204"])), (None, f"{digits(2)}.{digits(2)} per cent"),
        ][i % 8]
        before = " ".join(word() for _ in range(6)) + (rng.choice([" pwd=", " secret: ", ' api_token = "']) if kind == "secret" else " ")
        out.append((before + new + " " + " ".join(word() for _ in range(6)), (kind, len(before), len(before) + len(new)) if kind else None))
    return out


def test_field_finds_writings_that_the_patterns_miss(spark):
    """Trained as in the query, on given documents only: recall and precision on planted writings."""
    model = pii.fit(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    hits = wrong = total = 0
    for text, want in planted(3):
        base_, every = pii.spans_of(text, model)
        added = [s for s in every if s not in base_]
        total += want is not None
        hits += want in every
        wrong += sum(s != want for s in added)
    print("recall", hits / total, "precision", hits / (hits + wrong))
    assert hits / total > 0.9 and hits / (hits + wrong) > 0.9


def test_best_segmentation_is_the_best_of_all(field):
    text = "x 10.0.0.1 a@b.c y"
    r = pii.Region.of(text, 0, len(text))
    scores = r.x @ field.spans
    outside = r.plain @ field.outside

    def best(i, label):
        if i == len(r.tokens):
            return 0.0
        ways = [field.moves[label, 0] + outside[i] + best(i + 1, 0)]
        for c, (a, b) in enumerate(r.candidates):
            if a == i:
                ways += [field.moves[label, k + 1] + scores[c, k] + best(b, k + 1) for k in range(len(pii.LABELS))]
        return max(ways)

    total = at = label = 0
    for i, j, k in [*field.best(r), (len(r.tokens), len(r.tokens), -1)]:
        while at < i:
            total += field.moves[label, 0] + outside[at]
            at, label = at + 1, 0
        if k >= 0:
            total += field.moves[label, k + 1] + scores[r.candidates.index((i, j)), k]
            at, label = j, k + 1
    assert total == pytest.approx(best(0, 0))


def test_personal_data_of_awkward_rows(awkward, nothing, field):
    out = pii.found(awkward, field)
    assert out.count() == awkward.count() and out.filter("found.n_card > 0 or found.n_email > 0 or found.n_secret > 0").count() == 0
    assert pii.found(nothing, field).count() == 0 and pii.fit(nothing).spans.sum() == 0
    masked = pii.masked(awkward, field)
    assert masked.columns == awkward.columns and masked.filter("text is null").count() == awkward.filter("text is null").count()
