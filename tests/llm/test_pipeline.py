"""The pipeline's stages against what each has to keep and drop of its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_dedup import classes, removed, shingles
from tests.llm.test_filters import judged
from tests.llm.test_search_and_shards import holds
from tidepool.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(where / name))
        out.append((docs, spark.read.parquet(str(where / name))))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert all(after.columns == COLUMNS for _, after in steps[:-1])


def test_toxic_documents_go_and_others_stay(spark, steps):
    before, after = map(texts, steps[0])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in clean) >= 0.97 * len(clean) and all(after[d] == before[d] for d in after)


def test_repeated_lines_go(steps):
    before, after = map(texts, steps[1])
    gone = {(d, n) for d, n, *_ in removed(before)}
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in before.items()}
    assert after == {d: t for d, t in want.items() if t.split() or not before[d].split()}


def test_one_of_each_group_stays(steps):
    before, after = map(texts, steps[2])
    want = classes({d: shingles(t, 5) for d, t in before.items()})
    assert set(after) == {d for d, c in want.items() if c == d}


def test_contaminated_documents_go(spark, steps):
    before, after = map(texts, steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = judged(before.items(), items)
    assert set(after) == {d for d, x in want.items() if not x[4]}


def test_all_is_packed(steps):
    from tokenizers import Tokenizer

    before, packed = steps[4]
    holds(packed.collect(), list(texts(before).items()), Tokenizer.from_file(packing._vocabulary()))


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, steps[-1][1].collect()))
