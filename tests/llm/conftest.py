from __future__ import annotations

import pytest

#: Texts that every operator has to stand: null, empty, blank, short, repeated, non-ASCII, and a very long one.
AWKWARD = [None, "", "  \n\t ", "one", "one", "É ñ ß 日本語 😀", "a b c d e f g h i j k l m n o p", "word " * 60_000, "x" * 200_000, "\n\n\nline\n\nline\n", "<|endoftext|> it's 12 ½ ²", "a\x00b\x0bc\x1cd e f"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts with repeated doc_ids, nulls in every column, and columns that clash with internal names."""
    rows = [(i, t, None if i % 3 else "en", None, None, i, *"xxxxxxxx") for i, t in enumerate(AWKWARD)]
    rows += [(1, "one", "en", "s", 3, 1, *"xxxxxxxx"), (1, "one", "en", "s", 3, 1, *"xxxxxxxx")]
    rows += [(None, None, None, None, None, None, *[None] * 8), (None, "two words", "en", None, None, None, *[None] * 8)]
    clashing = "shard string, gone string, key string, row string, contamination string, salt string, edges string, a string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, n long, {clashing}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
