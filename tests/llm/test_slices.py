"""Batches cut by the bytes of their texts."""

from __future__ import annotations

import pyarrow as pa

from tidepool.llm import minhash_dedup
from tidepool.llm.common import by_bytes


def test_slices_hold_few_bytes_and_every_row():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "text": ["a" * 4, None, "é" * 3, "", "x" * 30, "y", "z" * 10]})
    assert [x.column("i").to_pylist() for x in by_bytes(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), limit=10)] == [[0, 1, 2, 3], [4], [5], [6], [2, 3], [4]]


def test_few_texts_become_python_strings_at_once(monkeypatch):
    seen, plain = [], minhash_dedup.folded_bytes
    monkeypatch.setattr(minhash_dedup, "folded_bytes", lambda texts: seen.append(sum(map(len, texts))) or plain(texts))
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": [f"w{i} " * 25_000 for i in range(40)]})
    out = [i for b in minhash_dedup._sketches(5)(iter([batch])) for i in b.column("id").to_pylist()]
    assert out == list(range(40)) and max(seen) <= 1 << 20
