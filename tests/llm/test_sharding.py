"""Sharding: exact sizes, gapless slots, and counts that follow the hypergeometric law."""

from collections import defaultdict

import numpy as np

from tests.llm.helpers import documents
from zeitton.llm import sharding
from zeitton.llm.sharding import communication_matrix, hypergeometric, shard_rows


def test_matrix_sums_and_means():
    counts, sizes = [50, 0, 7, 143], [67, 67, 66]
    matrices = [communication_matrix(counts, sizes, seed) for seed in range(400)]
    assert all(m.sum(0).tolist() == sizes and m.sum(1).tolist() == counts for m in matrices)
    assert np.abs(np.mean(matrices, axis=0) - np.outer(counts, sizes) / 200).max() < 0.5


def test_large_populations_by_inversion(monkeypatch):
    draws = {}
    for bound in (10**9 - 1, 10):
        monkeypatch.setattr(sharding, "SAFE", bound)
        rng = np.random.default_rng(3)
        draws[bound] = np.array([hypergeometric(rng, 300, 700, 100) for _ in range(4000)])
    a, b = draws.values()
    assert abs(a.mean() - b.mean()) < 0.4 and abs(a.std() - b.std()) < 0.2
    assert 0 < hypergeometric(np.random.default_rng(1), 10**11, 10**12, 10**6) < 10**6


def test_rows_are_dealt_exactly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    texts = [*(f"text {i}" for i in range(500)), None, "", "same", "same"]
    docs = documents(spark, [*texts, (None, None), (1, "text 1")]).repartition(7).withColumnRenamed("lang", "shard").withColumnRenamed("source", "at")
    rows = shard_rows(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [31] * 6 + [32] * 10
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    ids = [r.doc_id or 0 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.15


def test_few_rows_and_empty_table(spark):
    docs = documents(spark, ["a", "b", "c"])
    assert sorted((r.shard, r.slot) for r in shard_rows(docs).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert shard_rows(docs.limit(0)).collect() == []
