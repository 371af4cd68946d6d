"""Suffix arrays against sorting, and repeated bytes against counting all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import documents
from zeitton.llm import suffix_dedup
from zeitton.llm.suffix_array import suffix_arrays


def test_suffix_arrays():
    draw = random.Random(3)
    for round_ in range(150):
        strings = [
            [draw.randint(1, draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 40))] + [0]
            for _ in range(draw.randint(1, 8))
        ]
        if round_ % 3 == 0:
            strings = [draw.choice([[1, 2, 1], [2, 1, 1, 2, 1], [1, 1, 2, 1]]) * draw.randint(1, 9) + [0] for _ in range(5)]
        cuts = np.cumsum([0] + [len(s) for s in strings])
        array = suffix_arrays(np.array(sum(strings, [])), cuts)
        for k, s in enumerate(strings):
            assert (array[cuts[k] : cuts[k + 1]] - cuts[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def expected(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        inner = gone[1:-1]
        spans = int((gone[1:] & ~gone[:-1]).sum())
        yield len(b), int(inner.sum()), spans, bytes(c for c, g in zip(b, inner, strict=True) if not g)


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), prose(150)
    near = []
    for _ in range(12):  # near copies, each with its own changes
        words = base.split(" ")
        for _ in range(3):
            words[draw.randrange(len(words))] = word()
        near.append(" ".join(words))
    return [
        None, "", "short", "short", "x" * 199, "y" * 200, "y" * 200, "z" * 450, "ab" * 300, prose(200),
        shared, prose(30) + shared + prose(30), prose(5) + shared[3:] + prose(40) + shared[:250], base, base, *near,
    ]


@pytest.mark.parametrize("most", [64, 2])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    texts = corpus()
    docs = documents(spark, texts).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "n_bytes")
    rows = suffix_dedup.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    found = {r[0]: (*r[1:4], bytes(r[4])) for r in rows}
    assert found == dict(enumerate(expected(texts)))
    assert sum(v[1] for v in found.values()) > 0


def test_repeated_rows_null_ids_and_text(spark):
    long = "é" + "".join(chr(97 + (i * i) % 23) for i in range(400))
    texts = [(1, long), (1, long), (None, "ö" + long[1:]), (None, None), (2, "tail " * 3)]
    rows = suffix_dedup.remove_repeats(documents(spark, texts), as_text=True).collect()
    raw = sorted((r.row.doc_id or 0, r.n_removed, r.kept) for r in rows)
    want = sorted((i or 0, w[1], w[3].decode("utf-8", "ignore")) for (i, _), w in zip(texts, expected([t for _, t in texts]), strict=True))
    assert raw == want
    assert suffix_dedup.remove_repeats(documents(spark, texts).limit(0)).collect() == []
