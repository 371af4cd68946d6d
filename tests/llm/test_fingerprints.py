"""Fingerprints against sets of shingles, and neighbours against a sorted list."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from zeitton.llm import fingerprints as module
from zeitton.llm.fingerprints import as_text, containment, edited_and_next, fingerprinted, fingerprints, likeness, merged
from zeitton.llm.shingles import Powers, shingle_hashes


def all_hashes(text, words=5):
    hashes, places = shingle_hashes(pa.array([text], pa.string()), words, Powers())
    assert places[-1] == len(hashes)
    return np.unique(hashes)


def expected(text, share=8):
    hashes = all_hashes(text)
    low = hashes[hashes < np.uint64(2**64 // share)]
    return low if len(low) else hashes[:1]


def expected_rows(docs):
    """Id, text, edited text and both likenesses of each (id, text)."""
    order = sorted(((d is not None, d or 0), t or "") for d, t in docs)
    out = []
    for i, ((known, d), text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own = expected(text)
        out.append((d if known else None, text, edited, as_text(own), as_text(expected(edited)), likeness(own, expected(edited)), likeness(own, expected(after))))
    return out


def drawn(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéß") for _ in range(4)) for _ in range(300)]
    return [" ".join(draw.choice(words) for _ in range(draw.choice([1, 4, 5, 30, 400]))) for _ in range(n)]


@pytest.mark.parametrize("bytes_at_once", [2000, 8_000_000])
def test_edited_and_next(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(module, "BATCH_BYTES", bytes_at_once)
    texts = [*drawn(5, 60), None, "", " \n", "é", "same", "same", "wort " * 20000, "𝄞" * 7]
    docs = list(enumerate(texts, -5)) + [(None, "no id here")]
    random.Random(1).shuffle(docs)
    rows = documents(spark, docs).withColumnRenamed("lang", "part").withColumnRenamed("source", "edited").repartition(5)
    got = {r.doc_id: tuple(r) for r in edited_and_next(rows).collect()}
    want = {r[0]: r for r in expected_rows(docs)}
    assert got == want


def test_rows_of_equal_id_and_small_tables(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (None, "x"), (None, "x")]
    got = edited_and_next(documents(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.text, r.edited) for r in got) == [
        ("1", "a b c d", "a b c a"), ("1", "a b c d", "a b c x"), ("None", "x", "x"), ("None", "x", "x"),
    ]
    (one,) = edited_and_next(documents(spark, ["abcdefgh"])).collect()
    assert (one.edited, one.near_next) == ("abcdefab", 1.0)
    assert edited_and_next(documents(spark, ["a"]).limit(0)).collect() == []
    assert fingerprinted(documents(spark, ["a"]).limit(0)).collect() == []


def test_fingerprints_hold_all_low_hashes():
    texts = [*drawn(6, 80), "", " ", "one", "a b c d e"]
    for text, found in zip(texts, fingerprints(pa.array(texts), 5, 8, Powers()), strict=True):
        assert found.tolist() == expected(text).tolist()
    a, b = expected(texts[0]), expected(texts[1])
    union = np.union1d(all_hashes(texts[0]), all_hashes(texts[1]))
    assert merged(a, b).tolist() == (union[union < np.uint64(2**61)] if (union < np.uint64(2**61)).any() else union[:1]).tolist()


def test_containment_of_unequal_documents(spark):
    draw = random.Random(9)
    long = " ".join(f"w{draw.randint(0, 5000)}" for _ in range(20000))
    inside = " ".join(long.split(" ")[4000:6000])
    half = inside + " " + " ".join(f"v{draw.randint(0, 5000)}" for _ in range(2000))
    shown = {r.doc_id: r.fingerprint for r in fingerprinted(documents(spark, [long, inside, half, "", inside])).collect()}
    assert shown[1] == shown[4] and shown[3] == ""
    df = spark.createDataFrame([(shown[0], shown[1], shown[2], shown[3])], "long string, inside string, half string, none string")
    row = df.select(
        containment(F.col("inside"), F.col("long")).alias("whole"), containment(F.col("half"), F.col("long")).alias("part"),
        containment(F.col("long"), F.col("inside")).alias("tenth"), containment(F.col("none"), F.col("long")).alias("empty"),
    ).first()
    assert row.whole == 1 and abs(row.part - 0.5) < 0.07 and abs(row.tenth - 0.1) < 0.03 and row.empty == 1
