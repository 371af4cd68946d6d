"""Periodic runs against a search over all periods."""

import random
import zlib

import pytest

from tests.llm.helpers import documents
from zeitton.llm import periodic_runs as module
from zeitton.llm.periodic_runs import periodic_runs, z_function


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def expected(words, least=6, exponent=4):
    """All (start, period, length), and the words that stay."""
    n, found = len(words), {}
    for q in range(n // exponent, 0, -1):
        begin = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i - begin + q >= max(least, exponent * q):
                    found[begin, i - begin + q] = q
                begin = i + 1
    gone = {i for (s, n), q in found.items() for i in range(s + q, s + n)}
    return sorted((s, q, n) for (s, n), q in found.items()), " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(seed, many, longest):
    draw = random.Random(seed)
    for _ in range(many):
        words = []
        while len(words) < draw.randint(1, longest):
            phrase = [draw.choice("abcdefgh") for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 13, 30, 64]))]
            words += phrase * draw.choice([1, 1, 2, 4, 5, 9]) + phrase[: draw.randint(0, len(phrase))]
        yield draw.choice([" ", "\n", " \t"]).join(words)


ODD = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x y " * 7, "wort " * 3000, "a b " * 500 + "c " + "a b " * 500, "same same", "same same"]


def check(spark, texts):
    docs = documents(spark, [*texts, (None, "n n n n n n n")]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "h1")
    rows = periodic_runs(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = words_of("n n n n n n n" if r.doc_id is None else texts[r.doc_id])
        runs, rest = expected(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), runs, rest), r.doc_id


def test_runs_of_short_texts(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH_BYTES", 3000)
    check(spark, [*ODD, *drawn(1, 150, 300)])
    assert periodic_runs(documents(spark, ["a"]).limit(0)).collect() == []


def test_runs_of_long_texts_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(module, "LONG_BYTES", 40)
    monkeypatch.setattr(module, "CORE", 64)
    check(spark, [*ODD, *drawn(2, 60, 900)])


def test_rows_of_equal_id(spark):
    docs = documents(spark, [(1, "a " * 9), (1, "a " * 9), (1, "b c"), (None, "a " * 9), (None, "b c")])
    got = sorted((str(r.doc_id), r.collapsed, len(r.runs)) for r in periodic_runs(docs).collect())
    assert got == [("1", "a", 1), ("1", "a", 1), ("1", "b c", 0), ("None", "a", 1), ("None", "b c", 0)]


def test_z_function():
    draw = random.Random(3)
    for _ in range(200):
        v = [draw.randint(0, 1) for _ in range(draw.randint(1, 40))]
        for i, k in enumerate(z_function(v)):
            assert i == 0 or v[i : i + k] == v[:k] and (i + k == len(v) or v[i + k] != v[k])


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(documents(spark, ["a"]), min_exponent=3)


def planted(doc_id, words):
    """The contract's edit: from some word on, the text repeats its words there."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
