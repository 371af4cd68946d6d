import random

import pytest
from pyspark.sql import functions as F

from zeitton.functions import text as words


def chunk_twin(text, size=200):
    """Expected chunks: numbered words grouped by their number."""
    found = (text or "").split()
    groups = {}
    for number, word in enumerate(found):
        groups.setdefault(number // size, []).append(word)
    joined = [" ".join(group) for group in groups.values()]
    return [text] if len(joined) == 1 else joined


SPACES = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "   "]


def samples():
    rng = random.Random(1)
    texts = [None, "", " ", "\t\n", "\xa0 ", "wort", " wort "]
    for n in (1, 199, 200, 201, 400, 401, 1000):
        texts.append(" ".join(f"w{i}" for i in range(n)))
        texts.append(rng.choice(SPACES) + "".join(f"ä{i}" + rng.choice(SPACES) for i in range(n)))
    return texts


def test_chunks_equal_twin(spark):
    df = spark.createDataFrame(list(enumerate(samples())), "i int, t string")
    for size in (200, 3, 1):
        for row in df.select("t", words.chunks(F.col("t"), size).alias("c")).collect():
            assert row.c == chunk_twin(row.t, size)


def test_words_and_blank(spark):
    df = spark.createDataFrame([(t,) for t in samples()], "t string")
    t = F.col("t")
    for row in df.select("t", words.words(t).alias("w"), words.has_text(t).alias("h"), words.strip(t).alias("s")).collect():
        assert row.h == bool(row.t and row.t.strip())
        if row.t is not None:
            assert row.w == row.t.split()
            assert row.s == row.t.strip()


@pytest.mark.parametrize("size", [200, 7])
def test_chunks_keep_all_words(spark, size):
    df = spark.createDataFrame([(t,) for t in samples() if t], "t string")
    for row in df.select("t", words.chunks(F.col("t"), size).alias("c")).collect():
        assert [w for c in row.c for w in c.split()] == row.t.split()
        assert all(len(c.split()) <= size for c in row.c)
