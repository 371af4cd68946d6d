import functools
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zeitton.functions import sentiment
from zeitton.operators.scoring import (
    LexiconScorer,
    ModelScorer,
    category_counts,
    chunk_scores,
    merged_counts,
    score_fields,
    score_once,
)
from zeitton.plans.inputs import WordModel
from zeitton.schemas import CLASSES, FIELDS
from tests.test_text import chunk_twin

ZEROS = {c: 0.0 for c in CLASSES}


class Model:
    """Scores depend on the text; some texts break it."""

    def predict_sentiment(self, texts, output_probabilities=True):
        labels, rows = [], []
        for text in texts:
            if "boom" in text:
                raise RuntimeError(text)
            n = len(text)
            pos, neg = (n % 7) / 10, (n % 3) / 10
            label = "weird" if text.startswith("odd") else ("positive" if pos > neg else "negative")
            labels.append(label)
            rows.append([["negative", neg], ["positive", pos], ["neutral", 1 - pos - neg]])
        return labels, rows


class ZeroModel:
    def predict_sentiment(self, texts, output_probabilities=True):
        return ["negative"] * len(texts), [[[c, 0.0] for c in CLASSES]] * len(texts)


def expected(text, model):
    """Expected class and probabilities of one text, from a matrix of chunk probabilities."""
    neutral = ("neutral", dict(ZEROS))
    labels, matrix = [], []
    for chunk in chunk_twin(text):
        if "boom" in chunk:
            return neutral
        (label,), (pairs,) = model.predict_sentiment([chunk])
        labels.append(label)
        matrix.append([dict(pairs)[c] for c in CLASSES])
    if not labels or set(labels) - set(CLASSES):
        return neutral
    means = np.mean(matrix, axis=0)
    if len(labels) > 1:
        means = means / means.sum() if means.sum() else means
        labels = [CLASSES[int(np.argmax(means))]]
    return labels[0], dict(zip(CLASSES, means))


LONG = " ".join(f"wort{i}" for i in range(450))
TEXTS = [None, "", "  ", "ein Wort", "odd text", "boom", LONG, LONG + " boom", "x " * 200, "y " * 201]


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_model_scorer_equals_twin(spark, batch):
    rows = [(i, a, TEXTS[-i]) for i, a in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, headline string, articleBody string").repartition(2)
    out = score_fields(df, ModelScorer(Model, batch))
    for row in out.collect():
        for field in ("headline", "articleBody"):
            label, probabilities = expected(row[field], Model())
            assert row[f"{field}_sentiment_category"] == label
            assert json.loads(row[f"{field}_sentiment_score"]) == pytest.approx(probabilities)
        assert row.short_text_sentiment_category == "neutral"
        assert json.loads(row.short_text_sentiment_score) == ZEROS


def test_all_zero_chunks_are_positive(spark):
    df = spark.createDataFrame([(LONG,), ("kurz",)], "text string")
    got = [r.text_sentiment_category for r in score_fields(df, ModelScorer(ZeroModel), ["text"]).collect()]
    assert got == ["positive", "negative"]


def test_lexicon(spark):
    df = spark.createDataFrame([("Gut, GUT! schlecht 12",), ("...",), ("gut schlecht",)], "text string")
    scorer = LexiconScorer(["gut"], ["schlecht"])
    out = score_fields(df, scorer, ["text"], typed=True).collect()
    assert [r.text_sentiment_category for r in out] == ["positive", "neutral", "positive"]
    assert tuple(out[0].text_sentiment_score) == pytest.approx((2 / 3, 1 / 3, 0.0))
    assert tuple(out[1].text_sentiment_score) == (0.0, 0.0, 1.0)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t and t.strip()], "text string")
    for row in score_fields(df, LexiconScorer(), ["text"], typed=True).collect():
        assert sum(row.text_sentiment_score) == pytest.approx(1.0)


def test_chunk_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = chunk_scores(df, "i", "text", LexiconScorer()).collect()
    assert sorted((r.i, r.chunk_no, r.chunk) for r in rows) == sorted(
        (i, n, c) for i, t in enumerate(TEXTS) for n, c in enumerate(chunk_twin(t))
    )


def test_strongest_ties(spark):
    rows = [(0.4, 0.4, 0.2, "positive"), (0.2, 0.4, 0.4, "negative"), (0.0, 0.0, 0.0, "positive"), (0.1, 0.2, 0.7, "neutral")]
    df = spark.createDataFrame(rows, "positive double, negative double, neutral double, want string")
    for row in df.select("want", sentiment.strongest(F.struct(*CLASSES)).alias("got")).collect():
        assert row.got == row.want


def test_counts(spark):
    names = [f"{f}_sentiment_category" for f in FIELDS]
    old = spark.createDataFrame([("positive", "weird", "neutral", None)], names and ", ".join(f"{n} string" for n in names))
    new = spark.createDataFrame([("positive", "weird", "negative", None)], old.schema)
    got = {(r.field, r.category): r.n for r in category_counts(new).collect()}
    assert got == {("headline", "positive"): 1, ("short_headline", "neutral"): 1, ("short_text", "negative"): 1, ("articleBody", "neutral"): 1}
    both = {(r.field, r.category): r.n for r in merged_counts(old, new).collect()}
    assert both == {
        ("headline", "positive"): 2, ("short_headline", "neutral"): 1, ("short_text", "neutral"): 1,
        ("short_text", "negative"): 1, ("articleBody", "neutral"): 1,
    }


class CountingModel(WordModel):
    """Writes down every text it is given, one file per task."""

    def __init__(self, folder):
        super().__init__(("gut",), ("schlecht",))
        self.folder = folder

    def predict_sentiment(self, texts, output_probabilities=True):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as file:
            file.write("\0".join(texts))
        if "broken" in texts:
            raise ValueError("broken")
        return super().predict_sentiment(texts, output_probabilities)


def test_every_chunk_is_scored_once_over_runs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    scorer = ModelScorer(functools.partial(CountingModel, str(seen)))
    rows = [(i, ["gut", "schlecht", "gut gut", None, " ", "same " * 250, "broken"][i % 7], "same " * 200) for i in range(40)]
    rows += [(100 + i, f"gut {i}" if i % 2 else None, f"schlecht {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, headline string, articleBody string").repartition(3)
    store, fields = f"{tmp_path}/store", ("headline", "short_text", "articleBody")
    first = score_once(df.where("doc_id < 20"), scorer, store, fields)
    second = score_once(df.where("doc_id >= 20"), scorer, store, fields)
    got = first.unionByName(second).collect()
    want = score_fields(df, ModelScorer(functools.partial(CountingModel, str(tmp_path))), fields).collect()
    names = [f"{f}_sentiment_{k}" for f in fields for k in ("category", "score")]
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in got) == sorted((r.doc_id, *(r[n] for n in names)) for r in want)
    texts = Counter(t for file in seen.iterdir() for t in file.read_text().split("\0"))
    whole = [t for t in texts if t != "broken"]
    # A batch that holds a broken text is tried again text by text, in the run that met it.
    assert len(whole) == 6 + 9 and all(texts[t] <= 2 for t in whole)
    seen_before = sum(texts.values())
    score_once(df.where("headline is null or headline <> 'broken'"), scorer, store, fields).collect()
    assert sum(Counter(t for file in seen.iterdir() for t in file.read_text().split("\0")).values()) == seen_before
