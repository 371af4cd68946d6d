"""Chunk scores, their combination into one class per text, and the lexicon scorer."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, functions as F

from zeitton.functions.text import bind
from zeitton.schemas import CHUNK_SCORE, CLASSES, PROBABILITIES

LETTERS = r"\p{L}++"


def no_score() -> Column:
    """Result for blank text and for failed scoring: neutral with three zeros."""
    zeros = F.struct(*(F.lit(0.0).alias(c) for c in CLASSES))
    return F.struct(F.lit("neutral").alias("category"), zeros.alias("score"))


def strongest(score: Column) -> Column:
    """Class with the highest probability; ties go to the class named first."""
    pos, neg, neu = (score[c] for c in CLASSES)
    return F.when((pos >= neg) & (pos >= neu), "positive").when(neg >= neu, "negative").otherwise("neutral")


def normalised(score: Column) -> Column:
    """Probabilities scaled to sum to one; left alone when they sum to zero."""
    total = reduce(lambda a, b: a + b, (score[c] for c in CLASSES))
    return F.struct(*(F.when(total > 0, score[c] / total).otherwise(score[c]).alias(c) for c in CLASSES))


def mean_score(scores: Column) -> Column:
    """Mean probability per class over an array of chunk scores."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in CLASSES))
    add = lambda acc, s: F.struct(*((acc[c] + s[c]).alias(c) for c in CLASSES))
    count = F.size(scores)
    mean = lambda acc: F.struct(*((acc[c] / count).alias(c) for c in CLASSES))
    return F.aggregate(scores, zero, add, mean)


def combine(scores: Column) -> Column:
    """One ``(category, score)`` per text from the scores of its chunks.

    One chunk keeps the scorer's class and probabilities; several are averaged and rescaled to sum
    to one. A chunk without a usable score, like a text without chunks, gives ``no_score()``.
    """
    usable = F.forall(
        scores,
        lambda s: s.isNotNull() & s["label"].isin(*CLASSES) & reduce(
            lambda a, b: a & b, (s[c].isNotNull() for c in CLASSES)
        ),
    )
    first = F.get(scores, 0)
    single = F.struct(
        first["label"].alias("category"), F.struct(*(first[c].alias(c) for c in CLASSES)).alias("score")
    )
    several = bind(
        bind(mean_score(scores), normalised),
        lambda s: F.struct(strongest(s).alias("category"), s.cast(PROBABILITIES).alias("score")),
    )
    return (
        F.when(scores.isNull() | (F.size(scores) == 0) | ~usable, no_score())
        .when(F.size(scores) == 1, single)
        .otherwise(several)
    )


def letter_runs(text: Column) -> Column:
    """Lower-case runs of letters, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def lexicon_score(chunk: Column, positive: Collection[str], negative: Collection[str]) -> Column:
    """Share of positive, negative and remaining words; the strongest of them is the label.

    Words are runs of letters; a chunk without any is neutral.

    Membership is a hash-set test, so the size of the lexicon does not change the cost per word.
    """

    def hits(found: Column) -> Column:
        return F.struct(
            F.size(F.filter(found, lambda w: w.isin(*positive))).alias("positive"),
            F.size(F.filter(found, lambda w: w.isin(*negative))).alias("negative"),
            F.greatest(F.size(found), F.lit(1)).alias("total"),
        )

    def shares(n: Column) -> Column:
        return F.struct(
            (n["positive"] / n["total"]).alias("positive"),
            (n["negative"] / n["total"]).alias("negative"),
            ((n["total"] - n["positive"] - n["negative"]) / n["total"]).alias("neutral"),
        )

    return bind(
        bind(bind(letter_runs(chunk), hits), shares),
        lambda s: F.struct(strongest(s).alias("label"), *(s[c].alias(c) for c in CLASSES)).cast(CHUNK_SCORE),
    )


def score_json(score: Column) -> Column:
    return F.to_json(score)
