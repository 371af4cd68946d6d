"""Polarity = positive probability minus negative probability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from zeitton.functions.text import bind

NUMERIC = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"


def _part(score: Column, key: str) -> Column:
    """Number under ``key``: 0 when the key is missing, null when it holds null or a non-number."""
    value = F.try_variant_get(score, f"$.{key}", "variant")
    number = F.when(
        F.schema_of_variant(value).rlike(NUMERIC), F.try_variant_get(score, f"$.{key}", "double")
    )
    return F.when(value.isNull(), F.lit(0.0)).otherwise(number)


def _repeated_keys(text: Column) -> Column:
    """Polarity of an object that names a key twice, which a variant cannot hold: the last value counts."""
    keys, held = F.json_object_keys(text), F.from_json(text, "positive double, negative double")

    def part(key: str) -> Column:
        return F.when(F.array_contains(keys, key), held[key]).otherwise(0.0)

    return F.when(keys.isNotNull(), part("positive") - part("negative"))


def json_polarity(text: Column) -> Column:
    """Polarity of a JSON score; null unless the text is a JSON object with numbers in it; ``NaN`` is no JSON."""
    return bind(
        F.try_parse_json(text),
        lambda score: F.when(score.isNull(), _repeated_keys(text)).when(
            F.schema_of_variant(score).startswith("OBJECT"),
            _part(score, "positive") - _part(score, "negative"),
        ),
    )


def typed_polarity(probabilities: Column) -> Column:
    return probabilities["positive"] - probabilities["negative"]
