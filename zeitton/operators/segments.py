"""Correlograms of series that are kept in segments.

A segment's summary holds its counts and sums, the products of values up to ``K`` places apart, and its first and last ``K``
values. Two neighbouring summaries make one, so a series can span tasks and grow by batches, and
its past is not read again. Any cut of a series gives the sums of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zeitton.functions.text import bind


def _products(left: Column, right: Column, lag: Column) -> Column:
    """Sum of ``left[i] * right[i + lag]`` over all places there are."""
    pairs = F.zip_with(left, F.slice(right, lag + 1, F.greatest(F.size(right), F.lit(1))), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def _ends(a: Column, b: Column, nlags: int) -> tuple[Column, Column]:
    """The first and the last values of two neighbouring runs of values."""
    head = F.slice(F.concat(a["head"], b["head"]), 1, nlags)
    tail = F.concat(a["tail"], b["tail"])
    return head, F.slice(tail, F.greatest(F.size(tail) - nlags, F.lit(0)) + 1, F.lit(max(nlags, 1)))


def summaries(series: DataFrame, keys: Sequence[str], segment: str, nlags: int = 40, value: str = "value", shift: float = 0.0) -> DataFrame:
    """``keys, segment, since`` and ``summary`` of the pieces that the column ``segment`` cuts the series into.

    Pieces must not overlap in time. Null values are left out, so a lag counts observations. ``shift``, some value
    near the mean, is taken off all values against rounding; it must be the same for all segments of a series.
    """
    number = F.col(value).cast("double")
    held = series.where(number.isNotNull() & ~F.isnan(number))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("period_end", (number - shift).alias("x")))), lambda r: r["x"])
    pieces = held.groupBy(*keys, segment).agg(F.min("period_end").alias("since"), ordered.alias("__x"))
    lags = F.sequence(F.lit(0), F.lit(nlags))
    x = F.col("__x")
    summary = F.struct(
        F.size(x).cast("bigint").alias("n"),
        F.aggregate(x, F.lit(0.0), lambda total, v: total + v).alias("total"),
        F.array_min(x).alias("low"), F.array_max(x).alias("high"),
        F.transform(lags, lambda k: _products(x, x, k)).alias("products"),
        F.slice(x, 1, max(nlags, 1)).alias("head"),
        F.slice(x, F.greatest(F.size(x) - nlags, F.lit(0)) + 1, F.lit(max(nlags, 1))).alias("tail"),
    )
    return pieces.select(*keys, segment, "since", summary.alias("summary"))


def united(a: Column, b: Column, nlags: int) -> Column:
    """The summary of two neighbouring pieces, ``a`` before ``b``."""

    def across(k: Column) -> Column:
        """Products of pairs that the cut parts: one of the last ``k`` values of ``a`` with one of the first of ``b``."""
        last = F.slice(a["tail"], F.greatest(F.size(a["tail"]) - k, F.lit(0)) + 1, F.greatest(k, F.lit(1)))
        missing = k - F.size(last)  # a shorter piece than the lag: its first value meets a later one of b
        return F.when(k > 0, _products(last, F.slice(b["head"], 1, F.greatest(k, F.lit(1))), missing)).otherwise(0.0)

    head, tail = _ends(a, b, nlags)
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["total"] + b["total"]).alias("total"),
        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
        F.transform(a["products"], lambda s, k: s + F.get(b["products"], k) + across(k)).alias("products"),
        head.alias("head"), tail.alias("tail"),
    )


def whole_series(stored: DataFrame, keys: Sequence[str], nlags: int = 40) -> DataFrame:
    """``keys`` and the ``summary`` of each whole series, from the summaries of its pieces in the order of their time."""
    lined = F.transform(F.sort_array(F.collect_list(F.struct("since", "summary"))), lambda p: p["summary"])
    pieces = stored.groupBy(*keys).agg(lined.alias("__p"))
    rest = F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1)))
    return pieces.select(*keys, F.aggregate(rest, F.get("__p", 0), lambda a, b: united(a, b, nlags)).alias("summary"))


def acf_of_summary(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, lag, acf`` of whole series, up to the last lag there are values for; null for a constant series."""

    def sums(s: Column) -> Column:
        mean = s["total"] / s["n"]

        def centred(product: Column, k: Column) -> Column:
            add = lambda values: F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
            first = add(F.slice(s["head"], F.lit(1), F.greatest(k, F.lit(0))))
            last = add(F.slice(s["tail"], F.greatest(F.size(s["tail"]) - k, F.lit(0)) + 1, F.greatest(k, F.lit(0))))
            return product - mean * (2 * s["total"] - first - last) + (s["n"] - k) * mean * mean

        return F.transform(s["products"], centred)

    def shares(all_sums: Column) -> Column:
        constant = F.col("summary.low") >= F.col("summary.high")
        return F.transform(all_sums, lambda v: F.when(~constant, v / F.get(all_sums, 0)))

    lagged = series.select(*keys, F.col("summary.n").alias("__n"), F.posexplode(bind(bind(F.col("summary"), sums), shares)).alias("lag", "acf"))
    return lagged.where(F.col("lag") < F.col("__n")).drop("__n")
