"""Exact medians of groups of any size, by one path for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FINE, FINEST = 20, 37  # bits of a value's fraction that name its fine and its finest bucket; a double has 52


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, __v, __n``: how often each number occurs in a group; nulls and NaN are left out."""
    number = F.col(value).cast("double")
    valid = df.where(F.col(value).isNotNull() & ~F.isnan(number)).select(*keys, (number + F.lit(0.0)).alias("__v"))
    return valid.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))


def _exponent(v: Column) -> Column:
    return F.floor(F.log2(F.abs(v))).cast("int")


def _coarse(v: Column) -> Column:
    """Sign and exponent: at most 4,200 buckets, in the order of the values."""
    size = F.when(F.abs(v) == float("inf"), 3000).otherwise(_exponent(v) + 1500)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _fine(v: Column, bits: int = FINE) -> Column:
    """The value's place among 2^bits parts of its coarse bucket."""
    bounded = (v != 0) & (F.abs(v) < float("inf"))
    half = F.floor(_exponent(v) / 2).cast("int")  # two factors, since one could overflow
    scaled = v / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), _exponent(v) - half)
    return F.when(bounded, F.floor(scaled * 2**bits)).otherwise(0).cast("bigint")


def _at_middle(counts: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Rows of ``counts`` that hold a middle rank; ``__before`` counts what stands before each in its whole group."""
    upto = F.sum("__n").over(Window.partitionBy(*groups).orderBy(order)) + F.col("__base")
    placed = counts.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))
    ranks = ((F.col("__total") + 1) / 2, (F.col("__total") + 2) / 2)
    holds = [(F.col("__before") < F.floor(r)) & (F.col("__upto") >= F.floor(r)) for r in ranks]
    return placed.withColumns({"__low": holds[0], "__high": holds[1]}).where(holds[0] | holds[1])


def median_of_counts(counts: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Median per group of ``keys, __v, __n``, the mean of the two middle values for even sizes.

    Counts of coarse buckets tell where the middle ranks lie, those of the fine and then of the finest buckets in there
    narrow them down, and only values of a finest bucket are looked at one by one. Every step sums before
    it shuffles, and a window never sees more than the buckets of a group, 2^20 at most, or the different
    values inside one finest bucket, 2^16 at most because a double has no more (just below a power of two,
    where the exponent may be rounded up). ``counts`` is used four times; Spark shuffles it once.
    """
    keys, v = list(keys), F.col("__v")
    buckets = counts.withColumns({"__c": _coarse(v), "__f": _fine(v), "__g": _fine(v, FINEST)})

    def narrowed(rows: DataFrame, found: DataFrame, on: Sequence[str], carried: Sequence[str]) -> DataFrame:
        names = {k: f"__at_{k}" for k in on}
        picked = found.select(*(F.col(k).alias(n) for k, n in names.items()), *carried)
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        return rows.join(picked, same).drop(*names.values())

    carried = ["__base", "__total"]
    coarse = buckets.groupBy(*keys, "__c").agg(F.sum("__n").alias("__n")).withColumn("__base", F.lit(0).cast("bigint"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    coarse = _at_middle(coarse.withColumn("__total", total), keys, "__c").withColumn("__base", F.col("__before"))
    fine = narrowed(buckets, coarse, [*keys, "__c"], carried)
    fine = fine.groupBy(*keys, "__c", "__f", *carried).agg(F.sum("__n").alias("__n"))
    fine = _at_middle(fine, [*keys, "__c"], "__f").withColumn("__base", F.col("__before"))
    finest = narrowed(buckets, fine, [*keys, "__c", "__f"], carried)
    finest = finest.groupBy(*keys, "__c", "__f", "__g", *carried).agg(F.sum("__n").alias("__n"))
    finest = _at_middle(finest, [*keys, "__c", "__f"], "__g").withColumn("__base", F.col("__before"))
    values = narrowed(buckets, finest, [*keys, "__c", "__f", "__g"], carried)
    middle = _at_middle(values, [*keys, "__c", "__f", "__g"], "__v").groupBy(*keys).agg(
        F.max(F.when(F.col("__low"), F.col("__v"))).alias("__a"),
        F.max(F.when(F.col("__high"), F.col("__v"))).alias("__b"),
    )
    return middle.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(out))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Median of ``value`` per group of ``keys``; see ``median_of_counts``."""
    return median_of_counts(value_counts(df, keys, value), keys, out)
