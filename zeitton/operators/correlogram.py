"""Autocorrelation and partial autocorrelation of many series at once.

A series holds one row per period, so its length is bounded by the calendar however many articles
went into it. All window and aggregate steps share one exchange by series key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from zeitton.functions.text import bind
from zeitton.operators.series import trend_long


def lag_sums(series: DataFrame, keys: Sequence[str], nlags: int = 40, value: str = "value") -> DataFrame:
    """Per series the number of values and ``sums[k]``, the lagged products of the centred values.

    Nulls are left out first, so a lag counts observations. A constant series has null sums.
    """
    if nlags < 0:
        raise ValueError("nlags must not be negative")
    keys = list(keys)
    number = F.col(value).cast("double")
    held = series.where(number.isNotNull() & ~F.isnan(number)).select(*keys, "period_end", number.alias("__x"))
    quoted = [f"`{k}`" for k in keys]
    whole = f"partition by {', '.join(quoted)}" if keys else ""
    centred = held.selectExpr(*quoted, "period_end", "__x", f"__x - avg(__x) over ({whole}) as __d")
    order = f"over ({whole} order by period_end)"
    lagged = centred.selectExpr(
        *quoted, "__x", "__d", *(f"lag(__d, {k}) {order} as __l{k}" for k in range(1, nlags + 1))
    )
    sums = ", ".join(f"sum(__d * {n})" for n in ("__d", *(f"__l{k}" for k in range(1, nlags + 1))))
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"case when min(__x) < max(__x) then array({sums}) end").alias("sums"),
    )


def _partials(sums: Column, n: Column, highest: Column) -> Column:
    """Partial autocorrelations for lags 0 to ``highest`` by the Durbin-Levinson recursion.

    Covariances are divided by the number of pairs they come from.
    """
    covariances = F.transform(sums, lambda s, k: s / F.greatest(n - k, F.lit(1)))

    def run(r: Column) -> Column:
        start = F.struct(
            F.array().cast("array<double>").alias("phi"),
            F.get(r, 0).alias("left"),
            F.array(F.lit(1.0)).alias("found"),
        )

        def step(state: Column, k: Column) -> Column:
            phi = state["phi"]
            known = F.aggregate(
                F.transform(phi, lambda p, j: p * F.get(r, k - 1 - j)), F.lit(0.0), lambda a, b: a + b
            )
            reflection = F.try_divide(F.get(r, k) - known, state["left"])

            def extend(a: Column) -> Column:
                updated = F.transform(phi, lambda p, j: p - a * F.get(phi, k - 2 - j))
                return F.struct(
                    F.concat(updated, F.array(a)).alias("phi"),
                    (state["left"] * (1 - a * a)).alias("left"),
                    F.concat(state["found"], F.array(a)).alias("found"),
                )

            return bind(reflection, extend)

        lags = F.when(highest >= 1, F.sequence(F.lit(1), highest)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(lags, start, step, lambda state: state["found"])

    return bind(covariances, run)


def correlogram(series: DataFrame, keys: Sequence[str], nlags: int = 40, value: str = "value") -> DataFrame:
    """``(keys, lag, acf, pacf)`` for lags 0 to ``nlags``.

    Lags end at the number of values minus one. Partial autocorrelation is given for lags below half
    the number of values. A series without variance gets nulls.
    """
    keys = list(keys)
    parts = lag_sums(series, keys, nlags, value)
    highest = F.least(F.lit(nlags), (F.ceil(F.col("n") / 2) - 1).cast("int"))
    full = parts.withColumn("__p", F.when(F.col("sums").isNotNull(), _partials(F.col("sums"), F.col("n"), highest)))
    lags = F.sequence(F.lit(0), F.least(F.lit(nlags), (F.col("n") - 1).cast("int")))
    return full.withColumn("lag", F.explode(lags)).select(
        *keys,
        "lag",
        F.try_divide(F.get("sums", F.col("lag")), F.get("sums", F.lit(0))).alias("acf"),
        F.get("__p", F.col("lag")).alias("pacf"),
    )


def wide_correlogram(series: DataFrame | Sequence[DataFrame], nlags: int = 40) -> DataFrame:
    """Correlogram of every column of a wide series, or of several wide series, keyed by column name."""
    frames = [series] if isinstance(series, DataFrame) else list(series)
    names = [c for frame in frames for c in frame.columns if c != "period_end"]
    if len(set(names)) < len(names):
        raise ValueError("series need different names")
    long = reduce(DataFrame.unionByName, map(trend_long, frames))
    return correlogram(long, ["measure"], nlags)


def acf(series: DataFrame, keys: Sequence[str], nlags: int = 40, value: str = "value") -> DataFrame:
    return correlogram(series, keys, nlags, value).drop("pacf")


def pacf(series: DataFrame, keys: Sequence[str], nlags: int = 40, value: str = "value") -> DataFrame:
    return correlogram(series, keys, nlags, value).where(F.col("pacf").isNotNull()).drop("acf")


def lag_pairs(series: DataFrame, keys: Sequence[str], nlags: int, value: str = "value") -> DataFrame:
    """``(keys, lag, at, x, lagged)``: every value with the one ``lag`` observations before it."""
    order = Window.partitionBy(*keys).orderBy("period_end")
    held = series.where(F.col(value).isNotNull())
    earlier = [
        F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(order).alias("lagged")) for k in range(nlags + 1)
    ]
    placed = held.select(
        *keys, F.row_number().over(order).alias("at"), F.col(value).alias("x"), F.array(*earlier).alias("__l")
    )
    return placed.select(*keys, "at", "x", F.explode("__l").alias("__e")).select(
        *keys, "__e.lag", "at", "x", "__e.lagged"
    ).where(F.col("lagged").isNotNull())
