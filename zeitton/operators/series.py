"""Regular time series from dated rows: filters, resampling, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from zeitton.functions.category import ALL, SECTIONS, infer_category
from zeitton.functions.dates import (
    check_frequency,
    last_label,
    lenient_timestamp,
    next_period,
    period_end,
    spine,
)
from zeitton.functions.text import bind
from zeitton.operators.calendar import period_spine
from zeitton.operators.median import exact_median, median_of_counts, value_counts

AGGREGATES = ("mean", "median")


def check_aggregate(name: str) -> None:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known are {', '.join(AGGREGATES)}")


def preprocessed(df: DataFrame, date_col: str = "date_api", link_col: str = "link") -> DataFrame:
    """Parsed dates, rows without one dropped, and the category inferred from the link."""
    if df.schema[date_col].dataType.typeName() == "string":
        df = df.withColumn(date_col, lenient_timestamp(F.col(date_col)))
    return df.where(F.col(date_col).isNotNull()).withColumn(
        "inferred_category", infer_category(F.col(link_col))
    )


def filter_by_category(df: DataFrame, category: str, category_col: str = "inferred_category") -> DataFrame:
    return df if category == ALL else df.where(F.col(category_col) == category)


def in_range(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from midnight of the start day to midnight of the end day, both included."""
    if start:
        df = df.where(F.col(date_col) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(date_col) <= F.lit(end).cast("timestamp_ntz"))
    return df


def _numbers(df: DataFrame, measures: Sequence[str]) -> list[Column]:
    """Measures as doubles; text that is no number, and NaN, become null."""
    out = []
    for name in measures:
        text = df.schema[name].dataType.typeName() == "string"
        value = F.col(name).try_cast("double") if text else F.col(name).cast("double")
        out.append(F.nanvl(value, F.lit(None).cast("double")).alias(name))
    return out


def resampled(
    df: DataFrame,
    date_col: str,
    measures: Sequence[str],
    agg_func: str = "mean",
    freq: str = "D",
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key and observed period with the mean or median of every measure.

    Rows with any missing measure are left out, for all measures.
    """
    check_aggregate(agg_func)
    keys, measures = list(keys), list(measures)
    label = period_end(F.col(date_col), freq).alias("period_end")
    dated = df.where(F.col(date_col).isNotNull())
    names = {m: f"{m}_{agg_func}" for m in measures}
    if agg_func == "mean":
        rows = dated.select(*keys, label, *_numbers(df, measures)).na.drop("any", subset=measures)
        return rows.groupBy(*keys, "period_end").agg(*(F.avg(m).alias(names[m]) for m in measures))
    long = _long(dated, label, keys, measures)
    medians = exact_median(long, [*keys, "period_end", "measure"], "value", "median")
    return _wide(medians, [*keys, "period_end"], names)


def _long(rows: DataFrame, label: Column, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per measure of the rows that have all measures."""
    complete = bind(
        F.array(*_numbers(rows, measures)),
        lambda values: F.when(
            F.forall(values, lambda v: v.isNotNull()),
            F.arrays_zip(F.array(*map(F.lit, measures)).alias("measure"), values.alias("value")),
        ),
    )
    return rows.select(*keys, label, F.explode(complete).alias("p")).select(
        *keys, "period_end", "p.measure", "p.value"
    )


def _wide(medians: DataFrame, groups: Sequence[str], names: dict[str, str]) -> DataFrame:
    return medians.groupBy(*groups).agg(
        *(F.max(F.when(F.col("measure") == m, F.col("median"))).alias(name) for m, name in names.items())
    )


def _pairs(columns: Sequence[str]) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in columns))


def on_full_spine(
    series: DataFrame,
    freq: str,
    keys: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Every period present, absent ones with nulls.

    With both bounds the periods are those inside them and others go; otherwise they run from the
    first to the last one observed, per key. Keyed series are filled by letting each observation
    emit the gap up to the next one, so the aggregated table is read once and nothing is joined.
    """
    check_frequency(freq)
    bounded = bool(start and end)
    if bounded and not keys:
        labels = period_spine(series.sparkSession, start, end, freq)
        return labels.join(series, "period_end", "left")
    values = [c for c in series.columns if c not in (*keys, "period_end")]
    order = Window.partitionBy(*keys).orderBy("period_end") if keys else Window.orderBy("period_end")
    at, following = F.col("period_end"), F.lead("period_end").over(order)
    first, last = at, F.coalesce(F.col("__next"), next_period(at, freq))
    if bounded:
        low = period_end(F.lit(start).cast("date"), freq)
        high = last_label(F.lit(end).cast("date"), freq)
        series = series.where((at >= low) & (at <= high))
        first = F.when(F.col("__first"), low).otherwise(at)
        last = F.coalesce(F.col("__next"), next_period(high, freq))
    placed = series.withColumns({"__next": following, "__first": F.row_number().over(order) == 1})
    emitted = F.filter(spine(first, last, freq), lambda p: p < last)
    return placed.withColumn("__p", F.explode(emitted)).select(
        *keys,
        F.col("__p").alias("period_end"),
        *(F.when(F.col("__p") == at, F.col(v)).alias(v) for v in values),
    )


def forward_filled(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nulls replaced by the last value before them; leading nulls stay."""
    values = [c for c in series.columns if c not in (*keys, "period_end")]
    order = Window.partitionBy(*keys).orderBy("period_end") if keys else Window.orderBy("period_end")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values})


def gaps_handled(series: DataFrame, how: str, keys: Sequence[str] = ()) -> DataFrame:
    """``ffill`` fills forward, ``drop`` removes periods with any null, anything else keeps the nulls."""
    if how == "ffill":
        return forward_filled(series, keys)
    if how == "drop":
        values = [c for c in series.columns if c not in (*keys, "period_end")]
        return series.na.drop("any", subset=values)
    return series


def aggregate_sentiment(
    df: DataFrame,
    date_col: str,
    sentiment_col: str | Sequence[str],
    agg_func: str = "mean",
    freq: str = "D",
    start_date: str | None = None,
    end_date: str | None = None,
    handle_missing: str = "fill",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Range filter, resampling, full spine and gap handling in one call.

    ``keys`` computes many series at once; without it the result is one series.
    """
    measures = [sentiment_col] if isinstance(sentiment_col, str) else list(sentiment_col)
    rows = in_range(df, date_col, start_date, end_date)
    series = resampled(rows, date_col, measures, agg_func, freq, keys)
    series = on_full_spine(series, freq, keys, start_date, end_date)
    return gaps_handled(series, handle_missing, keys)


def category_series(
    df: DataFrame,
    date_col: str,
    measures: Sequence[str],
    agg_func: str = "mean",
    freq: str = "D",
    category_col: str = "inferred_category",
    start_date: str | None = None,
    end_date: str | None = None,
    handle_missing: str | None = None,
) -> DataFrame:
    """Series of every category and of ``all`` together.

    Rows are read and aggregated once: ``all`` comes from the sums and counts of the categories, or
    for medians from their counted values. With ``handle_missing`` (``fill``, ``ffill``, ``drop``) each
    category is a regular series, as ``aggregate_sentiment`` makes one; without it the periods are
    those observed.
    """
    check_aggregate(agg_func)
    measures = list(measures)
    rows = in_range(df, date_col, start_date, end_date).withColumn("category", F.col(category_col))
    rows = rows.where(F.col(date_col).isNotNull())
    label = period_end(F.col(date_col), freq).alias("period_end")
    both = F.explode(F.array_distinct(F.array(F.col("category"), F.lit(ALL))))
    groups = ["category", "period_end"]
    if agg_func == "median":
        long = _long(rows, label, ["category"], measures)
        counts = value_counts(long, [*groups, "measure"], "value").withColumn("category", both)
        counts = counts.groupBy(*groups, "measure", "__v").agg(F.sum("__n").alias("__n"))
        medians = median_of_counts(counts, [*groups, "measure"], "median")
        out = _wide(medians, groups, {m: f"{m}_median" for m in measures})
    else:
        complete = rows.select("category", label, *_numbers(df, measures)).na.drop("any", subset=measures)
        parts = complete.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(m).alias(m) for m in measures))
        out = parts.withColumn("category", both).groupBy(*groups).agg(
            *((F.sum(m) / F.sum("__n")).alias(f"{m}_mean") for m in measures)
        )
    if handle_missing is None:
        return out
    regular = on_full_spine(out, freq, ["category"], start_date, end_date)
    return gaps_handled(regular, handle_missing, ["category"])


def trend_long(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wide series to ``(keys, period_end, measure, value)``."""
    values = [c for c in series.columns if c not in (*keys, "period_end")]
    return series.select(*keys, "period_end", F.explode(_pairs(values)).alias("p")).select(
        *keys, "period_end", "p.measure", "p.value"
    )


def head(series: DataFrame, n: int = 10) -> DataFrame:
    return series.orderBy("period_end").limit(n)


__all__ = [
    "ALL",
    "SECTIONS",
    "aggregate_sentiment",
    "category_series",
    "filter_by_category",
    "forward_filled",
    "gaps_handled",
    "head",
    "in_range",
    "on_full_spine",
    "preprocessed",
    "resampled",
    "trend_long",
]
