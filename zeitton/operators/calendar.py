"""Calendars, worklists and the early-stop rules of a collection run.

Per-day and per-month tables are small by construction: a date column has at most 3.7 million
distinct days. That bound is what allows them to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from zeitton.functions.dates import month_label, range_spine


FIRST_DAY = "0001-01-01"


def _row(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def day_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included."""
    return period_spine(spark, start, end, "D").withColumnRenamed("period_end", "day")


def period_spine(spark: SparkSession, start: str, end: str, freq: str) -> DataFrame:
    """All period labels inside ``[start, end]``."""
    labels = range_spine(F.lit(start).cast("date"), F.lit(end).cast("date"), freq)
    return _row(spark).select(F.explode(labels).alias("period_end"))


def month_groups(days: DataFrame) -> DataFrame:
    """Distinct days listed per month; a list has at most 31 entries."""
    return (
        days.select("day").distinct()
        .groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(
            F.array_sort(F.collect_list("day")).alias("days"),
            F.first(month_label(F.col("day"))).alias("label"),
        )
    )


def backfill_days(failed: DataFrame) -> DataFrame:
    """Failed day and page to every day from then to the end of that month.

    The failed day starts at its page, or at page 1 if the line named none; later days start at page 1.
    """
    until = F.sequence(F.col("day"), F.last_day("day"))
    listed = failed.select(F.posexplode(until).alias("__later", "day"), "page")
    start = F.when(F.col("__later") == 0, F.coalesce("page", F.lit(1))).otherwise(1)
    return listed.select("day", start.alias("start_page"))


def first_pages(worklist: DataFrame) -> DataFrame:
    """The page that each day of a worklist begins with; pages count from 1."""
    return worklist.where(F.col("start_page") >= 1).groupBy("day").agg(F.min("start_page").alias("start_page"))


def from_start_page(pages: DataFrame, worklist: DataFrame) -> DataFrame:
    """Pages of worklist days, from each day's ``start_page`` on (the lowest if listed twice).

    Pages stored by ``month`` are joined by it as well, so that the scan reads the worklist's months only.
    """
    starts = first_pages(worklist)
    keys = ["day"]
    if "month" in pages.columns:
        # Spark prunes a scan only by tables that a comparison has narrowed; this one holds for every day there is.
        some = starts.where(F.col("day") >= F.lit(FIRST_DAY).cast("date"))
        starts, keys = some.withColumn("month", F.trunc("day", "MM")), ["month", "day"]
    joined = pages.drop("start_page").join(F.broadcast(starts), keys)
    return joined.where(F.col("page") >= F.col("start_page"))


def pages_until_stop(pages: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Within a day, pages from its first one up to the first that is empty, failed or missing.

    ``status`` carries ``day, page, n_links, error`` and defaults to ``pages`` itself. A day begins at
    page 1, or at its ``start_page`` where that column is there. The first missing page follows one
    whose successor is not stored, which a join of narrow rows finds; the first stop is a minimum,
    combined before the shuffle, so a day with very many pages is no single task.
    """
    status = pages if status is None else status
    start = F.col("start_page") if "start_page" in status.columns else F.lit(1)
    narrow = status.select("day", "page", start.alias("__start"), (F.col("error") | (F.col("n_links") == 0)).alias("__bad"))
    narrow = narrow.where(F.col("page") >= F.col("__start"))
    stored = narrow.select("day", F.col("page").alias("__next")).distinct()
    begun = status.select("day", (start - 1).alias("page")).distinct()
    after = narrow.select("day", "page").distinct().unionByName(begun).withColumn("__next", F.col("page") + 1)
    missing = after.join(stored, ["day", "__next"], "left_anti").select("day", F.col("__next").alias("__stop"))
    bad = narrow.where("__bad").select("day", F.col("page").alias("__stop"))
    stops = missing.unionByName(bad).groupBy("day").agg(F.min("__stop").alias("__stop"))
    joined = pages.join(F.broadcast(stops), "day")
    return joined.where(F.col("page").between(start if "start_page" in pages.columns else F.lit(1), F.col("__stop") - 1)).drop("__stop")


def days_until_summary(pages: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Within a month, days up to the first one that turns out to be a summary of the whole month.

    Expects pages already cut by ``pages_until_stop``; a flag on a page without links has no effect.
    """
    status = pages if status is None else status
    month = F.trunc("day", "MM").alias("__month")
    flagged = status.where(F.col("monthly_summary") & (F.col("n_links") > 0))
    cuts = flagged.groupBy(month).agg(F.min("day").alias("__cut"))
    joined = pages.withColumn("__month", month).join(F.broadcast(cuts), "__month", "left")
    return joined.where(F.col("__cut").isNull() | (F.col("day") <= F.col("__cut"))).drop("__month", "__cut")


def missing_days(calendar: DataFrame, listings: DataFrame) -> DataFrame:
    """Calendar days without any listing row."""
    return calendar.join(listings.select("day").distinct(), "day", "left_anti")


def observed_days(df: DataFrame, day: str) -> DataFrame:
    """Every day between the first and the last one found in a column."""
    ends = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))
