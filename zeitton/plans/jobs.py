"""The four steps from stored pages to correlograms, each reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from zeitton.functions.dates import lenient_timestamp
from zeitton.functions.polarity import json_polarity
from zeitton.operators.articles import extract_articles, with_articles
from zeitton.operators.calendar import (
    FIRST_DAY,
    backfill_days,
    days_until_summary,
    first_pages,
    from_start_page,
    pages_until_stop,
)
from zeitton.operators.correlogram import wide_correlogram
from zeitton.operators.dataset import not_yet_done
from zeitton.operators.listings import listing_rows, page_facts, relative_links
from zeitton.operators.scoring import Scorer, score_fields
from zeitton.operators.series import (
    aggregate_sentiment,
    filter_by_category,
    preprocessed,
)
from zeitton.schemas import ARTICLE_POLARITY, DROPPED_BY_CLEANING, FIELDS, LISTING, TEXT, extended
from zeitton.session import stage
from zeitton.sources.articles import read_tsv


def collect(pages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Listing rows of the archive pages of a date range.

    The HTML is read once; what it holds is stored in narrow rows, from which the stop rules read their few
    columns and the pages that a run gets to give their teasers. The outcome of the rules, one row per day and per month, is
    broadcast.
    """
    facts = stage(page_facts(pages_between(pages, start, end)), "page-facts")
    return listing_rows(reached(facts, facts.drop("teasers"))).drop("position")


def pages_between(pages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pages of a date range, both ends included; of pages stored by month other months are not scanned."""
    for bound, inside in ((start, Column.__ge__), (end, Column.__le__)):
        if bound:
            day = F.lit(bound).cast("date")
            pages = pages.where(inside(F.col("day"), day))
            if "month" in pages.columns:
                pages = pages.where(inside(F.col("month"), F.trunc(day, "MM")))
    return pages


def reached(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Pages that a collection run gets to, by the status of all pages."""
    kept = pages_until_stop(pages, status)
    return days_until_summary(kept, pages_until_stop(status))


def collect_after(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """The same for failed days: from each one's page on, and all later days of its month."""
    return collect(from_start_page(pages, backfill_days(failed)))


def save_months(listings: DataFrame, path: str) -> None:
    """Listing rows as a table in parts of a month; months that the rows hold replace the stored ones, others stay."""
    by_month = listings.withColumn("month", F.substring("date_api", 1, 7))
    by_month.repartitionByRange("month", "date_api", "page_api").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(path)


def recollect(spark: SparkSession, path: str, pages: DataFrame, failed: DataFrame) -> None:
    """Collect failed days again and bring them into the stored listings of ``save_months``.

    From each failed page to the end of its month new rows replace the stored ones; earlier days and pages of the month stay. The
    months are put together in a table of their own before they replace the old ones, and doing it twice changes nothing.
    """
    starts = stage(first_pages(backfill_days(failed)), "worklist")
    days = starts.select(F.date_format("day", "yyyy-MM-dd").alias("date_api"), "start_page")
    some = starts.where(F.col("day") >= F.lit(FIRST_DAY).cast("date"))  # a comparison, by which Spark prunes the scan of the stored months
    months = some.select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
    stored = spark.read.schema(extended(LISTING, "month", TEXT)).parquet(path)
    held = stored.join(F.broadcast(months), "month")
    kept = held.join(F.broadcast(days), "date_api", "left").where(F.col("start_page").isNull() | (F.col("page_api") < F.col("start_page")))
    new = collect(from_start_page(pages, starts))
    merged = stage(kept.select(*new.columns).unionByName(new), "months")
    save_months(merged, path)
    left = merged.select(F.substring("date_api", 1, 7).alias("month")).distinct()
    for row in months.join(left, "month", "left_anti").collect():  # months without any row left
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/month={row['month']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fetch(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Relative listing rows joined with the fields of their article pages."""
    return with_articles(relative_links(listings), extract_articles(pages))


def score(articles: DataFrame, scorer: Scorer, done: DataFrame | None = None) -> DataFrame:
    """Four scored text fields; rows whose link is in ``done`` are skipped."""
    todo = articles if done is None else not_yet_done(articles, done)
    return score_fields(todo, scorer, FIELDS)


def clean(scored: DataFrame) -> DataFrame:
    """Parsed date, polarity per field, and the columns not needed later dropped."""
    return (
        scored.withColumn("date", lenient_timestamp(F.col("date")))
        .withColumns({f"{f}_polarity": json_polarity(F.col(f"{f}_sentiment_score")) for f in FIELDS})
        .drop(*DROPPED_BY_CLEANING)
    )


def clean_and_save(scored: DataFrame, path: str) -> dict[str, int]:
    """Write the cleaned rows and return what was counted on the way: ``rows``, ``rejected`` dates and ``failed`` scores."""
    counts = Observation("cleaning")
    bad = F.col("date").isNotNull() & lenient_timestamp(F.col("date")).isNull()
    unscored = F.col("articleBody_sentiment_score").isNotNull() & json_polarity(F.col("articleBody_sentiment_score")).isNull()
    watched = scored.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"), F.count_if(unscored).alias("failed")
    )
    clean(watched).write.parquet(path)
    return counts.get


def date_rejects(scored: DataFrame) -> DataFrame:
    """How many date texts fit neither accepted format."""
    bad: Column = F.col("date").isNotNull() & lenient_timestamp(F.col("date")).isNull()
    return scored.agg(F.count_if(bad).alias("rejected"), F.count(F.lit(1)).alias("rows"))


def load_cleaned(
    spark: SparkSession, path: str, date_col: str = "date_api", link_col: str = "link"
) -> DataFrame:
    """Cleaned articles from a tab-separated file, with parsed dates and inferred categories."""
    return preprocessed(read_tsv(spark, path, ARTICLE_POLARITY), date_col, link_col)


def correlate(
    cleaned: DataFrame,
    measures: Sequence[str] = ("articleBody_polarity", "short_headline_polarity"),
    category: str = "all",
    date_col: str = "date",
    agg_func: str = "median",
    freq: str = "M",
    start_date: str | None = None,
    end_date: str | None = None,
    missing: str = "fill",
    nlags: int = 53,
) -> tuple[DataFrame, DataFrame]:
    """``(series, correlogram)`` of one category; the correlogram is keyed by measure."""
    if "inferred_category" not in cleaned.columns:
        cleaned = preprocessed(cleaned, date_col)
    rows = filter_by_category(cleaned, category)
    series = aggregate_sentiment(
        rows, date_col, measures, agg_func, freq, start_date, end_date, missing
    )
    return series, wide_correlogram(series, nlags)
