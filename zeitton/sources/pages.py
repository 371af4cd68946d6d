"""Stored HTML pages and the list of failed days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from zeitton.functions.dates import iso_day
from zeitton.schemas import ARCHIVE_PAGE, DAY, RAW_PAGE, extended


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_PAGE).parquet(path)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages whose URL asks for an archive day, as ``(day, page, html)``; page 1 when not given."""
    day = iso_day(F.try_parse_url("url", F.lit("QUERY"), F.lit("datum")))
    page = F.try_parse_url("url", F.lit("QUERY"), F.lit("pageIndex")).try_cast("int")
    return pages.select(day.alias("day"), F.coalesce(page, F.lit(1)).alias("page"), "html").where(
        F.col("day").isNotNull()
    )


def store_archive(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Archive pages as a table in parts of a month; a month with very many pages is several files, each of some days."""
    by_month = pages.withColumn("month", F.trunc("day", "MM"))
    by_month.repartitionByRange("month", "day", "page").write.mode(mode).partitionBy("month").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Stored archive pages with their ``month``, by which readers of some days skip the files of other months."""
    return spark.read.schema(extended(ARCHIVE_PAGE, "month", DAY)).parquet(path)


def article_pages(pages: DataFrame) -> DataFrame:
    """Pages as ``(link, html)`` with the path of the URL as the link."""
    link = F.try_parse_url("url", F.lit("PATH"))
    return pages.select(link.alias("link"), "html").where(F.col("link").isNotNull() & (F.col("link") != ""))


def read_failed_days(spark: SparkSession, path: str) -> DataFrame:
    """Failed days of a text file; see ``parse_failed_days``."""
    return parse_failed_days(spark.read.text(path))


def parse_failed_days(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines ``YYYY-MM-DD;page[;rest]``; lines without a valid day are dropped.

    A page that is no number is null here, which shows the line, and counts as page 1 in a worklist.
    """
    parts = F.split(F.col(line), ";", 3)
    return lines.select(
        iso_day(F.get(parts, 0)).alias("day"),
        F.trim(F.get(parts, 1)).try_cast("int").alias("page"),
        F.get(parts, 2).alias("rest"),
    ).where(F.col("day").isNotNull())
