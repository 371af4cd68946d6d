"""Summaries that can be kept and united: quantiles of series, and distinct counts of a growing dataset.

What is stored is one small row per day or batch. Later questions unite the rows and read no article again.
Results are estimates; the exact ways are ``series`` and ``dataset``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from zeitton.functions.dates import period_end
from zeitton.operators.series import ALL
from zeitton.schemas import STATISTICS
from zeitton.sources.articles import append_batch, newest_batch

QUANTILE_K = 800  # a quantile's rank is then off by less than half a per cent, nearly always
LINK_BITS = 16  # distinct counts are exact up to 2^16 and off by about 0.4 per cent beyond


def day_sketches(df: DataFrame, date_col: str, measures: Sequence[str], category_col: str = "inferred_category") -> DataFrame:
    """``category, day, measure, sketch``: a quantile sketch of every measure per category and day, without null values."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).try_cast("double").alias("value")) for m in measures))
    )
    long = df.select(F.col(category_col).alias("category"), F.col(date_col).cast("date").alias("day"), pairs.alias("p"))
    long = long.where(F.col("day").isNotNull() & F.col("p.value").isNotNull() & ~F.isnan("p.value"))
    return long.groupBy("category", "day", "p.measure").agg(F.kll_sketch_agg_double("p.value", QUANTILE_K).alias("sketch"))


def rolled_up(sketches: DataFrame, freq: str) -> DataFrame:
    """``category, period_end, measure, sketch`` of days, weeks or months, with ``all`` categories together.

    Takes days or longer periods that lie inside the new ones, and any number of rows per key, as several batches leave them.
    """
    at = "day" if "day" in sketches.columns else "period_end"
    both = F.explode(F.array_distinct(F.array("category", F.lit(ALL)))) if at == "day" else F.col("category")
    placed = sketches.select(both.alias("category"), period_end(F.col(at), freq).alias("period_end"), "measure", "sketch")
    return placed.groupBy("category", "period_end", "measure").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column, share: float = 0.5) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def append_statistics(df: DataFrame, path: str, batch_id: int) -> None:
    """Statistics of a batch of articles, and those of all batches so far, as one stored row.

    ``new_links`` are the links that no earlier batch had. Repeating a batch replaces its row.
    """
    spark = df.sparkSession
    own = df.agg(
        F.count(F.lit(1)).alias("articles"),
        F.theta_sketch_agg("date_api", LINK_BITS).alias("days"),
        F.theta_sketch_agg("link", LINK_BITS).alias("links"),
    )
    seen = statistics_rows(spark, path).where(F.col("batch_id") < batch_id).agg(F.theta_union_agg("links", LINK_BITS).alias("seen"))
    fresh = F.theta_sketch_estimate(F.theta_difference(F.col("links"), seen.scalar()))
    append_batch(own.withColumn("new_links", F.coalesce(fresh, F.theta_sketch_estimate("links"))), path, batch_id)


def statistics_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, none if nothing is stored yet."""
    if newest_batch(spark, path) is None:
        return spark.createDataFrame([], STATISTICS)
    return spark.read.schema(STATISTICS).parquet(path)


def statistics_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Articles, days and unique articles of all batches together, from their stored rows."""
    return statistics_rows(spark, path).agg(
        F.sum("articles").alias("articles"),
        F.theta_sketch_estimate(F.theta_union_agg("days", LINK_BITS)).alias("days"),
        F.theta_sketch_estimate(F.theta_union_agg("links", LINK_BITS)).alias("unique_articles"),
    )
