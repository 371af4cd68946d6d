"""Streams over landing folders. Every job takes its own checkpoint folder and ends when it has
caught up, so a later start continues after the last finished batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from zeitton.operators.listings import listing_rows, page_facts
from zeitton.operators.scoring import Scorer, category_counts, score_fields
from zeitton.plans.jobs import reached
from zeitton.schemas import FIELDS
from zeitton.sources.articles import append_batch, newest_batch


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Rows of a Parquet file, or of all files that land in a folder.

    Streams list folders; a pattern that only this path fits lets them take a single file as well.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def score_stream(
    articles: DataFrame,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    fields: Sequence[str] = FIELDS,
) -> StreamingQuery:
    """Append scored rows as Parquet. Scoring keeps no state, so each row is written exactly once."""
    return (
        score_fields(articles, scorer, fields)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def collect_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What newly landed archive pages hold, one folder per batch; ``collected`` reads them.

    Which pages a run would have reached depends on pages that may land in any later batch. So batches
    only store what each page holds, in narrow rows, and the stop rules are left to the reader.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(page_facts(batch), out, batch_id)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def collected(spark: SparkSession, out: str) -> DataFrame:
    """Listing rows of all pages that ``collect_stream`` has stored, in whatever order they landed."""
    facts = spark.read.parquet(out).drop("batch_id")
    return listing_rows(reached(facts, facts.drop("teasers"))).drop("position")


def count_stream(
    scored: DataFrame, out: str, checkpoint: str, fields: Sequence[str] = FIELDS
) -> StreamingQuery:
    """Running counts per field and class, the whole small table written anew after every batch.

    State is one number per field and class. Every batch has a folder of its own, so ``running_counts`` never
    meets a table that is being replaced.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.coalesce(1), out, batch_id)

    return (
        category_counts(scored, fields)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts after the last finished batch of ``count_stream``."""
    return spark.read.parquet(f"{out}/batch_id={newest_batch(spark, out)}")
