"""Duplicates, statistics, ordering and incremental work over article tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from zeitton.operators.skew import HOT_ROWS, join_split
from zeitton.session import stage

WIDE = ("articleBody", "html")  # columns of whole texts


def located(df: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows stored once, each with its place ``__at``, and per key the place of its first row by ``order``.

    The choice reads the key, the order and a 128-bit hash of the other columns, taken while the rows were stored; the
    place in the stored files decides between equal rows. Wide columns are not even read for it.
    """
    plain = (T.MapType, T.VariantType)
    rest = [f.name for f in df.schema.fields if f.name not in (key, *order) and not isinstance(f.dataType, plain)]
    tie = F.struct(*(F.xxhash64(F.lit(seed), *rest).alias(f"h{seed}") for seed in (1, 2)))
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    stored = stage(df.withColumn("__tie", tie), "rows").withColumn("__at", place)
    first = F.min(F.struct(*order, "__tie", "__at")).alias("__first")
    winners = stored.groupBy(key).agg(first).select(key, F.col("__first.__at").alias("__at"))
    return stored.drop("__tie"), stage(winners, "winners")


def deduplicated(
    df: DataFrame, key: str = "link", order: Sequence[str] = ("date_api", "page_api"), wide: Sequence[str] = WIDE
) -> DataFrame:
    """First row per key by ``order``; what the other columns hold breaks ties.

    A minimum over structs is combined before the shuffle, so copies of one key meet as one row per
    task and not as a whole group. Rows with one of the ``wide`` columns are chosen without it, and the
    winners' rows are fetched by their place in the end.
    """
    if any(c in df.columns for c in wide):
        stored, winners = located(df, key, order)
        return stored.join(winners.select("__at"), "__at", "left_semi").select(*df.columns)
    rest = [c for c in df.columns if c not in (key, *order)]
    row = F.struct(*order, *rest)
    return df.groupBy(key).agg(F.min(row).alias("__row")).select(
        *(F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns)
    )


def dataset_statistics(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Articles, days and unique articles; ``approximate`` uses sketches for the distinct counts."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("articles"),
        distinct(F.col("date_api")).alias("days"),
        distinct(F.col("link")).alias("unique_articles"),
    )


def sorted_by_day(df: DataFrame) -> DataFrame:
    """Order by ``date_api``; page and link follow so that one crowded day can span partitions."""
    return df.orderBy("date_api", *(c for c in ("page_api", "link") if c in df.columns))


def not_yet_done(df: DataFrame, done: DataFrame, key: str = "link", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose key is not in ``done``. Rows without a key are never done and pass unshuffled."""
    known = done.select(key).where(F.col(key).isNotNull()).distinct()
    todo = join_split(df.where(F.col(key).isNotNull()), known, key, "left_anti", hot_rows)
    return todo.select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def save_bucketed(df: DataFrame, table: str, path: str, key: str = "link", buckets: int = 200) -> None:
    """Store as a table whose files are dealt and sorted by ``key``, for joins that shuffle neither side."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def not_yet_done_stored(spark: SparkSession, table: str, done: str, key: str = "link") -> DataFrame:
    """Rows of a stored table whose key is not in ``done``, both saved by ``save_bucketed`` with as many buckets.

    Buckets meet where they are read. A key of very many rows makes a large bucket, for which ``not_yet_done`` is the way.
    Rows without a key are never done.
    """
    return spark.table(table).join(spark.table(done).select(key), key, "left_anti").select(*spark.table(table).columns)


def after_first(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """Rows after the first ``n`` in the order of ``key``, which must identify a row.

    A plain offset would send the sorted table through one task. Instead the sorted keys alone are
    stored with their partition and place in it; the sizes of the partitions, one row each, tell
    which stored key is number ``n``, and the table is then filtered by that key.
    """
    if n <= 0:
        return df
    at = F.monotonically_increasing_id()
    keys = stage(df.select(*key).orderBy(*key).withColumn("__at", at), "sorted-keys")
    keys = keys.withColumn("__part", F.shiftright("__at", 33))
    sizes = keys.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    upto = F.sum("__size").over(Window.orderBy("__part"))
    holder = (
        sizes.withColumn("__before", upto - F.col("__size"))
        .where((F.col("__before") < n) & (F.col("__before") + F.col("__size") >= n))
    )
    nth = keys.join(F.broadcast(holder), "__part").where(
        F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1 == n
    )
    return df.where(F.struct(*key) > nth.select(F.struct(*key).alias("k")).scalar())


def appended(earlier: DataFrame, new: DataFrame) -> DataFrame:
    return earlier.unionByName(new, allowMissingColumns=True)
