"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

HOT_ROWS = 1_000_000


def join_split(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join with a ``right`` side of one row per key, hot keys of ``left`` shared among several tasks.

    Keys with more than ``hot_rows`` rows are found by counting. Their left rows are divided into parts
    of about that size and the one matching right row is repeated for each part; all other rows have
    a single part. Every left row still meets its right row exactly once. The broadcast table has one
    row per ``hot_rows`` input rows at most, and the count reads the key column alone.

    The part comes from the row's values and its partition number, so it stays the same when a task
    is run again, and equal rows of different partitions are still divided.
    """
    hot = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))
    )
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    part = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col("__parts")).cast("int")
    split = (
        left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__part", F.when(F.col("__parts").isNotNull(), part).otherwise(0))
        .drop("__hot", "__parts")
    )
    parts = F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
    repeated = (
        right.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__part", F.explode(parts))
        .drop("__hot", "__parts")
    )
    return split.join(repeated, [key, "__part"], how).drop("__part")
