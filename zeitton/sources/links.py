"""Listing rows as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from zeitton.functions.text import once
from zeitton.operators.listings import relative_links
from zeitton.schemas import LISTING


def parse_links(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to listing rows.

    Lines that are no JSON object with a text ``link`` are dropped, as are absolute links; an empty
    link stays.
    """
    entry = F.try_parse_json(F.col(line))
    parsed = once(lines, "e", entry).select("e")
    is_text = F.schema_of_variant(F.try_variant_get("e", "$.link", "variant")) == "STRING"
    is_object = F.schema_of_variant("e").startswith("OBJECT")
    held = parsed.where(is_object & is_text)
    columns = [F.try_variant_get("e", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in LISTING]
    return relative_links(held.select(*columns))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links from a file or folder; a path that does not exist gives an empty frame."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    return parse_links(lines)


def append_links(df: DataFrame, path: str) -> None:
    """Append as UTF-8 JSON, one object per line; null fields are written too."""
    columns = [f.name for f in LISTING]
    df.select(*columns).write.mode("append").option("ignoreNullFields", "false").json(path)
