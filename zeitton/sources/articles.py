"""Article tables as tab-separated text and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from zeitton.operators.articles import exchange_form
from zeitton.operators.dataset import sorted_by_day
from zeitton.schemas import ARTICLE

TSV = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
MAX_FILE_ROWS = 50_000
MAX_FILE_BYTES = 1 << 30
KEEP_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """Tab-separated file with quoted fields that may hold tabs, quotes and line breaks.

    Columns are found by the names in the header, whatever their order; those the file lacks are
    null, further ones are left out. Files of one folder must have one header; other orders make the
    read fail. Such a file is read whole by one task, so files above ``MAX_FILE_BYTES`` are refused; ``write_tsv``
    begins a new file every ``MAX_FILE_ROWS`` rows, and ``to_parquet`` turns files into a splittable table once.
    """
    sizes = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("largest"))  # listed, not read
    if (sizes.first()["largest"] or 0) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has a file above {MAX_FILE_BYTES} bytes, which one task would have to read: split it")
    raw = spark.read.options(**TSV, **KEEP_SPACES, multiLine="true", enforceSchema="false").csv(path)
    return raw.select(
        *(
            (F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None))
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema
        )
    )


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = False) -> None:
    """One header per file; nested columns as JSON text; nulls as empty fields."""
    out = exchange_form(sorted_by_day(df) if ordered else df)
    text = {"emptyValue": "", "nullValue": "", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    out.write.mode(mode).options(**TSV, **KEEP_SPACES, **text, maxRecordsPerFile=MAX_FILE_ROWS).csv(path)


def save_articles(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted tab-separated text for names ending in ``.csv``, else Parquet."""
    if path.endswith(".csv"):
        write_tsv(df, path, mode, ordered=True)
    else:
        df.write.mode(mode).parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch below its own folder; repeating a batch replaces it instead of doubling it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def newest_batch(spark: SparkSession, path: str) -> int | None:
    """The highest batch that ``append_batch`` has finished below ``path``; null without any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch_id=*/_SUCCESS")
    done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return max((int(f.getPath().getParent().getName().removeprefix("batch_id=")) for f in done), default=None)


def to_parquet(spark: SparkSession, tsv: str, out: str, schema: T.StructType = ARTICLE) -> DataFrame:
    read_tsv(spark, tsv, schema).write.parquet(out)
    return spark.read.schema(schema).parquet(out)
