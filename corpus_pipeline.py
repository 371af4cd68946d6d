"""Documents to training sequences: quality rules, line dedup, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from zeitton.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from zeitton.llm.queries import tokenizer_file
from zeitton.llm.text import stripped, table, whole
from zeitton.session import stage


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; ``n_chars`` counts the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(columns)


def with_words(docs: DataFrame) -> DataFrame:
    """Documents of which a cut left something: the others were copies through and through."""
    return docs.where(stripped(whole("text")) != "")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of a host share."""
    return recounted(quality.judge(docs).where("kept"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in one of them; documents without any other line go."""
    return with_words(recounted(line_dedup.dedup_lines(docs), docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; documents of nothing else go."""
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    return with_words(recounted(cut.select("row.*", F.col("kept").alias("text")), docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of documents in sequences of 4096 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("n-gram join", keep_one_of_each),
    ("suffix-array dedup", cut_passages),
    ("packing", pack),
]
ORACLE_SQL = None  # near-duplicates and ids of tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
