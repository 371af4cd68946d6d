"""Scoring of text fields with a native lexicon or a pluggable model.

Scoring is a narrow step: a row keeps its chunks as arrays, every chunk is scored in place and the
scores are combined in the same row. No text is exploded or shuffled, whatever its length.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Collection, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from zeitton.functions.sentiment import combine, lexicon_score, score_json
from zeitton.functions.text import CHUNK_WORDS, bind, chunks, has_text, once
from zeitton.operators.skew import join_split
from zeitton.schemas import CHUNK_SCORE, CLASSES, FIELDS
from zeitton.session import stage

# The batch functions below travel to the Python workers by value, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A small default lexicon.
POSITIVE_WORDS = (
    "gut", "besser", "beste", "erfolg", "erfolgreich", "freude", "frieden", "gewinn", "gewinnt",
    "hoffnung", "lob", "positiv", "rettung", "sicher", "stark", "wachstum", "good", "better", "best",
    "success", "joy", "peace", "hope", "gain", "growth", "safe", "strong", "win",
)
NEGATIVE_WORDS = (
    "schlecht", "schlechter", "angriff", "angst", "gewalt", "gefahr", "katastrophe", "krieg", "krise",
    "kritik", "negativ", "opfer", "schaden", "tod", "tote", "verlust", "bad", "worse", "worst",
    "attack", "fear", "violence", "danger", "war", "crisis", "loss", "dead", "death",
)

NESTED_SCORES = T.ArrayType(T.ArrayType(CHUNK_SCORE))


class Scorer(Protocol):
    def score(self, nested: Column) -> Column:
        """Map ARRAY<ARRAY<STRING>> (chunks per field) to scores of the same shape."""


class LexiconScorer:
    """Word-list scorer made of built-in expressions only."""

    def __init__(
        self,
        positive: Collection[str] = POSITIVE_WORDS,
        negative: Collection[str] = NEGATIVE_WORDS,
    ) -> None:
        self.positive, self.negative = tuple(positive), tuple(negative)

    def score(self, nested: Column) -> Column:
        return F.transform(
            nested,
            lambda field: F.transform(field, lambda c: lexicon_score(c, self.positive, self.negative)),
        )


class ModelScorer:
    """Any model with ``predict_sentiment(texts, output_probabilities=True)``.

    ``factory`` builds the model and runs once per task. Chunks of many rows go to the model
    together, ``batch_size`` at a time; if a batch fails its texts are tried one by one, and a text
    that fails alone gets no score.
    """

    def __init__(self, factory: Callable[[], object], batch_size: int = 64) -> None:
        self.factory, self.batch_size = factory, batch_size

    def score(self, nested: Column) -> Column:
        factory, batch_size = self.factory, self.batch_size

        @F.arrow_udf(NESTED_SCORES)
        def score_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = factory()
            for batch in batches:
                fields = batch.flatten()
                scores = predict(model, fields.flatten().to_pylist(), batch_size)
                inner = pa.ListArray.from_arrays(offsets(fields), scores)
                yield pa.ListArray.from_arrays(offsets(batch), inner)

        return score_batches(nested)


def offsets(lists: pa.Array) -> pa.Array:
    """Offsets of a list array counted from its own first element."""
    raw = lists.offsets.to_numpy()
    return pa.array(raw - raw[0], type=pa.int32())


def predict(model, texts: Sequence[str], batch_size: int) -> pa.StructArray:
    rows: list[dict | None] = []
    for start in range(0, len(texts), batch_size):
        part = list(texts[start : start + batch_size])
        try:
            rows.extend(call(model, part))
        except Exception:  # noqa: BLE001 - a model may raise anything; the text is then unscored
            for text in part:
                try:
                    rows.extend(call(model, [text]))
                except Exception:  # noqa: BLE001
                    rows.append(None)
    doubles = [pa.field(c, pa.float64()) for c in CLASSES]
    return pa.array(rows, type=pa.struct([pa.field("label", pa.string()), *doubles]))


def call(model, texts: list[str]) -> list[dict | None]:
    labels, probabilities = model.predict_sentiment(texts, output_probabilities=True)
    if len(labels) != len(texts) or len(probabilities) != len(texts):
        raise ValueError("the model returned another number of results than it got texts")
    rows: list[dict | None] = []
    for label, pairs in zip(labels, probabilities):
        found = {name: float(value) for name, value in pairs}
        known = label in CLASSES and set(found) <= set(CLASSES)
        rows.append({"label": label, **{c: found.get(c, 0.0) for c in CLASSES}} if known else None)
    return rows


def score_fields(
    df: DataFrame,
    scorer: Scorer,
    fields: Sequence[str] = FIELDS,
    size: int = CHUNK_WORDS,
    typed: bool = False,
) -> DataFrame:
    """Add ``<field>_sentiment_category`` and ``<field>_sentiment_score`` for each field.

    The score is JSON text, or a struct of three doubles when ``typed``. A field that the frame lacks
    is scored like a blank one.
    """
    no_chunks = F.array().cast("array<string>")
    parts = [
        F.when(has_text(F.col(f)), chunks(F.col(f), size)).otherwise(no_chunks)
        if f in df.columns
        else no_chunks
        for f in fields
    ]
    scored = scorer.score(F.array(*parts))
    if isinstance(scorer, LexiconScorer):
        combined = F.transform(scored, combine)
    else:
        combined = bind(scored, lambda s: F.transform(s, combine))
    result = once(df, "__scored", combined)
    columns = {}
    for i, f in enumerate(fields):
        one = F.get(F.col("__scored"), i)
        columns[f"{f}_sentiment_category"] = one["category"]
        columns[f"{f}_sentiment_score"] = one["score"] if typed else score_json(one["score"])
    return result.withColumns(columns).drop("__scored")


def score_once(df: DataFrame, scorer: Scorer, store: str, fields: Sequence[str] = FIELDS, size: int = CHUNK_WORDS) -> DataFrame:
    """``score_fields`` with every distinct chunk scored once, over all runs that share the folder ``store``.

    Chunks are known by a 128-bit hash. Those without a stored score go to the scorer, sorted by length so that a batch holds texts of
    a kind, and their scores are added to the store; chunks that fail are tried again by the next run. The scores
    then meet the rows' hashes, a chunk that very many rows share in parts, and the rows in one last join.
    """
    spark = df.sparkSession
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "to-score")
    none = F.array().cast("array<string>")
    there = [f for f in fields if f in df.columns]
    parts = F.array(*(F.when(has_text(F.col(f)), chunks(F.col(f), size)).otherwise(none) for f in there))
    cut = rows.select("__row", F.posexplode(parts).alias("field", "__chunks")).select("__row", "field", F.posexplode("__chunks").alias("no", "chunk"))
    key = F.struct(*(F.xxhash64(F.lit(seed), "chunk").alias(f"h{seed}") for seed in (1, 2)))
    pieces = stage(cut.withColumn("key", key), "chunks")
    known = stored_scores(spark, store)
    new = pieces.select("key", "chunk").join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("chunk").alias("chunk"))
    scored = new.repartition("key").sortWithinPartitions(F.length("chunk")).withColumn("score", F.get(F.get(scorer.score(F.array(F.array("chunk"))), 0), 0))
    found = once(scored.select("key", "score"), "__s", F.col("score")).where(F.col("__s.label").isNotNull())
    fresh = stage(found.select("key", F.col("__s").alias("score")), "new-scores")
    met = join_split(pieces.select("__row", "field", "no", "key"), stage(known.unionByName(fresh), "scores"), "key", "left")
    fresh.write.mode("append").parquet(store)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("no", "score"))), lambda s: s["score"])
    texts = met.groupBy("__row", "field").agg(in_order.alias("scores"))
    empty = F.array().cast(NESTED_SCORES.elementType)
    by_row = texts.groupBy("__row").agg(*(F.max(F.when(F.col("field") == i, F.col("scores"))).alias(f"__{f}") for i, f in enumerate(there)))
    joined = rows.join(by_row, "__row", "left").drop("__row")
    columns = {}
    for f in fields:
        own = combine(F.coalesce(F.col(f"__{f}"), empty) if f in there else empty)
        columns |= {f"{f}_sentiment_category": own["category"], f"{f}_sentiment_score": score_json(own["score"])}
    return joined.withColumns(columns).drop(*(f"__{f}" for f in there))


def stored_scores(spark: SparkSession, store: str) -> DataFrame:
    """One score per chunk of a store, which two runs at a time may both have scored."""
    schema = T.StructType([T.StructField("key", T.StructType([T.StructField(h, T.LongType()) for h in ("h1", "h2")])), T.StructField("score", CHUNK_SCORE)])
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store).groupBy("key").agg(F.min("score").alias("score"))


def chunk_scores(df: DataFrame, key: str, text: str, scorer: Scorer, size: int = CHUNK_WORDS) -> DataFrame:
    """One row per chunk: key, chunk number from 0, chunk text and its score."""
    parts = F.when(has_text(F.col(text)), chunks(F.col(text), size))
    held = df.select(key, parts.alias("__chunks")).where(F.col("__chunks").isNotNull())
    zipped = F.arrays_zip(F.col("__chunks").alias("chunk"), F.col("__one").alias("score"))
    return (
        held.withColumn("__all", scorer.score(F.array("__chunks")))
        .withColumn("__one", F.get("__all", 0))
        .select(key, F.posexplode(zipped).alias("chunk_no", "__row"))
        .select(key, "chunk_no", F.col("__row.chunk").alias("chunk"), F.col("__row.score").alias("score"))
    )


def category_counts(df: DataFrame, fields: Sequence[str] = FIELDS, strict: bool = False) -> DataFrame:
    """Rows per field and class. Unknown classes count as neutral, or not at all when ``strict``."""
    names = [f"{f}_sentiment_category" for f in fields if f"{f}_sentiment_category" in df.columns]
    pairs = F.array(
        *(F.struct(F.lit(n.removesuffix("_sentiment_category")).alias("field"), F.col(n).alias("category")) for n in names)
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.field", "p.category")
    if strict:
        long = long.where(F.col("category").isin(*CLASSES))
    else:
        known = F.col("category").isin("positive", "negative")
        long = long.withColumn("category", F.when(known, F.col("category")).otherwise("neutral"))
    return long.groupBy("field", "category").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(earlier: DataFrame, new: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Counts over earlier output (exact classes only) plus new rows, added up."""
    both = category_counts(earlier, fields, strict=True).unionByName(category_counts(new, fields))
    return both.groupBy("field", "category").agg(F.sum("n").alias("n"))
