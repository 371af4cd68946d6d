"""The operators of this folder as queries over whole tables, under production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from zeitton.llm import (
    chat, embedding_dedup, fingerprints, hard_negatives, line_dedup, ngram_join, packing, periodic_runs, pieces, quality, sharding, suffix_dedup, url_filter,
)
from zeitton.llm.text import let, stripped, table, whole, words

# The rules of the url query, and its added conversation.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
ADDED = "</s>[INST] ok [/INST]"

def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text that decoding gives back."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.decode_documents(pieces.encode_documents(docs, model).drop("text"), model)
    return back.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).drop("text", "source")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(encoded, F.lit(b""))).alias("text_crc32"),
    )
    return sharding.shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a log of drafts, deltas, edits and regenerations, folded, rendered and read back."""
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = chat.fold_events(chat.streamed_log(rows))
    return chat.digests(chat.read_back(chat.render(messages)))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("h1", "h2")


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text; for about every tenth id its words from some place on repeat the first ones from there."""

    def edited(h: Column, w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = F.pmod(g, n)
        period = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        return let(
            F.struct(w.alias("w"), a.alias("a"), period.alias("p")),
            lambda v: F.array_join(
                F.transform(v["w"], lambda x, i: F.when(i < v["a"], x).otherwise(F.get(v["w"], (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))),
                " ",
            ),
        )

    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (stripped(text) != ""), let(words(text), lambda w: edited(h, w))).otherwise(text)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the one of the greatest exponent, and digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(whole("text"), F.col("doc_id")).alias("text"))
    runs = F.col("runs")
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate(runs, F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>"), longer)
    shown = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return periodic_runs.periodic_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.edited_and_next(docs).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole_numbers = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").where(finite)
    given = rows.select("vec_id", moved.alias("label"), whole_numbers.alias("vector"))
    return hard_negatives.mine(given, "vec_id", "vector", "label", F.col("vec_id") % 100 == 0)
