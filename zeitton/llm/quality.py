"""Quality rules: measures of each text, and lines that too many documents of a host share.

Measures are computed inside the row. Line counts need a distinct step (a document counts once per line)
and one sum per line and host, both with partial aggregates; the few lines above the limit, a share of the
host's documents, are stored, so that Spark knows their size when it chooses how to join them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from zeitton.functions.text import once
from zeitton.llm.line_dedup import kept_lines
from zeitton.llm.text import hash_pair, known_id, let, lines, stripped, whole, words
from zeitton.session import stage

SYMBOLS = "#*$%&|<>"
DOC, POS, BARE, HOST = "__doc", "__pos", "__bare", "__host"
TEXT, LINE = ["__text_a", "__text_b"], ["__line_a", "__line_b"]  # 128 bits each


def repeated_words(all_words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, each word once.

    Windows are hashed to 64 bits. Only a text with a repeated hash sorts its windows, so that equal
    ones stand side by side; the starts found cover three words each, less what the next one covers.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), at + 3) - at))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def starts_of(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, j: F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["at"]))

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, starts_of), covered)
        )

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(
            let(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - 3),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
                ),
                counted,
            )
        )

    return windows(all_words)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""

    def of_words(w: Column) -> Column:
        own = F.filter(lines(text), lambda line: stripped(line) != "")
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
            let(own, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    return let(words(text), of_words)


def host_lines(df: DataFrame, id_col: str, text_col: str, host_col: str, min_chars: int) -> DataFrame:
    """One row per line of at least ``min_chars`` of a known host: document, hash of its text, position, host, hash of the line."""
    text = whole(text_col)
    exploded = df.where(F.col(host_col).isNotNull()).select(
        known_id(id_col).alias(DOC),
        *(h.alias(name) for h, name in zip(hash_pair(text), TEXT, strict=True)),
        F.col(host_col).alias(HOST),
        F.posexplode(lines(text)).alias(POS, "__raw"),
    )
    bare = exploded.withColumn(BARE, stripped(F.col("__raw"))).where(F.length(BARE) >= min_chars)
    key = hash_pair(F.lower(BARE))
    return bare.select(DOC, *TEXT, POS, BARE, HOST, *(h.alias(name) for h, name in zip(key, LINE, strict=True)))


def common_lines(found: DataFrame, documents: DataFrame, min_docs: int, max_share_percent: float) -> DataFrame:
    """Lines above the limit of their host, with the smallest id that holds each.

    ``documents`` has the number of documents per host. Lines of few documents, nearly all, go before the hosts are joined.
    """
    counted = (
        found.groupBy(HOST, *LINE, DOC)
        .agg(F.lit(1).alias("__one"))
        .groupBy(HOST, *LINE)
        .agg(F.count("*").alias("__docs"), F.min(DOC).alias("__first"))
        .where(F.col("__docs") > min_docs)
    )
    above = 100 * F.col("__docs") > max_share_percent * F.col("__all")
    return counted.join(documents, HOST).where(above).select(HOST, *LINE, "__first")


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_chars: int = 10,
    min_docs: int = 5,
    max_share_percent: float = 10,
    max_removed_percent: int = 70,
) -> DataFrame:
    """All columns of ``df``, the text cut, with the measures, ``base_failed``, ``n_removed_words`` and ``kept``.

    A text fails the base with fewer than ``min_words`` words, or if more than ``max_repeat_percent``
    of its words are in repeated 3-word windows. The key of a line is the line stripped and
    lower-cased. Keys of at least ``min_chars`` code points are removed that stand in more than ``max_share_percent`` of the
    documents of a host and in more than ``min_docs`` of them, except from the document of the smallest id that holds them. Rows of one
    id are one document, copies under other ids are documents. A document that loses more than ``max_removed_percent`` of its words is depleted
    and rejected. The text comes back without the removed lines; the measures are those of the text before. Null text: empty in the measures, and
    back as it is; null host: no host, nothing is removed; null id: the smallest. New columns replace those of equal names.
    """
    found = host_lines(df, id_col, text_col, host_col, min_chars)
    held = df.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias(HOST), known_id(id_col).alias(DOC))
    documents = held.groupBy(HOST, DOC).agg(F.lit(1).alias("__one")).groupBy(HOST).agg(F.count("*").alias("__all"))
    common = stage(common_lines(found, stage(documents, "hosts"), min_docs, max_share_percent), "common-lines")
    losses = (
        found.join(common, [HOST, *LINE])
        .where(F.col(DOC) != F.col("__first"))
        .groupBy(DOC, *TEXT, POS)  # copies of a row lose a line once
        .agg(F.size(words(F.first(BARE))).alias("__words"))
        .groupBy(DOC, *TEXT)
        .agg(F.sum("__words").alias("__lost"), F.collect_list(POS).alias("__removed"))
    )
    text = whole(text_col)
    # The row is packed so that no name can clash, and filters on the measures do not repeat them.
    packed = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("__row"),
        known_id(id_col).alias(DOC),
        *(h.alias(name) for h, name in zip(hash_pair(text), TEXT, strict=True)),
        text.alias("__text"),
    )
    rows = once(packed, "__m", measures(F.col("__text"))).drop("__text")
    joined = rows.join(losses, [DOC, *TEXT], "left")
    m = F.col("__m")
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    lost = F.coalesce(F.col("__lost"), F.lit(0))
    depleted = 100 * lost > max_removed_percent * m["n_words"]
    new = {c: m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    new |= {"base_failed": failed, "n_removed_words": lost, "kept": ~failed & ~depleted}
    old = {c: F.col("__row").getField(c) for c in df.columns if c not in new}
    if text_col in old:
        old[text_col] = kept_lines(old[text_col], F.col("__removed"))
    return joined.select(*(v.alias(k) for k, v in (old | new).items()))
