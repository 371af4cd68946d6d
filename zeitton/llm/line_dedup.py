"""Line dedup: repeated lines stay in one document only.

Lines are exploded, normalised and hashed; documents per hash are counted after a partial aggregate,
so that a line of a third of all documents reaches the shuffle as one row per task; lines over the
threshold go, and the rest is put together again by position. Repeated keys are stored, which leaves the join with
the lines free to split a hot key; a second join brings the dropped positions to their texts by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from zeitton.llm.text import ascii_lower, hash_pair, known_id, let, lines, stripped, whole
from zeitton.session import stage

DOC, POS, FIRST, LAST, DOCS = "__doc", "__pos", "__first", "__last", "__docs"
KEY = ["__key_a", "__key_b"]


def line_keys(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points: document, position, hash of the key."""
    exploded = df.select(known_id(id_col).alias(DOC), F.posexplode(lines(whole(text_col))).alias(POS, "__line"))
    exploded = exploded.select(DOC, POS, stripped(F.col("__line")).alias("__bare")).where(F.length("__bare") >= min_chars)
    a, b = hash_pair(F.col("__key"))
    return exploded.select(DOC, POS, ascii_lower(F.col("__bare")).alias("__key")).select(
        DOC, POS, a.alias(KEY[0]), b.alias(KEY[1])
    )


def repeated_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the smallest document id of each."""
    if min_docs == 2:  # two different documents are there if the smallest id is not the largest
        ends = keys.groupBy(*KEY).agg(F.min(DOC).alias(FIRST), F.max(DOC).alias(LAST))
        return ends.where(F.col(FIRST) < F.col(LAST)).drop(LAST)
    counted = keys.groupBy(*KEY, DOC).agg(F.lit(1).alias(DOCS)).groupBy(*KEY)
    counted = counted.agg(F.min(DOC).alias(FIRST), F.sum(DOCS).alias(DOCS))
    return counted.where(F.col(DOCS) >= min_docs).drop(DOCS)


def kept_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the positions of the array ``dropped``, which may be null."""
    rest = let(
        lines(text),
        lambda all_lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), dropped), lambda at: all_lines[at]
            ),
            "\n",
        ),
    )
    return F.when(dropped.isNull(), text).otherwise(rest)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Drop repeated lines from all documents but the one of the smallest id.

    The key of a line is the line with white space stripped at both ends and A-Z lower-cased. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines except
    in the document with the smallest id, which keeps every one of its own. A null or empty text is
    one empty line; rows of one id are one document, and a null id is the smallest id. All columns
    come back, the text cut; ``n_lines`` (before) and ``n_dropped`` are added or replace columns of
    those names. An empty table gives an empty table.
    """
    keys = line_keys(df, id_col, text_col, min_chars)
    dropped = (
        keys.join(stage(repeated_keys(keys, min_docs), "repeated-lines"), KEY)
        .where(F.col(DOC) > F.col(FIRST))
        .groupBy(DOC)
        .agg(F.collect_set(POS).alias("__dropped"))
    )
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("__row"), known_id(id_col).alias(DOC), whole(text_col).alias("__text"))
    joined = rows.join(dropped, DOC, "left")
    text, gone = F.col("__text"), F.col("__dropped")
    # Rows of one id may differ in length: positions past the end of a text are not its own.
    found = {
        "n_lines": F.size(lines(text)).cast("bigint"),
        "n_dropped": F.when(gone.isNull(), 0).otherwise(F.size(F.array_intersect(gone, F.sequence(F.lit(0), F.size(lines(text)) - 1)))).cast("bigint"),
    }
    others = [F.col("__row").getField(c).alias(c) for c in df.columns if c != text_col and c not in found]
    return joined.select(*others, kept_lines(text, gone).alias(text_col), *(v.alias(k) for k, v in found.items()))
