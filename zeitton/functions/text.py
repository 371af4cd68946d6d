"""Whitespace, words and fixed-size word chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space plus the four ASCII separators that text splitting also breaks on.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[^\s\x1c-\x1f]"
# The same characters one by one.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CHUNK_WORDS = 200


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row, whatever is done with it later.

    A filter on a plain computed column is pushed below it and computes it again; nothing is pushed
    below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def has_text(text: Column) -> Column:
    """True when there is at least one non-blank character; null counts as blank."""
    return F.coalesce(text.rlike(f"(?U){WORD}"), F.lit(False))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){WORD}++"), F.lit(0))


def chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """Texts of up to ``size`` words stay as they are; longer ones become runs of ``size`` words.

    One regex pass cuts the text, so the cost grows with its length, not with length times chunks.
    """
    pattern = f"(?U){WORD}++(?:{SPACE}++{WORD}++){{0,{size - 1}}}+"
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return bind(
        runs,
        lambda found: F.when(F.size(found) == 1, F.array(text)).otherwise(
            F.transform(found, lambda run: F.regexp_replace(run, f"(?U){SPACE}+", " "))
        ),
    )
