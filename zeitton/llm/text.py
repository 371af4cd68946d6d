"""Column expressions on texts that several operators share.

White space is ``[\\x20\\x09-\\x0D]`` throughout, a word is a longest run of other characters.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = " \t\n\x0b\x0c\r"
# Kinds of characters with a lower case, apart from A-Z.
OTHER_UPPER = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` does just that where no other character has a lower case; the rest is translated.
    """
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(OTHER_UPPER))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def lines(text: Column) -> Column:
    """The ``\\n``-separated lines; an empty text has one empty line."""
    return F.split(text, "\n")


def words(text: Column) -> Column:
    """The words. A split at one character needs no regular expression, so all white space becomes that one."""
    for other in SPACE[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs with different seeds, so that unequal values do not meet."""
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def known_id(name: str) -> Column:
    """A document id to compare by: a null id counts as the smallest."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-(2**63)))
