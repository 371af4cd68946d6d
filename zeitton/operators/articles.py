"""Article pages to article fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from zeitton.functions.html import attribute_pattern, element_text, tokens, without_comments, without_hidden
from zeitton.functions.text import bind, once
from zeitton.operators.dataset import located
from zeitton.operators.skew import HOT_ROWS, join_split

# The markup of an article page.
LABEL_CLASS = "label label--standard-primary"
DATA_TYPE = "application/ld+json"
ARTICLE_TYPE = "NewsArticle"


def data_blocks(html: Column) -> Column:
    """Contents of all embedded JSON-LD scripts outside comments, in page order."""
    pattern = rf"(?is)<script(?=[\s>/]){attribute_pattern('type', DATA_TYPE)}[^>]*>(.*?)</script\s*>"
    return F.regexp_extract_all(without_comments(html), F.lit(pattern), F.lit(1))


def _is_article(value: Column) -> Column:
    return F.try_variant_get(value, "$['@type']", "string") == ARTICLE_TYPE


def _candidate(block: Column) -> Column:
    """A block as ``(article, as_object)``; ``article`` is null when the block holds none."""

    def pick(value: Column) -> Column:
        items = value.try_cast("array<variant>")
        from_list = F.try_element_at(F.filter(items, _is_article), F.lit(1))
        as_object = F.coalesce(_is_article(value), F.lit(False))
        return F.struct(
            F.when(as_object, value).otherwise(from_list).alias("article"), as_object.alias("as_object")
        )

    return bind(F.try_parse_json(block), pick)


def news_article(html: Column) -> Column:
    """The winning article of a page: the first one given as an object, else the last one found in a
    list (of each list its first)."""
    found = F.filter(F.transform(data_blocks(html), _candidate), lambda c: c["article"].isNotNull())

    def winner(candidates: Column) -> Column:
        first_object = F.get(F.filter(candidates, lambda c: c["as_object"]), 0)
        return F.coalesce(first_object, F.try_element_at(candidates, F.lit(-1)))

    return bind(found, winner)


def _text(article: Column, key: str) -> Column:
    """Text of a key: as it is when it is text, as JSON otherwise, ``""`` when missing or null."""
    return F.coalesce(F.try_variant_get(article, f"$.{key}", "string"), F.lit(""))


def _names(article: Column) -> Column:
    """Author names from text, an object with a name, or a list of either."""

    def one(value: Column) -> Column:
        named = F.try_variant_get(value, "$.name", "string")
        plain = F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string"))
        return F.coalesce(named, plain)

    value = F.try_variant_get(article, "$.author", "variant")
    many = F.transform(value.try_cast("array<variant>"), one)
    names = F.coalesce(many, F.array(one(value)))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def _tags(article: Column) -> Column:
    """Keywords as an array of text; a single text is an array of one."""
    listed = F.try_variant_get(article, "$.keywords", "array<string>")
    single = F.array(F.try_variant_get(article, "$.keywords", "string"))
    present = F.schema_of_variant(F.try_variant_get(article, "$.keywords", "variant"))
    return F.when(present.isNull() | (present == "VOID"), F.array().cast("array<string>")).otherwise(
        F.coalesce(listed, single)
    )


def article_label(html: Column) -> Column:
    page = tokens(without_hidden(html))
    return bind(page, lambda p: element_text(p, "span", attribute_pattern("class", LABEL_CLASS)))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Article fields of pages ``(link, html)``, one row per page that has text.

    A page without an article block keeps its row, with nulls and ``has_article`` false. Both dates
    are kept; ``datePublished`` repeats the established output: the modification date for articles
    given as an object, the publication date for those found in a list.
    """
    html = F.col("html")
    held = once(pages.where(html.isNotNull()), "__found", news_article(html))
    held = held.withColumn("__label", article_label(html))
    article, there = F.col("__found.article"), F.col("__found.article").isNotNull()
    published, modified = _text(article, "datePublished"), _text(article, "dateModified")
    when = F.when(F.col("__found.as_object"), modified).otherwise(published)
    fields = {
        "articleBody": _text(article, "articleBody"),
        "datePublished": when,
        "author": _text(article, "author"),
        "description": _text(article, "description"),
        "taglist": _tags(article),
        "author_names": _names(article),
        "date_published": published,
        "date_modified": modified,
    }
    return held.select(
        "link",
        F.col("__label").alias("label"),
        *(F.when(there, value).alias(name) for name, value in fields.items()),
        there.alias("has_article"),
    )


def one_per_link(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The articles with their places, and per link the place of one row: of several copies one with an article."""
    return located(articles.withColumn("__empty", ~F.col("has_article")), "link", ["__empty"])


def with_articles(listings: DataFrame, articles: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Listing rows with the fields of their article page; rows without a fetched page are left out.

    Each listing row meets one article, however often its page was stored. Empty links have no page
    of their own and go before the join; links listed very often are shared among tasks. Listing rows meet
    the places of articles first, and the articles themselves, bodies included, in the last join.
    """
    stored, places = one_per_link(articles)
    met = join_split(listings.where(F.col("link") != ""), places, "link", "inner", hot_rows)
    fields = [c for c in articles.columns if c != "link"]
    joined = join_split(met, stored.select("__at", *fields), "__at", "inner", hot_rows)
    return joined.select(*listings.columns, *fields)


def fetch_status(pages: DataFrame) -> DataFrame:
    """Pages per outcome: no text, text without an article, article."""
    status = (
        F.when(F.col("html").isNull(), "failed")
        .when(news_article(F.col("html")).isNull(), "no_article")
        .otherwise("article")
    )
    return pages.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def exchange_form(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for tab-separated files."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return reduce(lambda d, n: d.withColumn(n, F.to_json(F.col(n))), nested, df)
