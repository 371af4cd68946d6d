"""Declared schemas, one per table layer."""

from pyspark.sql import types as T

FIELDS = ("headline", "short_headline", "short_text", "articleBody")
CLASSES = ("positive", "negative", "neutral")

TEXT, INT, LONG, DAY, NUMBER = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.DoubleType()


def table_of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def extended(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


RAW_PAGE = table_of(page_id=LONG, url=TEXT, html=TEXT)
ARCHIVE_PAGE = table_of(day=DAY, page=INT, html=TEXT)
ARTICLE_PAGE = table_of(link=TEXT, html=TEXT)
FAILED_DAY = table_of(day=DAY, page=INT, rest=TEXT)

LISTING = table_of(
    date_api=TEXT, page_api=INT, date=TEXT, headline=TEXT, short_headline=TEXT, short_text=TEXT, link=TEXT
)
# Text form of an article, as exchanged in tab-separated files: author and taglist are JSON text.
ARTICLE = T.StructType(
    LISTING.fields
    + table_of(
        label=TEXT, articleBody=TEXT, datePublished=TEXT, author=TEXT, description=TEXT, taglist=TEXT
    ).fields
)
ARTICLE_SENTIMENT = T.StructType(
    ARTICLE.fields
    + [T.StructField(f"{field}_sentiment_{part}", TEXT) for field in FIELDS for part in ("category", "score")]
)
DROPPED_BY_CLEANING = ("page_api", "short_headline", "articleBody", "description")
ARTICLE_POLARITY = T.StructType(
    [
        T.StructField(f.name, T.TimestampNTZType() if f.name == "date" else f.dataType)
        for f in ARTICLE_SENTIMENT.fields
        if f.name not in DROPPED_BY_CLEANING
    ]
    + [T.StructField(f"{field}_polarity", NUMBER) for field in FIELDS]
)

# One row per batch of articles: counts, and sketches of distinct days and links.
STATISTICS = table_of(articles=LONG, days=T.BinaryType(), links=T.BinaryType(), new_links=LONG, batch_id=LONG)

PROBABILITIES = table_of(**{c: NUMBER for c in CLASSES})
CHUNK_SCORE = table_of(label=TEXT, **{c: NUMBER for c in CLASSES})
