"""Stand-ins for the news tables, derived row by row from the given tables.

``orders`` serve as dated articles with a measure and as listing pages, ``events`` as scored rows,
``documents`` as article texts, archive pages and article pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Frequent words of the given texts, as the lexicon of the checked queries.
POSITIVE = (
    "the", "de", "to", "a", "la", "is", "it", "was", "die", "le", "as", "und", "et", "are", "re",
    "from", "les", "es", "nd", "rewh", "ou", "von", "st", "ed", "hehely", "ing", "tion",
)
NEGATIVE = (
    "of", "and", "in", "der", "that", "en", "for", "on", "with", "que", "be", "des", "by", "this",
    "er", "at", "an", "th", "un", "el", "ha", "den", "he", "orre", "thatin", "or", "ea",
)
DAYS = 1_000_000  # days of the archive, before days get more pages
GAP = 8  # place on a day that is empty, failed or missing on three of four days

# Section of a document by its language; anything else is a section of no category.
SECTION_OF = {"de": "Inland", "en": "ausland", "fr": "wirtschaft"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, scanned as it is stored."""
    return table(spark, sf_dir, name)


def first_words(text: Column, n: int) -> Column:
    return F.regexp_extract(text, rf"\S+(?:\s+\S+){{0,{n - 1}}}", 0)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: equal texts of one language share a link.

    The first three turns of a conversation, whole, are the short fields of an article.
    """
    section = F.coalesce(
        *(F.when(F.col("lang") == lang, name) for lang, name in SECTION_OF.items()), F.lit("sport")
    )
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("n_chars") % 700).cast("int"))
    talks = table(spark, sf_dir, "conversations")
    fields = ("headline", "short_headline", "short_text")
    turns = talks.groupBy("conv_id").agg(
        *(F.max(F.when(F.col("turn") == k, F.col("text"))).alias(name) for k, name in enumerate(fields))
    )
    count = talks.agg((F.max("conv_id") + 1).alias("n")).scalar()
    docs = texts(spark, sf_dir, "documents").withColumn("__conv", F.col("doc_id") % count)
    return docs.join(turns, F.col("__conv") == F.col("conv_id"), "left").select(
        "doc_id",
        F.date_format(day, "yyyy-MM-dd").alias("date_api"),
        F.ascii("source").cast("int").alias("page_api"),
        F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" • 09:05 Uhr")).alias("date"),
        *fields,
        F.concat(F.lit("/"), section, F.lit("/a-"), F.md5("text"), F.lit(".html")).alias("link"),
        F.col("text").alias("articleBody"),
        F.col("source").alias("description"),
    )


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page status: the priority number is the page of the order's day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderdate").cast("date").alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("page"),
    ).agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("n_links"),
        F.coalesce(F.max(F.col("o_totalprice") < 3000), F.lit(False)).alias("monthly_summary"),
        F.coalesce(F.max(F.col("o_totalprice") > 490000), F.lit(False)).alias("error"),
    )


def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON scores; each event type is one shape of well-formed or broken input."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.format_string('{"positive": %d, "negative": 0.25, "neutral": 0.5}', k))
        .when(kind == "view", F.format_string('{"negative": %d.5}', k))
        .when(kind == "signup", F.format_string('{"positive": null, "negative": %d}', k))
        .when(kind == "purchase", F.format_string('{"positive": "%d", "negative": 0.1}', k))
        .otherwise(F.format_string('{"positive": %d', k))
    )
    events = texts(spark, sf_dir, "events")
    return events.select("event_id", "ts", kind, k.alias("k"), text.alias("score"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def page_places(documents: DataFrame) -> DataFrame:
    """``documents`` with ``day``, ``page``, ``summary`` and ``state``, and rows for further pages.

    Ten documents fill a day, so days grow with ``doc_id``; after a million days the first day gets ten pages more, and so on,
    which keeps all days valid. On three of four days the pages from the eighth place on stand one further. The place so left is
    ``empty``, ``failed`` or missing; the first two are rows of their own, with nulls from ``documents``.
    """
    slot, number = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10)
    cycle, kind = F.floor(number / DAYS), number % 4
    moved = ((slot >= GAP - 1) | (cycle >= 1)) & (kind > 0)
    placed = documents.withColumns(
        {
            "day": F.date_add(F.lit("2024-01-01").cast("date"), (number % DAYS).cast("int")),
            "page": (slot + 1 + 10 * cycle + F.when(moved, 1).otherwise(0)).cast("int"),
            "summary": (F.col("lang") == "de") & (F.col("n_chars") % 40 == 0),
            "state": F.lit("full"),
        }
    )
    beside = documents.where((slot == GAP - 1) & (cycle == 0) & (number % 2 == 1)).select(
        F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int")).alias("day"),
        F.lit(GAP).alias("page"), F.lit(False).alias("summary"), F.when(kind == 1, "empty").otherwise("failed").alias("state"),
    )
    return placed.unionByName(beside, allowMissingColumns=True)


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive page per document with one teaser per line of its text, and empty and failed pages without an id."""
    lines = F.split("text", "\n")
    head = F.when(F.col("summary"), "Dezember 2024").otherwise("01. Dezember 2024")
    wrapper = '<div class="copytext-element-wrapper__vertical-only">'

    def teaser(line: Column, i: Column) -> Column:
        start = first_words(line, 3)
        rest = F.substr(line, F.length(start) + 1)
        link = F.concat(F.lit("/x/"), i.cast("string"))
        anchor = F.when(
            F.col("lang") == "fr", F.concat(F.lit('<a href="'), link, F.lit('" class="big teaser-right__link">'))
        ).otherwise(F.concat(F.lit('<a class="teaser-right__link" href="'), link, F.lit('">')))
        date = F.when(
            F.col("lang") != "es", F.lit('<div class="teaser-right__date"> 01.12.2024 • 09:05 Uhr </div>')
        ).otherwise(F.lit('<div class="teaser-right__date"></div>'))
        return F.concat(
            F.lit(wrapper), anchor, date,
            F.lit('<span class="teaser-right__labeltopline">'), escaped(start), F.lit("</span>"),
            F.lit('<span class="teaser-right__headline"><em>'), escaped(start), F.lit("</em>"),
            escaped(rest), F.lit('</span><p class="teaser-right__shorttext">\n'), escaped(line),
            F.lit(" <!-- end --></p></a></div>"),
        )

    def page(head: Column, teasers: Column) -> Column:
        return F.concat(
            F.lit('<html><body><h2 class="archive__headline">'), head, F.lit("</h2>"),
            F.lit('<div id="content">'), F.lit(wrapper + "a</div>"), F.lit(wrapper + "b</div>"),
            teasers, F.lit("</div>"), F.lit(wrapper + "outside the content</div></body></html>"),
        )

    state = F.col("state")
    full = page(head, F.array_join(F.transform(lines, teaser), ""))
    html = F.when(state == "full", full).when(state == "empty", page(F.lit("01. Dezember 2024"), F.lit("")))
    return page_places(texts(spark, sf_dir, "documents")).select("doc_id", "day", "page", html.alias("html"))


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article page per document; the language decides how the article is embedded."""
    item = F.struct(
        F.lit("NewsArticle").alias("@type"),
        F.col("text").alias("articleBody"),
        F.lit("2024-01-01T08:00:00").alias("datePublished"),
        F.lit("2024-01-02T08:00:00").alias("dateModified"),
        F.struct(F.lit("Person").alias("@type"), F.col("source").alias("name")).alias("author"),
        F.array("lang", "source").alias("keywords"),
    )
    body = F.to_json(item)
    other = F.lit('{"@type":"BreadcrumbList"}')
    start, stop = F.lit('<script type="application/ld+json">'), F.lit("</script>")
    blocks = (
        F.when(F.col("lang") == "en", F.concat(start, body, stop))
        .when(F.col("lang") == "de", F.concat(start, F.lit("["), other, F.lit(","), body, F.lit("]"), stop))
        .when(F.col("lang") == "fr", F.concat(start, F.lit("{bad"), stop, start, other, stop, start, body, stop))
        .otherwise(F.concat(start, other, stop))
    )
    html = F.concat(
        F.lit("<html><head>"), blocks, F.lit('</head><body><span class="label">no</span>'),
        F.lit('<span class="label label--standard-primary"> '), escaped(F.col("source")),
        F.lit(" </span></body></html>"),
    )
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("link"), html.alias("html")
    )


class WordModel:
    """The lexicon scorer as a Python model, with the interface of a pluggable one."""

    def __init__(self, positive=POSITIVE, negative=NEGATIVE):
        import regex

        self.letters = regex.compile(r"\p{L}+")
        self.positive, self.negative = frozenset(positive), frozenset(negative)

    def predict_sentiment(self, texts, output_probabilities=True):
        labels, rows = [], []
        for text in texts:
            found = self.letters.findall(text.lower())
            total = max(len(found), 1)
            pos = sum(w in self.positive for w in found)
            neg = sum(w in self.negative for w in found)
            shares = {"positive": pos / total, "negative": neg / total, "neutral": (total - pos - neg) / total}
            labels.append(max(shares, key=shares.get))
            rows.append([[name, share] for name, share in shares.items()])
        return (labels, rows) if output_probabilities else labels
