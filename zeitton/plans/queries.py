"""Every operator as a query over the given tables. Each entry takes a session and a table folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from zeitton.functions import dates, html as markup, polarity, sentiment, text as words
from zeitton.functions.category import infer_category
from zeitton.operators import articles, calendar, correlogram, dataset, listings, segments, series, sketches
from zeitton.operators.scoring import (
    LexiconScorer,
    ModelScorer,
    category_counts,
    chunk_scores,
    merged_counts,
    score_fields,
    score_once,
)
from zeitton.plans import inputs, jobs
from zeitton.plans.inputs import NEGATIVE, POSITIVE, table, texts
from zeitton.schemas import CLASSES, FIELDS, LISTING
from zeitton.session import run_folder
from zeitton.sources import articles as article_files, links, pages
from zeitton.streaming import jobs as streams

cloudpickle.register_pickle_by_value(sys.modules[inputs.__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEXICON = LexiconScorer(POSITIVE, NEGATIVE)
FILE_PAGES = 2_000  # pages that a landed file holds, about
PRICE, ORDER_DAY, STATUS = "o_totalprice", "o_orderdate", "o_orderstatus"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: Column | str) -> Column:
    """Six decimals. The small shift decides ties, as in a mean of cents over 32 rows, which would
    otherwise depend on the order of summation; the last term removes negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(1e-9), 6) + F.lit(0.0)


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# --- resampling -------------------------------------------------------------------------------


def _resample(agg_func: str, freq: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = series.aggregate_sentiment(table(spark, sf_dir, "orders"), ORDER_DAY, PRICE, agg_func, freq)
        return rounded(out, f"{PRICE}_{agg_func}")

    run.__name__ = f"resample_{agg_func}_{freq.lower()}"
    return run


for _agg in series.AGGREGATES:
    for _freq in dates.FREQUENCIES:
        query(_resample(_agg, _freq))


@query
def date_range_filter(spark, sf_dir):
    return series.in_range(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-20").select(
        "event_id", "value"
    )


@query
def category_filter(spark, sf_dir):
    out = series.preprocessed(inputs.articles(spark, sf_dir))
    return series.filter_by_category(out, "inland").select("doc_id", "link", "inferred_category")


@query
def number_coercion(spark, sf_dir):
    """Text measures, bad numbers to null, rows with any null measure left out for all measures."""
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k"))
    df = table(spark, sf_dir, "events").select("ts", text.alias("a"), k.alias("b"))
    return rounded(series.resampled(df, "ts", ["a", "b"], "mean", "D"), "a_mean", "b_mean")


@query
def aggregate_sentiment(spark, sf_dir):
    out = series.aggregate_sentiment(
        table(spark, sf_dir, "orders"), ORDER_DAY, [PRICE, "o_custkey"], "median", "M",
        "1994-06-01", "1998-08-15", "ffill",
    )
    return rounded(out, f"{PRICE}_median", "o_custkey_median")


@query
def category_series_mean(spark, sf_dir):
    out = series.category_series(
        table(spark, sf_dir, "orders"), ORDER_DAY, [PRICE, "o_custkey"], "mean", "M", "o_orderpriority"
    )
    return rounded(out, f"{PRICE}_mean", "o_custkey_mean")


@query
def category_series_median(spark, sf_dir):
    out = series.category_series(
        table(spark, sf_dir, "orders"), ORDER_DAY, [PRICE, "o_custkey"], "median", "W", "o_orderpriority"
    )
    return rounded(out, f"{PRICE}_median", "o_custkey_median")


@query
def category_series_bounded(spark, sf_dir):
    """Regular series of all categories inside bounds, by every aggregate and way with gaps."""
    orders, parts = table(spark, sf_dir, "orders"), []
    for how in ("fill", "ffill", "drop"):
        for agg in series.AGGREGATES:
            out = series.category_series(
                orders, ORDER_DAY, [PRICE], agg, "M", "o_orderpriority", "1994-06-01", "2003-08-15", how
            )
            parts.append(
                out.select(F.lit(how).alias("how"), F.lit(agg).alias("agg"), "category", "period_end", r6(f"{PRICE}_{agg}").alias("v"))
            )
    return reduce(DataFrame.unionByName, parts)


# --- gaps -------------------------------------------------------------------------------------


def _gaps(name: str, how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = series.aggregate_sentiment(
            table(spark, sf_dir, "orders"), ORDER_DAY, PRICE, "mean", "D",
            "1994-12-20", "2001-08-10", how, [STATUS],
        )
        return rounded(out, f"{PRICE}_mean")

    run.__name__ = name
    query(run)


_gaps("spine_reindex", "fill")
_gaps("ffill", "ffill")
_gaps("drop_missing", "drop")


@query
def observed_spine(spark, sf_dir):
    """Absent weeks between the first and last one observed, per status and priority."""
    out = series.aggregate_sentiment(
        table(spark, sf_dir, "orders"), ORDER_DAY, PRICE, "mean", "W", keys=[STATUS, "o_orderpriority"]
    )
    return rounded(out, f"{PRICE}_mean")


@query
def period_spines(spark, sf_dir):
    """All day, week and month labels inside the observed range."""
    day = F.col(ORDER_DAY).cast("date")
    ends = table(spark, sf_dir, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    kinds = [
        F.struct(F.lit(f).alias("freq"), dates.range_spine(F.col("a"), F.col("b"), f).alias("labels"))
        for f in dates.FREQUENCIES
    ]
    return ends.select(F.explode(F.array(*kinds)).alias("s")).select(
        "s.freq", F.explode("s.labels").alias("period_end")
    )


# --- correlograms -----------------------------------------------------------------------------


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return series.aggregate_sentiment(orders, ORDER_DAY, PRICE, "mean", "W", keys=[STATUS])


@query
def acf(spark, sf_dir):
    out = correlogram.acf(_weekly(spark, sf_dir), [STATUS], 40, f"{PRICE}_mean")
    return rounded(out, "acf").withColumn("lag", big("lag"))


@query
def acf_of_segments(spark, sf_dir):
    """The same ACF from stored summaries of the series' years, written in two batches."""
    path, weekly = run_folder(spark, "segments"), _weekly(spark, sf_dir).withColumn("segment", F.year("period_end"))
    for batch, some in enumerate((F.col("segment") % 2 == 0, F.col("segment") % 2 == 1)):
        pieces = segments.summaries(weekly.where(some), [STATUS], "segment", 40, f"{PRICE}_mean", shift=150_000.0)
        article_files.append_batch(pieces, path, batch)
    whole = segments.whole_series(spark.read.parquet(path), [STATUS], 40)
    return rounded(segments.acf_of_summary(whole, [STATUS]), "acf").withColumn("lag", big("lag"))


@query
def pacf(spark, sf_dir):
    out = correlogram.pacf(_weekly(spark, sf_dir), [STATUS], 40, f"{PRICE}_mean")
    return rounded(out, "pacf").withColumn("lag", big("lag"))


@query
def lag_pairs(spark, sf_dir):
    out = correlogram.lag_pairs(_weekly(spark, sf_dir), [STATUS], 5, f"{PRICE}_mean")
    return rounded(out, "x", "lagged").withColumns({"lag": big("lag"), "at": big("at")})


@query
def acf_by_category(spark, sf_dir):
    wide = series.category_series(
        table(spark, sf_dir, "orders"), ORDER_DAY, [PRICE, "o_custkey"], "mean", "M", "o_orderpriority"
    )
    long = series.trend_long(wide, ["category"])
    out = correlogram.correlogram(long, ["category", "measure"], 24)
    return rounded(out, "acf", "pacf").withColumn("lag", big("lag"))


@query
def trend_long(spark, sf_dir):
    wide = series.aggregate_sentiment(
        table(spark, sf_dir, "orders"), ORDER_DAY, [PRICE, "o_custkey"], "mean", "M"
    )
    return rounded(series.trend_long(wide), "value")


@query
def series_head(spark, sf_dir):
    wide = series.aggregate_sentiment(table(spark, sf_dir, "orders"), ORDER_DAY, PRICE, "median", "M")
    return rounded(series.head(wide, 10), f"{PRICE}_median")


@query
def worked_example(spark, sf_dir):
    """Category filter, range, monthly median on the full spine, then ACF and PACF up to lag 53."""
    rows = series.filter_by_category(table(spark, sf_dir, "orders"), "F", STATUS)
    wide = series.aggregate_sentiment(
        rows, ORDER_DAY, [PRICE, "o_custkey"], "median", "M", "1990-01-01", "2002-03-01", "fill"
    )
    out = correlogram.correlogram(series.trend_long(wide), ["measure"], 53)
    return rounded(out, "acf", "pacf").withColumn("lag", big("lag"))


# --- polarity and dates -----------------------------------------------------------------------


@query
def polarity_json(spark, sf_dir):
    value = polarity.json_polarity(F.col("score"))
    return inputs.score_texts(spark, sf_dir).select("event_id", r6(value).alias("polarity"))


@query
def polarity_series(spark, sf_dir):
    rows = inputs.score_texts(spark, sf_dir).withColumn("polarity", polarity.json_polarity(F.col("score")))
    out = series.aggregate_sentiment(rows, "ts", "polarity", "median", "D", keys=["event_type"])
    return rounded(out, "polarity_median")


@query
def parse_german_date(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_type")
    raw = (
        F.when(kind == "click", F.date_format(ts, "dd.MM.yyyy • HH:mm 'Uhr'"))
        .when(kind == "view", F.date_format(ts, "d.M.yyyy • H:m 'Uhr'"))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "purchase", F.date_format(ts, "dd.MM.yyyy HH:mm"))
        .otherwise(F.date_format(ts, "'41.'MM.yyyy • HH:mm 'Uhr'"))
    )
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    df = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return df.select(
        "event_id",
        shown(dates.german_timestamp(F.col("raw"))).alias("strict"),
        shown(dates.lenient_timestamp(F.col("raw"))).alias("lenient"),
    )


# --- categories -------------------------------------------------------------------------------


@query
def infer_category_pages(spark, sf_dir):
    category = infer_category(F.col("url"), ("en", "es", "de"))
    return table(spark, sf_dir, "pages").select("page_id", category.alias("category"))


@query
def infer_category_articles(spark, sf_dir):
    return inputs.articles(spark, sf_dir).select("doc_id", infer_category(F.col("link")).alias("category"))


@query
def category_sizes(spark, sf_dir):
    out = series.preprocessed(inputs.articles(spark, sf_dir))
    return out.groupBy("inferred_category").agg(F.count(F.lit(1)).alias("n"))


# --- chunks and scores ------------------------------------------------------------------------


@query
def chunk_counts(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words.words(text)).cast("bigint").alias("n_words"),
        F.size(words.chunks(text)).cast("bigint").alias("n_chunks"),
        words.has_text(text).alias("has_text"),
    )


@query
def chunk_text(spark, sf_dir):
    parts = F.posexplode(words.chunks(F.col("text")))
    out = texts(spark, sf_dir, "documents").select("doc_id", parts.alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", big("chunk_no"))


@query
def lexicon_chunk_scores(spark, sf_dir):
    out = chunk_scores(texts(spark, sf_dir, "documents"), "doc_id", "text", LEXICON)
    return out.select(
        "doc_id", big("chunk_no"), F.col("score.label").alias("label"),
        *(r6(f"score.{c}").alias(c) for c in CLASSES),
    )


def _one_field(df: DataFrame, scorer) -> DataFrame:
    out = score_fields(df.select("doc_id", F.col("text")), scorer, ["text"], typed=True)
    return out.select(
        "doc_id", F.col("text_sentiment_category").alias("category"),
        *(r6(f"text_sentiment_score.{c}").alias(c) for c in CLASSES),
    )


@query
def doc_sentiment(spark, sf_dir):
    return _one_field(texts(spark, sf_dir, "documents"), LEXICON)


@query
def model_sentiment(spark, sf_dir):
    return _one_field(texts(spark, sf_dir, "documents"), ModelScorer(inputs.WordModel))


@query
def scored_once(spark, sf_dir):
    """Documents scored by a model in two runs that share their scores: equal chunks go to the model once."""
    store, docs = run_folder(spark, "chunk-scores"), texts(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [score_once(part, ModelScorer(inputs.WordModel), store, ["text"]) for part in (docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0"))]
    out = parts[0].unionByName(parts[1])
    return out.select(
        "doc_id", F.col("text_sentiment_category").alias("category"),
        r6(polarity.json_polarity(F.col("text_sentiment_score"))).alias("polarity"),
    )


def _scored(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    return score_fields(inputs.articles(spark, sf_dir), LEXICON, FIELDS, typed=typed)


@query
def field_sentiment_wide(spark, sf_dir):
    out = _scored(spark, sf_dir, typed=True)
    columns = []
    for f in FIELDS:
        columns.append(F.col(f"{f}_sentiment_category"))
        columns.append(r6(polarity.typed_polarity(F.col(f"{f}_sentiment_score"))).alias(f"{f}_polarity"))
    return out.select("doc_id", *columns)


@query
def sentiment_counts(spark, sf_dir):
    return category_counts(_scored(spark, sf_dir))


@query
def counts_with_seed(spark, sf_dir):
    """Counts of an earlier output (the labelled documents) carried on over the remaining ones."""
    scored = _scored(spark, sf_dir).select("doc_id", *(f"{f}_sentiment_category" for f in FIELDS))
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    earlier = scored.join(done, "doc_id", "left_semi")
    return merged_counts(earlier, scored.join(done, "doc_id", "left_anti"))


@query
def score_json_round_trip(spark, sf_dir):
    out = score_fields(texts(spark, sf_dir, "documents").select("doc_id", "text"), LEXICON, ["text"])
    return out.select("doc_id", r6(polarity.json_polarity(F.col("text_sentiment_score"))).alias("polarity"))


@query
def chunk_means(spark, sf_dir):
    """Combination of chunk scores in long form: mean per document, rescaled, strongest class."""
    long = chunk_scores(texts(spark, sf_dir, "documents"), "doc_id", "text", LEXICON)
    means = long.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.struct(*(F.avg(f"score.{c}").alias(c) for c in CLASSES)).alias("mean"),
    )
    out = means.withColumn("scaled", sentiment.normalised(F.col("mean")))
    return out.select(
        "doc_id", "n_chunks", sentiment.strongest(F.col("scaled")).alias("category"),
        *(r6(f"scaled.{c}").alias(c) for c in CLASSES),
    )


@query
def clean_articles(spark, sf_dir):
    out = jobs.clean(_scored(spark, sf_dir))
    return out.select(
        "doc_id", "link", "headline", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"),
        *(r6(f"{f}_polarity").alias(f"{f}_polarity") for f in FIELDS),
    )


@query
def rejected_dates(spark, sf_dir):
    late = F.when(F.col("description").endswith("7"), F.lit("unbekannt")).otherwise(F.col("date"))
    return jobs.date_rejects(inputs.articles(spark, sf_dir).withColumn("date", late))


@query
def article_polarity_series(spark, sf_dir):
    """Texts to scores to polarity to a monthly median series per category."""
    cleaned = jobs.clean(_scored(spark, sf_dir))
    rows = series.preprocessed(cleaned, "date")
    out = series.category_series(rows, "date", ["articleBody_polarity", "headline_polarity"], "median", "M")
    return rounded(out, "articleBody_polarity_median", "headline_polarity_median")


@query
def article_correlogram(spark, sf_dir):
    """Texts to scores to polarity to the correlogram of one category."""
    cleaned = jobs.clean(_scored(spark, sf_dir))
    _, out = jobs.correlate(
        cleaned, category="ausland", freq="W",
        measures=("articleBody_polarity", "headline_polarity"),
        start_date="2023-01-01", end_date="2024-11-30", nlags=20,
    )
    return rounded(out, "acf", "pacf").withColumn("lag", big("lag"))


# --- calendars and worklists ------------------------------------------------------------------


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col(ORDER_DAY).cast("date").alias("day"))


@query
def month_groups(spark, sf_dir):
    out = calendar.month_groups(_order_days(spark, sf_dir))
    days = F.array_join(F.transform("days", lambda d: F.date_format(d, "dd")), ",")
    return out.select(big("year"), big("month"), "label", days.alias("days"))


@query
def archive_urls(spark, sf_dir):
    days = calendar.observed_days(table(spark, sf_dir, "orders"), ORDER_DAY)
    url = listings.archive_url(F.col("day"), F.lit(1), "https://news.example.org")
    return days.select("day", url.alias("url"))


def _failed(flags: DataFrame) -> DataFrame:
    return flags.where("error").select("day", "page")


@query
def backfill_days(spark, sf_dir):
    out = calendar.backfill_days(_failed(inputs.page_flags(spark, sf_dir)))
    return out.select("day", big("start_page"))


@query
def start_page_filter(spark, sf_dir):
    flags = inputs.page_flags(spark, sf_dir)
    out = calendar.from_start_page(flags, calendar.backfill_days(_failed(flags)))
    return out.select("day", big("page"), "n_links")


@query
def page_takewhile(spark, sf_dir):
    out = calendar.pages_until_stop(inputs.page_flags(spark, sf_dir))
    return out.select("day", big("page"), "n_links")


@query
def page_gap_stop(spark, sf_dir):
    """Every third day lacks its second page, so nothing behind that is reached."""
    lost = (F.dayofmonth("day") % 3 == 0) & (F.col("page") == 2)
    out = calendar.pages_until_stop(inputs.page_flags(spark, sf_dir).where(~lost))
    return out.select("day", big("page"), "n_links")


@query
def month_cutoff(spark, sf_dir):
    kept = calendar.pages_until_stop(inputs.page_flags(spark, sf_dir))
    return calendar.days_until_summary(kept).select("day", big("page"), "n_links")


@query
def missing_days(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    held = orders.where(F.col(STATUS) == "F").select(F.col(ORDER_DAY).cast("date").alias("day"))
    return calendar.missing_days(calendar.observed_days(orders, ORDER_DAY), held)


@query
def failed_day_lines(spark, sf_dir):
    """Text lines of failed days parsed; one event type per shape of line."""
    day, kind = F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(day, F.lit(";2;timeout;x")))
        .when(kind == "view", F.concat(day, F.lit(";3")))
        .when(kind == "signup", F.concat(day, F.lit(";x")))
        .otherwise(F.lit("kein Tag;1"))
    )
    lines = table(spark, sf_dir, "events").select(line.alias("value"))
    out = pages.parse_failed_days(lines)
    return out.groupBy("day", "page", "rest").agg(F.count(F.lit(1)).alias("n")).select(
        "day", big("page"), "rest", "n"
    )


# --- links and dataset ------------------------------------------------------------------------


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    out = texts(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "link"))
    return out.withColumn("pos", big("pos"))


@query
def page_links(spark, sf_dir):
    return _page_links(spark, sf_dir)


@query
def relative_links(spark, sf_dir):
    both = _page_links(spark, sf_dir).unionByName(
        table(spark, sf_dir, "pages").select("page_id", F.lit(-1).cast("bigint").alias("pos"), F.col("url").alias("link"))
    )
    base = "https://news.example.org/"
    out = listings.relative_links(both)
    return out.select("page_id", "pos", "link", listings.article_url(F.col("link"), base).alias("url"))


@query
def links_from_json_lines(spark, sf_dir):
    """Listing rows as JSON lines and back; the language decides whether a line is usable."""
    rows = inputs.articles(spark, sf_dir)
    names = ["date_api", "page_api", "date", "headline", "short_headline", "short_text", "link"]
    good = F.to_json(F.struct(*names))
    lang = F.split_part("link", F.lit("/"), F.lit(2))
    line = (
        F.when(lang == "ausland", good)
        .when(lang == "Inland", F.concat(F.lit("["), good, F.lit("]")))
        .when(lang == "wirtschaft", F.to_json(F.struct(F.concat(F.lit("http://x"), "link").alias("link"))))
        .otherwise(F.concat(F.lit("{bad"), good))
    )
    return links.parse_links(rows.select(line.alias("value"))).withColumn("page_api", big("page_api"))


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("doc_id") % 2 == 0), df.where(F.col("doc_id") % 2 == 1)


@query
def json_lines_round_trip(spark, sf_dir):
    """All listing rows appended in two steps and read back."""
    path = run_folder(spark, "links")
    for half in _halves(inputs.articles(spark, sf_dir)):
        links.append_links(half, path)
    return links.read_links(spark, path).withColumn("page_api", big("page_api"))


@query
def tsv_round_trip(spark, sf_dir):
    """All articles appended as tab-separated text in two steps, with quotes, tabs and line breaks, and read back."""
    path = run_folder(spark, "articles-tsv")
    odd = F.concat("description", F.lit('\t"x"\n y '))
    rows = inputs.articles(spark, sf_dir).withColumn("description", odd).join(
        table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("taglist")), "doc_id"
    )
    for half in _halves(rows):
        article_files.write_tsv(half.drop("doc_id"), path, "append")
    stored = article_files.read_tsv(spark, path)
    return stored.select("date_api", big("page_api"), "headline", "short_text", "link", "articleBody", "description", "taglist")


@query
def parquet_sink(spark, sf_dir):
    path = run_folder(spark, "articles")
    for half in _halves(inputs.articles(spark, sf_dir)):
        article_files.save_articles(half, path, "append")
    return spark.read.parquet(path).select("doc_id", "date_api", "link", "articleBody")


@query
def sorted_tsv(spark, sf_dir):
    """All articles saved as tab-separated text in order of their days, read back, with the order found in the files."""
    path = f"{run_folder(spark, 'articles')}.csv"
    article_files.save_articles(inputs.articles(spark, sf_dir).drop("doc_id"), path)
    stored = article_files.read_tsv(spark, path).select("date_api", big("page_api"), "link", F.col("_metadata.file_name").alias("file"))
    in_file = Window.partitionBy("file").orderBy("at")
    before = F.lag("date_api").over(in_file)
    rows = stored.withColumn("at", F.monotonically_increasing_id()).withColumn("in_order", F.coalesce(before <= F.col("date_api"), F.lit(True)))
    return rows.select("date_api", "page_api", "link", "in_order")


@query
def cleaned_tsv_loaded(spark, sf_dir):
    """Cleaned articles saved as tab-separated text, then loaded with parsed dates and categories."""
    path = run_folder(spark, "cleaned-tsv")
    article_files.write_tsv(jobs.clean(_scored(spark, sf_dir)).drop("doc_id"), path)
    loaded = jobs.load_cleaned(spark, path, "date")
    return loaded.select(
        "link", "headline", "inferred_category", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"),
        *(r6(f"{f}_polarity").alias(f"{f}_polarity") for f in FIELDS),
    )


@query
def observed_rejects(spark, sf_dir):
    """Rejected dates counted while the cleaned articles are written."""
    late = F.when(F.col("description").endswith("7"), F.lit("unbekannt")).otherwise(F.col("date"))
    counts = jobs.clean_and_save(_scored(spark, sf_dir).withColumn("date", late), run_folder(spark, "cleaned"))
    one = spark.range(1)
    return one.select(*(F.lit(counts[name]).cast("bigint").alias(name) for name in ("rows", "rejected", "failed")))


@query
def statistics_by_batches(spark, sf_dir):
    """Dataset statistics carried on batch by batch, with the links that each batch was the first to bring."""
    path, listing = run_folder(spark, "statistics"), _listing(spark, sf_dir).select("doc_id", "date_api", "link")
    for batch in range(4):
        sketches.append_statistics(listing.where(F.col("doc_id") % 4 == batch), path, batch)
    rows = F.sort_array(F.collect_list(F.struct("batch_id", "new_links")))
    shown = F.array_join(F.transform(rows, lambda b: b["new_links"].cast("string")), ",")
    new = sketches.statistics_rows(spark, path).agg(shown.alias("new_links"))
    return sketches.statistics_so_far(spark, path).withColumn("new_links", new.scalar())


@query
def sketched_medians(spark, sf_dir):
    """Medians per month and category from stored daily sketches, and whether their rank in the month is within a hundredth of the middle."""
    path = run_folder(spark, "sketches")
    orders = table(spark, sf_dir, "orders").withColumn("inferred_category", F.col("o_orderpriority"))
    daily = sketches.day_sketches(orders, ORDER_DAY, [PRICE])
    for batch in range(2):  # two batches that share all days
        article_files.append_batch(sketches.day_sketches(orders.where(F.col("o_orderkey") % 2 == batch), ORDER_DAY, [PRICE]), path, batch)
    stored = spark.read.schema(daily.schema).parquet(path)
    monthly = sketches.rolled_up(stored, "M").select(
        "category", "period_end", F.kll_sketch_get_n_double("sketch").alias("n"), sketches.quantile(F.col("sketch")).alias("median")
    )
    rows = orders.select(
        F.explode(F.array("inferred_category", F.lit(series.ALL))).alias("category"), dates.period_end(F.col(ORDER_DAY), "M").alias("period_end"), F.col(PRICE).alias("x")
    )
    ranks = rows.join(monthly, ["category", "period_end"]).groupBy("category", "period_end", "n").agg(
        F.count_if(F.col("x") < F.col("median")).alias("below"), F.count_if(F.col("x") <= F.col("median")).alias("upto"), F.count(F.lit(1)).alias("all")
    )
    slack = 0.01 * F.col("all") + 1
    near = (F.col("below") <= F.col("all") / 2 + slack) & (F.col("upto") >= F.col("all") / 2 - slack)
    return ranks.select("category", "period_end", big("n"), near.alias("near_the_middle"))


@query
def page_keys_from_url(spark, sf_dir):
    """Keys of archive pages and of article pages from urls; every second page gets the url of an archive page."""
    held = texts(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    number = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("&pageIndex="), F.col("page_id") % 7 + 1))
    asked = F.concat(F.lit("https://news.example.org/archiv?datum="), F.date_format(day, "yyyy-MM-dd"), number)
    named = held.withColumn("url", F.when(F.col("page_id") % 2 == 0, asked).otherwise(F.col("url")))
    digest = F.md5("html").alias("digest")
    none = F.lit(None)
    by_day = pages.archive_pages(named).select(
        F.lit("archive").alias("kind"), "day", big("page"), none.cast("string").alias("link"), digest
    )
    kind = F.when(F.col("link") == "/archiv", "archive_as_article").otherwise("article")
    by_link = pages.article_pages(named).select(
        kind.alias("kind"), none.cast("date").alias("day"), none.cast("bigint").alias("page"), "link", digest
    )
    return by_day.unionByName(by_link)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.articles(spark, sf_dir).select(
        "doc_id", "date_api", "page_api", "headline", "link", "articleBody"
    )


@query
def dedup_links(spark, sf_dir):
    out = dataset.deduplicated(_listing(spark, sf_dir), "link", ("date_api", "page_api", "doc_id"))
    return out.withColumn("page_api", big("page_api"))


@query
def dataset_statistics(spark, sf_dir):
    return dataset.dataset_statistics(_listing(spark, sf_dir))


@query
def sorted_articles(spark, sf_dir):
    out = dataset.sorted_by_day(_listing(spark, sf_dir))
    return out.select("doc_id", "date_api", "link")


@query
def rows_after_offset(spark, sf_dir):
    listing = _listing(spark, sf_dir).select("doc_id", "date_api", "link")
    return dataset.after_first(listing, 150, ("date_api", "doc_id"))


@query
def resume_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dataset.not_yet_done(docs, table(spark, sf_dir, "labels"), "doc_id")


@query
def resume_bucketed(spark, sf_dir):
    """The same rows from tables stored in buckets by id."""
    name = f"run_{uuid.uuid4().hex}"
    for part, names in (("documents", ("doc_id", "text")), ("labels", ("doc_id",))):
        rows = table(spark, sf_dir, part).select(*names)
        dataset.save_bucketed(rows, f"{name}_{part}", run_folder(spark, f"bucketed-{part}"), "doc_id", 8)
    return dataset.not_yet_done_stored(spark, f"{name}_documents", f"{name}_labels", "doc_id")


@query
def union_old_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    old = docs.join(labels.groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("quality")), "doc_id")
    new = dataset.not_yet_done(docs, labels, "doc_id")
    return dataset.appended(old, new).select("doc_id", "lang", "quality")


# --- HTML -------------------------------------------------------------------------------------


@query
def page_headline(spark, sf_dir):
    page = listings.page_tokens(F.col("html"))
    both = words.bind(
        page,
        lambda p: F.struct(
            markup.element_text(p, "h1").alias("h1"), markup.element_text(p, "title").alias("title")
        ),
    )
    out = texts(spark, sf_dir, "pages").select("page_id", both.alias("b"))
    return out.select("page_id", "b.h1", "b.title")


@query
def text_strip(spark, sf_dir):
    text = markup.visible_text(listings.page_tokens(F.col("html")))
    return texts(spark, sf_dir, "pages").select("page_id", text.alias("text"))


@query
def archive_teasers(spark, sf_dir):
    found = listings.extract_teasers(inputs.archive_pages(spark, sf_dir), ["doc_id"])
    return found.withColumns({"page_api": big("page_api"), "position": big("position")})


@query
def collect_listings(spark, sf_dir):
    """Listing rows of a whole archive: stop rules applied, then teasers extracted."""
    out = jobs.collect(inputs.archive_pages(spark, sf_dir).drop("doc_id"))
    return out.withColumn("page_api", big("page_api"))


@query
def collect_after_listings(spark, sf_dir):
    """Listing rows from failed pages on, through the end of each month."""
    held = inputs.archive_pages(spark, sf_dir)
    failed = held.where(F.col("doc_id") % 290 == 145).select("day", "page")
    out = jobs.collect_after(held.drop("doc_id"), failed)
    return out.withColumn("page_api", big("page_api"))


@query
def recollected_months(spark, sf_dir):
    """An archive stored by month, collected, then some failed days collected again, twice, into the stored months."""
    archive, out = run_folder(spark, "archive"), run_folder(spark, "listings")
    held = inputs.archive_pages(spark, sf_dir)
    pages.store_archive(held.select("day", "page", "html"), archive)
    stored = pages.read_archive(spark, archive)
    first = F.col("day") <= F.date_add(F.lit("2024-01-01").cast("date"), 19)
    jobs.save_months(jobs.collect(stored.where(first)), out)
    failed = held.where(F.col("doc_id") % 290 == 145).select("day", "page")
    for _ in range(2):
        jobs.recollect(spark, out, stored, failed)
    return spark.read.schema(LISTING).parquet(out).drop("month").withColumn("page_api", big("page_api"))


@query
def monthly_summary_flag(spark, sf_dir):
    flags = listings.page_status(inputs.archive_pages(spark, sf_dir))
    return flags.select("day", big("page"), "monthly_summary", "error", big("n_links"))


@query
def jsonld_article(spark, sf_dir):
    out = articles.extract_articles(inputs.article_pages(spark, sf_dir))
    return out.select(
        "link", "articleBody", "datePublished", "date_published", "date_modified", "description",
        F.array_join("taglist", "|").alias("taglist"),
        F.array_join("author_names", "|").alias("author_names"),
        F.get_json_object("author", "$.name").alias("author"), "has_article",
    )


@query
def article_label(spark, sf_dir):
    held = inputs.article_pages(spark, sf_dir)
    return held.select("doc_id", articles.article_label(F.col("html")).alias("label"))


@query
def fetch_status(spark, sf_dir):
    return articles.fetch_status(inputs.article_pages(spark, sf_dir))


@query
def listing_article_join(spark, sf_dir):
    """Listing rows joined with their article pages; one language has listings without a page."""
    docs = table(spark, sf_dir, "documents")
    link = F.when(F.col("lang") == "es", F.lit("")).otherwise(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    listing = docs.select(F.col("doc_id"), link.alias("link"))
    out = jobs.fetch(listing, inputs.article_pages(spark, sf_dir).select("link", "html"))
    return out.select("doc_id", "link", "label", "articleBody")


# --- streams ----------------------------------------------------------------------------------


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    return streams.stream_parquet(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema)


@query
def streamed_scores(spark, sf_dir):
    """Documents scored by a stream; the files it wrote are the result."""
    source = _document_stream(spark, sf_dir).select("doc_id", "text")
    folder = run_folder(spark, "streamed-scores")
    streams.score_stream(source, LEXICON, f"{folder}/out", f"{folder}/state", ["text"]).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(
        "doc_id", F.col("text_sentiment_category").alias("category"),
        r6(polarity.json_polarity(F.col("text_sentiment_score"))).alias("polarity"),
    )


@query
def streamed_counts(spark, sf_dir):
    scored = score_fields(_document_stream(spark, sf_dir), LEXICON, ["text"])
    folder = run_folder(spark, "streamed-counts")
    streams.count_stream(scored, f"{folder}/out", f"{folder}/state", ["text"]).awaitTermination()
    return streams.running_counts(spark, f"{folder}/out")


def _streamed_listings(spark: SparkSession, landed: DataFrame, max_files: int | None = None) -> DataFrame:
    folder = run_folder(spark, "streamed-listings")
    landed.write.parquet(f"{folder}/in")
    source = streams.stream_parquet(spark, f"{folder}/in", landed.schema, max_files)
    streams.collect_stream(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.collected(spark, f"{folder}/out").withColumn("page_api", big("page_api"))


@query
def streamed_listings(spark, sf_dir):
    """Archive pages landed as files, collected by a stream."""
    return _streamed_listings(spark, inputs.archive_pages(spark, sf_dir).drop("doc_id"))


@query
def streamed_listings_split(spark, sf_dir):
    """The same pages dealt over files that a month's pages share, a quarter of them read at a time.

    Up to four times ``FILE_PAGES`` documents make four files; further ones make further files, so that no file and no task grows.
    """
    quarter = max(1, -(-table(spark, sf_dir, "documents").count() // (4 * FILE_PAGES)))
    landed = inputs.archive_pages(spark, sf_dir).repartition(4 * quarter, "doc_id", "day", "page").drop("doc_id")
    return _streamed_listings(spark, landed, quarter)
