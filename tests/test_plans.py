"""Shapes of physical plans that matter at scale."""

import datetime as dt

from pyspark.sql import functions as F

from zeitton.operators import articles, calendar, correlogram, dataset, series
from zeitton.operators.scoring import LexiconScorer, ModelScorer, score_fields
from zeitton.plans import jobs
from zeitton.plans.inputs import WordModel, table
from zeitton.sources import links, pages as page_source

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filter_and_columns_reach_the_scan(spark):
    df = series.in_range(table(spark, FOLDER, "events"), "ts", "2024-01-05", "2024-01-20")
    text = plan(series.resampled(df, "ts", ["value"], "mean", "D"))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text
    assert "partial_avg" in text and text.count("Exchange") == 1


def test_scoring_is_narrow_and_runs_once(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    out = score_fields(docs, LexiconScorer(), ["text"]).where(F.col("text_sentiment_category") == "neutral")
    text = plan(out)
    assert "Exchange" not in text and "Python" not in text
    assert text.count("INSET") == 2
    model = plan(score_fields(docs, ModelScorer(WordModel), ["text"]).where("text_sentiment_category = 'neutral'"))
    assert model.count("ArrowEvalPython") == 1


def test_article_choice_runs_once(spark):
    pages = spark.createDataFrame([("/a", "<p>")], "link string, html string")
    text = plan(articles.extract_articles(pages).where("has_article"))
    assert text.count("regexp_extract_all(") == 1 and "Exchange" not in text


def test_json_lines_are_parsed_once(spark):
    text = plan(links.parse_links(spark.createDataFrame([("{}",)], "value string")))
    assert text.lower().count("parsejson") + text.lower().count("parse_json") == 1 and "Exchange" not in text


def test_correlogram_shares_one_exchange(spark):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 5)) for k in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "k string, period_end date, value double")
    assert plan(correlogram.correlogram(df, ["k"], 5)).count("Exchange hashpartitioning") == 1


def test_first_rows_are_combined_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "/x", 2)], "date_api string, page_api int, link string, n int")
    text = plan(dataset.deduplicated(df))
    assert "partial_min" in text and text.count("Exchange hashpartitioning") == 1


def test_stop_rule_broadcasts_days_only(spark):
    rows = [(dt.date(2024, 1, 1), 1, 5, False, False, "<html>")]
    df = spark.createDataFrame(rows, "day date, page int, n_links int, monthly_summary boolean, error boolean, html string")
    text = plan(calendar.days_until_summary(calendar.pages_until_stop(df)))
    # The one join that may shuffle compares day and page numbers; pages meet broadcast days and months.
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert all("LeftAnti" in line for line in joins) and "partial_min" in text
    assert text.count("BroadcastHashJoin") >= 2 and "RoundRobin" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bodies_are_fetched_last(spark):
    """Winners are chosen on narrow rows: no exchange but that of the last join holds a body."""
    rows = [("a", 1, f"/x{i % 3}", "body" * 50) for i in range(12)]
    df = spark.createDataFrame(rows, "date_api string, page_api int, link string, articleBody string")
    stored, winners = dataset.located(df, "link", ["date_api", "page_api"])
    chosen = stored.groupBy("link").agg(F.min(F.struct("date_api", "page_api", "__at")))
    assert "articleBody" not in plan(chosen) and winners.columns == ["link", "__at"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(dataset.deduplicated(df))
        assert "SortMergeJoin" in text and "Aggregate" not in text
        scans = [line for line in text.splitlines() if "ReadSchema" in line]
        assert len(scans) == 2 and sum("articleBody" in line for line in scans) == 1
        pages = spark.createDataFrame([("/x1", "<p>")], "link string, html string")
        joined = plan(articles.with_articles(df.select("link"), articles.extract_articles(pages)))
        scans = [line for line in joined.splitlines() if "ReadSchema" in line]
        assert sum("articleBody" in line for line in scans) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dataset.deduplicated(df).count() == 3


def test_backfill_reads_the_months_of_its_worklist(spark, tmp_path):
    """Pages stored by month: the worklist's months reach the scan as a pruning expression."""
    rows = [(dt.date(2024, m, day), 1, f"<p>{m}") for m in range(1, 13) for day in (1, 2)]
    page_source.store_archive(spark.createDataFrame(rows, "day date, page int, html string"), f"{tmp_path}/archive")
    stored = page_source.read_archive(spark, f"{tmp_path}/archive")
    failed = spark.createDataFrame([(dt.date(2024, 5, 2), 1)], "day date, page int")
    found = calendar.from_start_page(stored, calendar.backfill_days(failed))
    assert "dynamicpruningexpression(month" in plan(found)
    assert [r.html for r in found.collect()] == ["<p>5"]
    bounded = plan(jobs.pages_between(stored, "2024-03-01", "2024-03-31"))
    assert "PartitionFilters: [isnotnull(month" in bounded and "month#" in bounded


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"/{i}", i) for i in range(50)], "link string, n int")
    dataset.save_bucketed(rows, "plan_rows", f"{tmp_path}/rows", buckets=4)
    dataset.save_bucketed(rows.where("n < 30").select("link"), "plan_done", f"{tmp_path}/done", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = dataset.not_yet_done_stored(spark, "plan_rows", "plan_done")
        text = plan(todo)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert sorted(r.n for r in todo.collect()) == list(range(30, 50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table plan_rows")
        spark.sql("drop table plan_done")
