"""Streams and whole jobs."""

import datetime as dt

import pytest
from zeitton.operators.scoring import LexiconScorer, category_counts
from zeitton.plans import jobs, queries
from zeitton.schemas import ARTICLE_POLARITY, ARTICLE_SENTIMENT, FIELDS
from zeitton.sources import articles as article_source
from zeitton.sources import links as link_source
from zeitton.streaming import jobs as streams
from tests.test_html import NEWS, SKIP, page, script, wrapper

SCORER = LexiconScorer(["gut"], ["schlecht"])
SCHEMA = "link string, headline string, articleBody string"


def batch(spark, start, stop):
    words = ["gut", "schlecht", "etwas"]
    rows = [(f"/inland/{i}", words[i % 3], f"{words[i % 3]} text " * 150) for i in range(start, stop)]
    return spark.createDataFrame(rows, SCHEMA)


def test_scoring_stream_continues(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        source = streams.stream_parquet(spark, landing, batch(spark, 0, 1).schema, max_files=1)
        query = streams.score_stream(source, SCORER, out, state)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    batch(spark, 0, 10).write.parquet(landing)
    assert run() == 10
    batch(spark, 10, 15).write.mode("append").parquet(landing)
    assert run() == 5
    assert run() == 0
    stored = spark.read.parquet(out)
    whole = jobs.score(batch(spark, 0, 15), SCORER)
    assert sorted(stored.collect()) == sorted(whole.select(stored.columns).collect())


def test_resume_twice_equals_once(spark):
    everything = batch(spark, 0, 9)
    first = jobs.score(batch(spark, 0, 4), SCORER)
    second = jobs.score(everything, SCORER, done=first)
    assert second.count() == 5
    assert jobs.score(everything, SCORER, done=first.unionByName(second)).count() == 0


def test_count_stream(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    scored = jobs.score(batch(spark, 0, 9), SCORER)
    for part in (scored, jobs.score(batch(spark, 9, 15), SCORER)):
        part.write.mode("append").parquet(landing)
        source = streams.stream_parquet(spark, landing, scored.schema)
        streams.count_stream(source, out, state).awaitTermination()
    want = category_counts(jobs.score(batch(spark, 0, 15), SCORER))
    assert sorted(streams.running_counts(spark, out).collect()) == sorted(want.collect())


def teaser(link, title):
    return wrapper(
        f'<a class="teaser-right__link" href="{link}"><div class="teaser-right__date">01.12.2024 • 09:05 Uhr</div>'
        f'<span class="teaser-right__labeltopline">gut</span><span class="teaser-right__headline">{title}</span></a>'
    )


MONTH = '<h2 class="archive__headline">Dezember 2024</h2>'
ARCHIVE = [
    (dt.date(2024, 12, 1), 1, page(*SKIP, teaser("/inland/a", "gut"), teaser("http://else", "x"))),
    (dt.date(2024, 12, 1), 2, page(*SKIP)),
    (dt.date(2024, 12, 1), 3, page(*SKIP, teaser("/inland/never", "x"))),
    (dt.date(2024, 12, 2), 1, page(*SKIP, teaser("/ausland/b", "schlecht"), head=MONTH)),
    (dt.date(2024, 12, 3), 1, page(*SKIP, teaser("/inland/late", "x"))),
    (dt.date(2025, 1, 1), 1, page(*SKIP, teaser("/wirtschaft/c", "gut"))),
    (dt.date(2025, 1, 2), 1, None),
    (dt.date(2025, 1, 2), 2, page(*SKIP, teaser("/inland/never2", "x"))),
]


def archive(spark, rows=ARCHIVE):
    return spark.createDataFrame(rows, "day date, page int, html string")


def test_collect(spark):
    got = jobs.collect(archive(spark))
    assert sorted(r.link for r in got.collect()) == ["/ausland/b", "/inland/a", "/wirtschaft/c", "http://else"]
    assert jobs.collect(archive(spark), "2025-01-01", "2025-01-31").count() == 1
    failed = spark.createDataFrame([(dt.date(2024, 12, 1), 3)], "day date, page int")
    after = jobs.collect_after(archive(spark), failed)
    assert sorted(r.link for r in after.collect()) == ["/ausland/b", "/inland/never"]


@pytest.mark.parametrize("order", [range(8), (7, 2, 4, 0, 6, 1, 3, 5)])
def test_collect_stream_in_any_order(spark, tmp_path, order):
    """Pages that land one by one, a month's summary and first pages among the last, give the batch result."""
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[ARCHIVE[i] for i in order[:3]], [ARCHIVE[i] for i in order[3:7]], [ARCHIVE[i] for i in order[7:]]]
    for part in parts:
        archive(spark, part).write.mode("append").parquet(landing)
        source = streams.stream_parquet(spark, landing, archive(spark).schema)
        streams.collect_stream(source, out, state).awaitTermination()
    got = streams.collected(spark, out)
    want = jobs.collect(archive(spark))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_streams_read_files_and_folders(spark, tmp_path):
    single, folder = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    batch(spark, 0, 30).repartition(3).write.parquet(folder)
    batch(spark, 0, 7).coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("part-*.parquet")).rename(single)
    for path, n in ((single, 7), (folder, 30)):
        source = streams.stream_parquet(spark, path, batch(spark, 0, 1).schema)
        out = str(tmp_path / f"out{n}")
        streams.score_stream(source, SCORER, out, f"{out}-state").awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_all_steps_through_files(spark, tmp_path):
    """Archive pages to links file to articles file to scores to polarity to correlogram."""
    links, tsv, scored_tsv, clean_tsv = (str(tmp_path / n) for n in ("links.json", "a.csv", "s.csv", "c.csv"))
    link_source.append_links(jobs.collect(archive(spark)), links)
    pages = spark.createDataFrame(
        [(link, script(NEWS % text)) for link, text in (("/inland/a", "gut"), ("/ausland/b", "schlecht " * 300), ("/wirtschaft/c", ""))],
        "link string, html string",
    )
    article_source.save_articles(jobs.fetch(link_source.read_links(spark, links), pages), tsv)
    stored = article_source.read_tsv(spark, tsv)
    assert stored.count() == 3
    article_source.write_tsv(jobs.score(stored, SCORER), scored_tsv)
    cleaned = jobs.clean(article_source.read_tsv(spark, scored_tsv, ARTICLE_SENTIMENT))
    assert set(cleaned.columns) == {f.name for f in ARTICLE_POLARITY}
    got = {r.link: (r.articleBody_polarity, r.headline_polarity, r.short_headline_polarity) for r in cleaned.collect()}
    assert got == {"/inland/a": (1.0, 1.0, 1.0), "/ausland/b": (-1.0, -1.0, 1.0), "/wirtschaft/c": (0.0, 1.0, 1.0)}
    article_source.write_tsv(cleaned, clean_tsv)
    series, correlogram = jobs.correlate(jobs.load_cleaned(spark, clean_tsv, "date"), category="inland", start_date="2024-11-01", end_date="2025-02-01")
    assert series.columns == ["period_end", "articleBody_polarity_median", "short_headline_polarity_median"]
    assert [r.articleBody_polarity_median for r in series.orderBy("period_end").collect()] == [None, 1.0, None]
    assert correlogram.count() == 2
    assert jobs.date_rejects(stored).first().rejected == 0
    assert len(FIELDS) == 4


def test_landed_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_PAGES", 5)
    monkeypatch.setattr(queries, "run_folder", lambda spark, name: str(tmp_path / name))
    rows = [(i, f"one {i}\ntwo {i}", "en", "web", 10) for i in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = queries.streamed_listings_split(spark, str(tmp_path))
    folder = tmp_path / "streamed-listings"
    landed = list((folder / "in").glob("part-*.parquet"))
    assert len(landed) > 10  # up to 20, as a file without rows may not be written
    assert len(list((folder / "out").glob("batch_id=*"))) == 4
    assert sorted(got.collect()) == sorted(queries.collect_listings(spark, str(tmp_path)).collect())
