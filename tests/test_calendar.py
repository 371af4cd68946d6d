import datetime as dt

from pyspark.sql import functions as F

from zeitton.operators import calendar, dataset
from zeitton.operators.skew import join_split
from zeitton.plans import inputs, jobs
from zeitton.sources import pages as page_source


def d(text):
    return dt.date.fromisoformat(text)


STATUS = "day date, page int, n_links int, monthly_summary boolean, error boolean"
PAGES = [
    # empty page 2, so page 3 is never reached
    (d("2024-01-01"), 1, 5, False, False), (d("2024-01-01"), 2, 0, False, False), (d("2024-01-01"), 3, 4, False, False),
    # error on page 2
    (d("2024-01-02"), 1, 5, False, False), (d("2024-01-02"), 2, 0, False, True), (d("2024-01-02"), 3, 4, True, False),
    # summary on this day, all its pages stay
    (d("2024-01-03"), 1, 5, False, False), (d("2024-01-03"), 2, 5, True, False), (d("2024-01-03"), 3, 5, False, False),
    (d("2024-01-04"), 1, 5, False, False),
    # flag on a page without links in another month
    (d("2024-02-01"), 1, 0, True, False), (d("2024-02-02"), 1, 3, False, False),
]


def walk(rows):
    """The stop rules as a sequential walk, starting every day at its first page."""
    kept, months = [], {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        months.setdefault((row[0].year, row[0].month), {}).setdefault(row[0], []).append(row)
    for days in months.values():
        for _, found in sorted(days.items()):
            summary = False
            for number, row in enumerate(found, 1):
                if row[1] != number or row[4] or row[2] == 0:
                    break
                kept.append((row[0], row[1]))
                summary = summary or row[3]
            if summary:
                break
    return sorted(kept)


def test_stop_rules(spark):
    df = spark.createDataFrame(PAGES, STATUS)
    kept = calendar.pages_until_stop(df)
    assert sorted((r.day, r.page) for r in kept.collect()) == [
        (d("2024-01-01"), 1), (d("2024-01-02"), 1), (d("2024-01-03"), 1), (d("2024-01-03"), 2),
        (d("2024-01-03"), 3), (d("2024-01-04"), 1), (d("2024-02-02"), 1),
    ]
    cut = calendar.days_until_summary(kept)
    assert sorted((r.day, r.page) for r in cut.collect()) == walk(PAGES)


def test_stop_rules_equal_walk_on_random_pages(spark):
    import random

    rng = random.Random(11)
    rows = [
        (d("2024-01-01") + dt.timedelta(days=i), p, rng.choice([0, 1, 4, 9]), rng.random() < 0.05, rng.random() < 0.1)
        for i in range(120)
        for p in range(1, rng.randint(1, 5) + 1)
        if rng.random() < 0.9
    ]
    df = spark.createDataFrame(rows, STATUS)
    cut = calendar.days_until_summary(calendar.pages_until_stop(df))
    assert sorted((r.day, r.page) for r in cut.collect()) == walk(rows)


def test_backfill_and_start_page(spark, tmp_path):
    path = tmp_path / "failed.txt"
    path.write_text("2024-12-30; 2 \n2024-02-28;3;timeout;x\nkein Tag;1\n2023-04-30;x\n")
    failed = page_source.read_failed_days(spark, str(path))
    assert sorted((r.day, r.page, r.rest) for r in failed.collect()) == [
        (d("2023-04-30"), None, None), (d("2024-02-28"), 3, "timeout;x"), (d("2024-12-30"), 2, None)]
    work = calendar.backfill_days(failed)
    assert sorted((r.day, r.start_page) for r in work.collect()) == [
        (d("2023-04-30"), 1), (d("2024-02-28"), 3), (d("2024-02-29"), 1), (d("2024-12-30"), 2), (d("2024-12-31"), 1)]
    days = [d("2024-12-30"), d("2024-12-31")]
    pages = spark.createDataFrame([(day, p, 1, False, False) for day in days for p in (1, 2, 3, 5)], STATUS)
    begun = calendar.from_start_page(pages, work)
    assert sorted((r.day.day, r.page) for r in begun.collect()) == [(30, 2), (30, 3), (30, 5), (31, 1), (31, 2), (31, 3), (31, 5)]
    assert sorted((r.day.day, r.page) for r in calendar.pages_until_stop(begun).collect()) == [(30, 2), (30, 3), (31, 1), (31, 2), (31, 3)]


def test_calendars(spark):
    days = calendar.day_spine(spark, "2023-12-30", "2024-03-01")
    assert days.count() == 63
    groups = {(r.year, r.month): (r.label, r.days) for r in calendar.month_groups(days).collect()}
    assert [len(v[1]) for _, v in sorted(groups.items())] == [2, 31, 29, 1]
    assert groups[(2024, 2)][0] == "02.2024" and groups[(2023, 12)][1] == [d("2023-12-30"), d("2023-12-31")]
    listed = spark.createDataFrame([(d("2024-01-01"),)] * 3, "day date")
    assert calendar.missing_days(days, listed).count() == 62
    assert [r.period_end for r in calendar.period_spine(spark, "2024-01-01", "2024-03-15", "M").collect()] == [d("2024-01-31"), d("2024-02-29")]


def test_archive_and_article_pages(spark):
    raw = spark.createDataFrame(
        [(1, "https://n.example/archiv?datum=2024-12-01&pageIndex=2", "a"), (2, "https://n.example/archiv?datum=2024-12-02", "b"),
         (3, "https://n.example/inland/x.html", "c"), (4, "not a url", "d"), (5, "https://n.example/archiv?datum=kein", "e")],
        "page_id long, url string, html string",
    )
    got = page_source.archive_pages(raw).collect()
    assert sorted((r.day, r.page) for r in got) == [(d("2024-12-01"), 2), (d("2024-12-02"), 1)]
    assert ("/inland/x.html", "c") in [tuple(r) for r in page_source.article_pages(raw).collect()]


def test_dedup_offset_and_statistics(spark):
    rows = [(f"2024-01-{1 + i % 9:02d}", i % 4, f"/l{i % 13}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "date_api string, page_api int, link string, n int").repartition(6)
    best = {}
    for row in sorted(rows):
        best.setdefault(row[2], row)
    assert sorted(tuple(r) for r in dataset.deduplicated(df).collect()) == sorted(best.values())
    assert tuple(dataset.dataset_statistics(df).first()) == (200, 9, 13)
    assert dataset.dataset_statistics(df, approximate=True).first().articles == 200
    ordered = sorted(rows, key=lambda r: (r[0], r[3]))
    for n in (0, 1, 57, 199, 200, 500):
        got = sorted(r.n for r in dataset.after_first(df, n, ("date_api", "n")).collect())
        assert got == sorted(r[3] for r in ordered[n:]), n
    assert [r.date_api for r in dataset.sorted_by_day(df).collect()] == sorted(r[0] for r in rows)
    done = df.where("n < 50")
    todo = dataset.not_yet_done(df, done, "n")
    assert todo.count() == 150
    assert dataset.appended(done, todo.withColumn("extra", F.lit(1))).count() == 200


def test_hot_keys_are_split_without_changing_the_result(spark):
    """A third of the rows under one key, copies among them, and a low limit."""
    rows = [("/hot", i % 5) for i in range(300)] + [(f"/l{i % 90}", i) for i in range(600)] + [("/none", 1), (None, 2)]
    left = spark.createDataFrame(rows, "link string, n int").repartition(6)
    right = spark.createDataFrame([("/hot", "h")] + [(f"/l{i}", str(i)) for i in range(0, 90, 2)], "link string, v string")
    for how in ("inner", "left_anti"):
        plain = left.join(right, "link", how)
        split = join_split(left, right, "link", how, hot_rows=20)
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert dataset.not_yet_done(left, right.unionByName(right), hot_rows=20).count() == 302


def test_hot_rows_reach_several_tasks(spark):
    left = spark.createDataFrame([("/hot",)] * 400, "link string").repartition(4)
    right = spark.createDataFrame([("/hot", "h")], "link string, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_split(left, right, "link", hot_rows=20)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in sizes) == 400 and len(sizes) > 1


def test_stand_in_reaches_the_same_share_at_any_size(spark):
    """Pages reached of the archive made from documents: alike for a thousand documents and for a hundred thousand."""
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars")
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", "n_chars", "doc_id")
    copies = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy")
    tenfold = large.select("*", copies).select((F.col("doc_id") + 10_000 * F.col("copy")).alias("doc_id"), "lang", "n_chars")
    shares = []
    for documents in (small, tenfold):
        places = inputs.page_places(documents)
        status = places.select(
            "doc_id", "day", "page", (F.col("state") == "full").cast("int").alias("n_links"),
            F.col("summary").alias("monthly_summary"), (F.col("state") == "failed").alias("error"),
        )
        assert places.select("day", "page").distinct().count() == places.count()
        shares.append(jobs.reached(status, status).count() / documents.count())
    assert 0.3 < shares[0] < 0.8 and abs(shares[0] - shares[1]) < 0.15
