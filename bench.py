"""Time the headline queries: ``BENCH_SF_DIR=... BENCH_CPUS=... python bench.py`` prints one JSON line.

Every query runs to the end into a sink that discards its rows, so nothing is collected. A query runs
twice and the faster run counts; the first one also pays for compiling its plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zeitton.plans.queries import QUERIES  # noqa: E402
from zeitton.session import build_session  # noqa: E402

HEADLINE = (
    "resample_mean_d", "resample_median_m", "category_series_mean", "category_series_median",
    "spine_reindex", "ffill", "acf", "pacf", "worked_example", "polarity_json", "polarity_series",
    "parse_german_date", "chunk_counts", "chunk_text", "lexicon_chunk_scores", "doc_sentiment",
    "model_sentiment", "field_sentiment_wide", "sentiment_counts", "clean_articles",
    "article_polarity_series", "article_correlogram", "page_takewhile", "month_cutoff", "missing_days",
    "relative_links", "links_from_json_lines", "dedup_links", "dataset_statistics", "rows_after_offset",
    "resume_antijoin", "text_strip", "archive_teasers", "collect_listings", "jsonld_article", "listing_article_join",
    "streamed_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best-of-two times",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
