"""Polarity, dates, categories."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from zeitton.functions import category, dates, polarity

CASES = [
    ('{"positive": 0.0165, "negative": 0.9765, "neutral": 0.0069}', -0.96),
    ('{"negative": 0.2}', -0.2),
    ("{}", 0.0),
    ('{"positive": null, "negative": 0.1}', None),
    ('{"positive": "0.4", "negative": 0.1}', None),
    ("{bad", None),
    (None, None),
    ("[1]", None),
    ("5", None),
    ('{"positive": 1, "negative": 0}', 1.0),
    ('{"positive": [1], "negative": 0}', None),
]


def test_json_polarity(spark):
    df = spark.createDataFrame([(j,) for j, _ in CASES], "j string")
    for row in df.select("j", polarity.json_polarity(F.col("j")).alias("p")).collect():
        want = dict(CASES)[row.j]
        assert row.p is None if want is None else row.p == pytest.approx(want)


def twin(text):
    try:
        score = json.loads(text)
    except ValueError:
        return None
    parts = [score[key] if key in score else 0 for key in ("positive", "negative")]
    return parts[0] - parts[1] if all(isinstance(v, (int, float)) for v in parts) else None


def test_polarity_equals_twin(spark):
    rng = random.Random(3)
    values = [0, 1, 0.25, -3, 1e-3, None, "x", True, [], {}]
    keys = ["positive", "negative", "neutral", "other"]
    texts = [json.dumps({k: rng.choice(values) for k in rng.sample(keys, rng.randint(0, 4))}) for _ in range(300)]
    texts = [t if rng.random() < 0.9 else t[: len(t) // 2] for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    for row in df.select("j", polarity.json_polarity(F.col("j")).alias("p")).collect():
        want = twin(row.j)
        assert row.p == (None if want is None else pytest.approx(want)), row.j


def test_typed_polarity_bounds(spark):
    df = spark.range(1).select(F.struct(F.lit(0.2).alias("positive"), F.lit(0.7).alias("negative")).alias("s"))
    assert df.select(polarity.typed_polarity(F.col("s"))).first()[0] == pytest.approx(-0.5)


def strptime(text):
    try:
        return dt.datetime.strptime(text, "%d.%m.%Y • %H:%M Uhr")
    except (ValueError, TypeError):
        return None


def test_german_dates(spark):
    texts = [
        "01.12.2024 • 09:05 Uhr", "1.2.2024 • 9:05 Uhr", "29.02.2024 • 23:59 Uhr", "29.02.2023 • 10:00 Uhr",
        "01.12.2024 • 24:00 Uhr", "00.12.2024 • 09:05 Uhr", "01.13.2024 • 09:05 Uhr", "01.12.24 • 09:05 Uhr",
        "01.12.2024 • 09:05", "2024-12-01", "", None, "01.12.2024  •  09:05   Uhr", "01.12.2024 • 09:60 Uhr",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in df.select("t", dates.german_timestamp(t).alias("s"), dates.lenient_timestamp(t).alias("l")).collect():
        assert row.s == strptime(row.t), row.t
        assert row.l == (dt.datetime(2024, 12, 1) if row.t == "2024-12-01" else strptime(row.t))


@pytest.mark.parametrize("freq", ["D", "W", "M"])
def test_spines_and_labels_equal_pandas(spark, freq):
    import pandas as pd

    alias = {"D": "D", "W": "W", "M": "ME"}[freq]
    ranges = [("2006-01-01", "2025-03-01"), ("2024-01-31", "2024-02-29"), ("2024-01-06", "2024-01-06"), ("2024-01-02", "2024-01-05")]
    df = spark.createDataFrame(ranges, "a string, b string")
    labels = dates.range_spine(F.col("a").cast("date"), F.col("b").cast("date"), freq)
    for row in df.select("a", "b", labels.alias("s")).collect():
        assert row.s == [d.date() for d in pd.date_range(row.a, row.b, freq=alias)]
    days = pd.date_range("2023-12-20", "2024-03-10", freq="7h")
    stamps = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "t timestamp_ntz")
    for row in stamps.select("t", dates.period_end(F.col("t"), freq).alias("p")).collect():
        want = pd.Series([1], index=[pd.Timestamp(row.t)]).resample(alias).mean().index[0].date()
        assert row.p == want


def test_unknown_frequency():
    with pytest.raises(ValueError):
        dates.check_frequency("Q")


def test_category(spark):
    links = {"/INLAND/x": "inland", "/ausland/x": "ausland", "/ausland/inland/x": "inland", "/wirtschaft/x": "wirtschaft",
             "/inlandx": "other", "": "other", None: "other"}
    df = spark.createDataFrame([(k,) for k in links], "l string")
    for row in df.select("l", category.infer_category(F.col("l")).alias("c")).collect():
        assert row.c == links[row.l]


def test_polarity_of_repeated_keys_and_nan(spark):
    texts = {
        '{"positive": 0.5, "positive": 0.7}': 0.7, '{"positive": 0.5, "negative": 0.1, "positive": 0.7}': 0.6,
        '{"negative": 0.2, "negative": 0.3}': -0.3, '{"positive": NaN}': None, '{"positive": 0.5, "x": NaN}': None,
        '{"positive": 1, "positive": null}': None, '{"positive": 1, "positive"': None, "{bad": None, "[1]": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    for row in df.select("j", polarity.json_polarity(F.col("j")).alias("p")).collect():
        assert row.p == (texts[row.j] if texts[row.j] is None else pytest.approx(texts[row.j])), row.j
