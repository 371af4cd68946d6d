import calendar
import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zeitton.operators import correlogram, median, segments, series
from zeitton.operators.median import exact_median

TOY = [
    (dt.datetime(2024, 1, 6, 10), "/inland/a", 1.0, 1.0),
    (dt.datetime(2024, 1, 7, 23), "/inland/b", 2.0, None),
    (dt.datetime(2024, 1, 8), "/ausland/c", 3.0, 3.0),
    (dt.datetime(2024, 3, 5), "/x", 4.0, 4.0),
]
SCHEMA = "date timestamp_ntz, link string, a double, b double"


def label(day, freq):
    if freq == "W":
        return day + dt.timedelta(days=6 - day.weekday())
    return day.replace(day=calendar.monthrange(day.year, day.month)[1]) if freq == "M" else day


def expected(rows, cols, agg, freq, start=None, end=None, missing="fill"):
    """Expected series by grouping rows in plain Python and walking the calendar day by day."""
    low = dt.datetime.fromisoformat(start) if start else dt.datetime.min
    high = dt.datetime.fromisoformat(end) if end else dt.datetime.max
    groups = {}
    for date, _, a, b in rows:
        values = [{"a": a, "b": b}[c] for c in cols]
        if low <= date <= high and None not in values:
            groups.setdefault(label(date.date(), freq), []).append(values)
    first, last = (low.date(), high.date()) if start and end else (min(groups), max(groups))
    function = {"mean": statistics.fmean, "median": statistics.median}[agg]
    out, before = {}, (None,) * len(cols)
    for day in (first + dt.timedelta(days=i) for i in range((last - first).days + 1)):
        if label(day, freq) != day:
            continue
        found = day in groups
        values = tuple(map(function, zip(*groups[day]))) if found else (None,) * len(cols)
        before = values if found else before
        if found or missing != "drop":
            out[day] = before if missing == "ffill" else values
    return out


def spark_series(df, cols, *args):
    out = series.aggregate_sentiment(df, "date", cols, *args)
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def assert_same(got, want):
    assert set(got) == set(want)
    for day, values in want.items():
        assert got[day] == pytest.approx(values), day


def random_rows(n=400):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        day = dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.choice([rng.randint(0, 4000), rng.randint(6000, 9000)]))
        rows.append((day, "/x", round(rng.gauss(0, 1), 2), None if rng.random() < 0.1 else rng.random()))
    return rows


@pytest.mark.parametrize("agg", ["mean", "median"])
@pytest.mark.parametrize("freq", ["D", "W", "M"])
@pytest.mark.parametrize(
    ("start", "end", "missing"),
    [(None, None, "fill"), ("2023-02-10", "2023-12-15", "ffill"), ("2022-12-20", "2024-02-03", "drop"),
     ("2022-12-20", None, "fill"), ("2023-01-05", "2024-01-31", "fill")],
)
def test_aggregation_equals_plain_python(spark, agg, freq, start, end, missing):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for cols in (["a"], ["a", "b"]):
        got = spark_series(df, cols, agg, freq, start, end, missing)
        assert_same(got, expected(rows, cols, agg, freq, start, end, missing))


@pytest.mark.parametrize(("freq", "periods", "first"), [("D", 60, (2024, 1, 6)), ("W", 10, (2024, 1, 7)), ("M", 3, (2024, 1, 31))])
def test_toy_periods(spark, freq, periods, first):
    got = spark_series(spark.createDataFrame(TOY, SCHEMA), "a", "mean", freq)
    assert len(got) == periods and min(got) == dt.date(*first)
    assert len(spark_series(spark.createDataFrame(TOY, SCHEMA), ["a", "b"], "mean", "D", None, None, "drop")) == 3


def test_end_is_midnight_and_empty_range(spark):
    df = spark.createDataFrame(TOY, SCHEMA)
    assert series.in_range(df, "date", "2024-01-06", "2024-01-08").count() == 3
    assert series.in_range(df, "date", None, "2024-01-07").count() == 1
    got = spark_series(df, "a", "mean", "M", "2020-01-01", "2020-03-31")
    assert got == {dt.date(2020, 1, 31): (None,), dt.date(2020, 2, 29): (None,), dt.date(2020, 3, 31): (None,)}


def test_keyed_equals_single(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("one"))
    other = df.withColumns({"k": F.lit("two"), "a": F.col("a") * 2})
    both = df.unionByName(other)
    for bounds in ((None, None), ("2022-12-20", "2024-02-03"), ("2023-02-10", "2023-08-15")):
        for missing in ("fill", "ffill", "drop"):
            out = series.aggregate_sentiment(both, "date", "a", "median", "W", *bounds, missing, ["k"]).collect()
            single = expected(rows, ["a"], "median", "W", *bounds, missing)
            for k, factor in (("one", 1), ("two", 2)):
                got = {r.period_end: r.a_median for r in out if r.k == k}
                assert set(got) == set(single)
                for day, (v,) in single.items():
                    assert got[day] == (None if v is None else pytest.approx(v * factor))


def test_text_numbers(spark):
    rows = [(dt.datetime(2024, 1, 1), "1.5"), (dt.datetime(2024, 1, 1), "x"), (dt.datetime(2024, 1, 1), "nan"), (None, "9")]
    df = spark.createDataFrame(rows, "date timestamp_ntz, a string")
    for agg in series.AGGREGATES:
        assert spark_series(df, "a", agg, "D") == {dt.date(2024, 1, 1): (1.5,)}


def test_bad_arguments(spark):
    df = spark.createDataFrame(TOY, SCHEMA)
    with pytest.raises(ValueError):
        series.aggregate_sentiment(df, "date", "a", "max")


def test_preprocessing_and_categories(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "/Inland/a", 1.0), ("01.12.2024 • 09:05 Uhr", "/ausland/a", 2.0), ("bad", "/inland/b", 3.0)],
        "date_api string, link string, a double",
    )
    out = series.preprocessed(df)
    assert {(r.date_api, r.inferred_category) for r in out.collect()} == {
        (dt.datetime(2024, 1, 1), "inland"), (dt.datetime(2024, 12, 1, 9, 5), "ausland")}
    assert series.filter_by_category(out, "all").count() == 2
    assert series.filter_by_category(out, "inland").count() == 1
    for agg in series.AGGREGATES:
        rows = series.category_series(out, "date_api", ["a"], agg, "M").collect()
        assert {(r.category, r.period_end.month): r[f"a_{agg}"] for r in rows} == {
            ("inland", 1): 1.0, ("all", 1): 1.0, ("ausland", 12): 2.0, ("all", 12): 2.0}


def test_ffill_leaves_only_leading_nulls(spark):
    rows = [(dt.date(2024, 1, d), v) for d, v in enumerate([None, None, 1.0, None, 3.0, None], 1)]
    out = series.forward_filled(spark.createDataFrame(rows, "period_end date, v double"))
    assert [r.v for r in out.orderBy("period_end").collect()] == [None, None, 1.0, 1.0, 3.0, 3.0]


# --- exact medians ----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["spread", "ties", "heavy_tail", "two_values", "sorted"])
def test_hot_group_median(spark, shape):
    """Groups of all sizes and shapes of values take one path; the result is exact."""
    rng = np.random.default_rng(7)
    n = 20_001
    values = {
        "spread": rng.normal(size=n),
        "ties": rng.integers(0, 3, n).astype(float),
        "heavy_tail": np.exp(rng.normal(size=n) * 20),
        "two_values": np.where(np.arange(n) < n // 2, -1.0, 1.0),
        "sorted": np.arange(n, dtype=float),
    }[shape]
    frames = {"hot": values, "even": values[:-1], "cold": values[:501], "pair": values[:2], "one": values[:1]}
    rows = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in frames.items()])
    rows = pd.concat([rows, pd.DataFrame({"k": ["hot", "none"], "v": [None, None]})])
    df = spark.createDataFrame(rows).repartition(5)
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-12) for k, v in frames.items()}


def test_close_values_are_never_in_one_window(spark, monkeypatch):
    """150,000 different values that share their first 20 bits: no window sees more than 2^16 rows."""
    seen, at_middle = [], median._at_middle
    monkeypatch.setattr(median, "_at_middle", lambda counts, *rest: seen.append(counts) or at_middle(counts, *rest))
    for sign in (1, -1):
        df = spark.range(150_000).select((sign * (1e9 + F.col("id") / 1000)).alias("v"))
        assert exact_median(df, [], "v", "m").first().m == pytest.approx(sign * (1e9 + 74.9995), rel=1e-15)
    assert max(counts.count() for counts in seen) <= 2**16


def test_median_with_null_key_and_odd_values(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(3001)], "k string, v double")
    assert exact_median(df, ["k"], "v", "m").first().m == 1500.0
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), None, 1.0, 2.0, 4.0, 1.0]
    for n in range(3, len(odd) + 1):
        kept = sorted(v for v in odd[:n] if v is not None and v == v)
        want = (kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2
        df = spark.createDataFrame([(1, v) for v in odd[:n]], "k int, v double")
        assert exact_median(df, ["k"], "v", "m").first().m == want


# --- correlograms -----------------------------------------------------------------------------


def acf_twin(x, nlags):
    d = np.asarray(x) - np.mean(x)
    c = [float(np.dot(d[k:], d[: len(d) - k])) for k in range(min(nlags, len(d) - 1) + 1)]
    return [v / c[0] for v in c]


def pacf_twin(x, nlags):
    """Last coefficient of the Yule-Walker equations of every order, covariances divided by n - k."""
    n = len(x)
    d = np.asarray(x) - np.mean(x)
    r = [float(np.dot(d[k:], d[: n - k])) / (n - k) for k in range(nlags + 1)]
    out = [1.0]
    for k in range(1, nlags + 1):
        matrix = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(matrix, np.array(r[1 : k + 1]))[-1]))
    return out


def ar(n, phi, seed):
    rng = np.random.default_rng(seed)
    x = [0.0]
    for e in rng.normal(size=n - 1):
        x.append(phi * x[-1] + e)
    return x


CASES = {"noise": ar(120, 0.0, 1), "ar": ar(200, 0.8, 2), "negative": ar(61, -0.6, 3), "short": ar(7, 0.3, 4), "two": [1.0, 2.0]}


def test_correlogram_equals_numpy(spark):
    rows = []
    for name, values in CASES.items():
        for i, v in enumerate(values):
            rows.append((name, dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), float(v)))
            if i % 5 == 0:
                rows.append((name, dt.date(2020, 1, 2) + dt.timedelta(days=2 * i), None))
    rows += [("constant", dt.date(2020, 1, d), 0.1) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "series string, period_end date, value double")
    out = correlogram.correlogram(df, ["series"], 30).collect()
    for name, values in CASES.items():
        mine = sorted((r for r in out if r.series == name), key=lambda r: r.lag)
        n = len(values)
        assert [r.lag for r in mine] == list(range(min(30, n - 1) + 1))
        assert [r.acf for r in mine] == pytest.approx(acf_twin(values, 30), abs=1e-10)
        top = min(30, (n + 1) // 2 - 1)
        assert [r.pacf for r in mine[: top + 1]] == pytest.approx(pacf_twin(values, top), abs=1e-8)
        assert all(r.pacf is None for r in mine[top + 1 :])
        assert mine[0].acf == 1.0 and all(abs(r.acf) <= 1 + 1e-12 for r in mine)
    constant = [r for r in out if r.series == "constant"]
    assert len(constant) == 7 and all(r.acf is None and r.pacf is None for r in constant)


def test_correlogram_of_wide_frames(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    a, b = ([float(v) for v in ar(40, phi, seed)] for phi, seed in ((0.5, 1), (-0.5, 2)))
    wide = spark.createDataFrame(list(zip(days, a, b)), "period_end date, a double, b double")
    both = correlogram.wide_correlogram(wide, 5).collect()
    listed = correlogram.wide_correlogram([wide.select("period_end", "a"), wide.select("period_end", "b")], 5).collect()
    assert sorted(both) == sorted(listed) and len(both) == 12
    for name, values in (("a", a), ("b", b)):
        mine = [r.acf for r in sorted(both, key=lambda r: r.lag) if r.measure == name]
        assert mine == pytest.approx(acf_twin(values, 5))
    with pytest.raises(ValueError):
        correlogram.wide_correlogram([wide, wide], 5)


def test_lag_pairs_match_lag_sums(spark):
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(ar(50, 0.5, 9))]
    df = spark.createDataFrame(rows, "series string, period_end date, value double")
    pairs = correlogram.lag_pairs(df, ["series"], 4).toPandas()
    mean = np.mean([r[2] for r in rows])
    sums = correlogram.lag_sums(df, ["series"], 4).first().sums
    for lag, part in pairs.groupby("lag"):
        assert len(part) == 50 - lag
        assert ((part.x - mean) * (part.lagged - mean)).sum() == pytest.approx(sums[lag])


@pytest.mark.parametrize("cut", ["1", "year(period_end)", "month(period_end) + 12 * year(period_end)", "floor(n / 3)", "n"])
def test_segments_of_any_cut_give_the_acf(spark, cut):
    """Summaries of pieces, single values included, united in order: equal to the correlogram of the whole series."""
    rng = np.random.default_rng(11)
    rows = [(s, n, dt.date(2020, 1, 1) + dt.timedelta(days=9 * n), v) for s, size in (("a", 90), ("b", 7), ("c", 1)) for n, v in enumerate(1000 + rng.normal(0, 30, size).cumsum())]
    rows += [("d", n, dt.date(2020, 1, 1) + dt.timedelta(days=n), 5.0) for n in range(9)] + [("a", 999, dt.date(2019, 1, 1), None)]
    df = spark.createDataFrame([(s, n, d, None if v is None else float(v)) for s, n, d, v in rows], "k string, n int, period_end date, value double")
    pieces = segments.summaries(df.withColumn("segment", F.expr(cut)), ["k"], "segment", 12, shift=900.0)
    got = {(r.k, r.lag): r.acf for r in segments.acf_of_summary(segments.whole_series(pieces, ["k"], 12), ["k"]).collect()}
    want = {(r.k, r.lag): r.acf for r in correlogram.acf(df, ["k"], 12).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-9)), key
