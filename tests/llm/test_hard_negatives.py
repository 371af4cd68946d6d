"""Hard negatives against scoring all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zeitton.llm import hard_negatives as module
from zeitton.llm.hard_negatives import Walk, bounds, centres_of, mine, products

ROW = "vec_id bigint, label int, vector array<bigint>, row bigint, slots string"


def expected(rows):
    """Rows of the result; each row of the table is its own."""
    rows = [(n, *r) for n, r in enumerate(rows) if None not in r and None not in r[2]]

    def score(a, b):
        return sum(x * y for x, y in zip(a[3], b[3], strict=False))

    out = []
    for a in rows:
        if a[1] % 10:
            continue
        ranked = sorted(((-score(a, b), b[1], b[0], b[2]) for b in rows if b[0] != a[0]), key=lambda r: r[:3])
        for p in [r for r in ranked if r[3] == a[2]][:5]:
            fits = [r for r in ranked if r[3] != a[2] and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:10]
            out += [(a[1], p[1], k, r[1], -p[0], -r[0]) for k, r in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], ROW).repartition(3)
    got = mine(df, "vec_id", "vector", "label", F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == expected(rows)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"CLUSTER": 3, "GROUP": 4, "SLICE": 50, "MAX_SLICES": 3, "CHUNK": 8}.items():
        monkeypatch.setattr(module, name, value)


def drawn(seed, n, labels, dims=6, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-90, 90, (labels, dims))
    return [(i, int(k), (centres[k] + rng.integers(-spread, spread, dims)).tolist()) for i, k in enumerate(rng.integers(0, labels, n))]


def test_all_rows_are_found(spark, small):
    check(spark, drawn(1, 400, 5, spread=90))


def test_odd_rows(spark, small):
    rows = drawn(2, 120, 3)
    rows += [(None, 1, [1] * 6), (200, None, [1] * 6), (210, 1, None), (220, 1, [1, None, 3, 4, 5, 6]), (230, 1, []), (240, 2, [0] * 6)]
    rows += [(250, 0, [9, 9]), (260, 9, [5] * 6), (300, 1, [2, 1]), (310, 1, [3, 1, 0])]
    check(spark, rows)


def test_ties_and_a_label_of_a_third(spark, small):
    rows = [(i, 0 if i % 3 else i % 4, [i % 2 + 1, 3, 1 - i % 5]) for i in range(150)]
    check(spark, rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], 1, "s")], ROW)
    assert mine(df, "vec_id", "vector", "label", F.col("vec_id") % 10 == 0).collect() == []
    assert mine(df.limit(0), "vec_id", "vector", "label", F.lit(True)).collect() == []


def test_bounds_hold_and_walks_end_early():
    rng = np.random.default_rng(4)
    anchors, rows = rng.normal(0, 100, (40, 8)), rng.normal(0, 100, (500, 8))
    anchors[:20] = anchors[0] + rng.normal(0, 5, (20, 8))
    centres = centres_of(anchors, 4)
    apart = module.angles(anchors, centres)
    own = apart.argmin(axis=1)
    radii = np.array([apart[own == c, c].max(initial=0) for c in range(4)])
    reach = bounds(rows, centres, radii)
    norms = np.linalg.norm(anchors, axis=1)
    for i, c in enumerate(own):
        assert (rows @ anchors[i] <= reach[:, c] * norms[i] + 1e-6).all()
    first = np.rint(anchors[:1]).astype(np.int64)
    zero = np.zeros(1, np.int64)
    walk = Walk(first, zero - 1, ["a"], zero, zero, zero + module.LEAST, zero + 2**62, 5, True)
    order = np.argsort(-reach[:, own[0]])
    whole = np.rint(rows).astype(np.int64)
    walked = 0
    for at in range(0, 500, 20):
        if not len(walk.open_slots(reach[order[at], own[0]])):
            break
        some = order[at : at + 20]
        walk.offer(whole[some], some, some, ["a"] * 20, zero)
        walked += 20
    assert walked < 400
    assert sorted(walk.best[:, 1].tolist()) == sorted((whole @ first[0]).tolist())[-5:]


def test_products_are_exact():
    big = np.array([[2**30, 3]], np.int64)
    assert products(big, big).tolist() == [[2**60 + 9]]
    with pytest.raises(OverflowError):
        products(big << 3, big)
