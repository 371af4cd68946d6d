"""Embedding links against double precision over all pairs."""

import numpy as np

from zeitton.llm import embedding_dedup
from zeitton.llm.components import connected_components
from zeitton.llm.embedding_dedup import quantised, similar_vectors, upper_bounds

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def test_bounds_hold():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, 70))
    vectors[::3] = vectors[0] + draw.normal(size=(100, 70)) * 0.05
    vectors[7] = 0.0
    vectors[7, 3] = 1.0
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    codes = quantised(units)
    bound, true = upper_bounds(codes, codes), units @ units.T
    assert (bound >= true).all() and (bound - true).max() < 0.15


def rows():
    draw = np.random.default_rng(4)
    out = []
    for label in (0, 1):
        for _ in range(6):
            center = draw.normal(size=16)
            out += [(center + draw.normal(size=16) * 0.14, label) for _ in range(12)]
    out += [(out[0][0], 0), (out[0][0], 1), (out[0][0], None), (out[0][0] * 3, 0), (out[0][0] * 1e-30, 0)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [1.0] * 15, [1.0] * 8]
    vectors = [([float(np.float32(x)) for x in v], label) for v, label in out] + [(v, 0) for v in odd]
    return [(i, v, label, "x") for i, (v, label) in enumerate(vectors)]


def expected(data):
    def sound(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    unit = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab, _ in data if sound(v) and lab is not None}
    links = {
        i: [j for j, (w, m) in unit.items() if j != i and m == lab and len(w) == len(u) and u @ w >= 0.93]
        for i, (u, lab) in unit.items()
    }
    label, changed = {i: i for i, *_ in data}, True
    while changed:
        new = {i: min([label[i], *(label[j] for j in links.get(i, ()))]) for i in label}
        label, changed = new, new != label
    return {i: (len(links.get(i, ())), label[i], label[i] == i) for i in label}


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 9)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    data = rows()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found == expected(data)
    assert len({v[1] for v in found.values()}) < len(data) - 30


def test_repeated_rows_null_ids_and_empty_table(spark):
    data = [(5, [1.0, 0.0], 1, ""), (5, [1.0, 0.0], 1, ""), (None, [2.0, 0.0], 1, ""), (6, [0.0, 1.0], 1, "")]
    found = similar_vectors(spark.createDataFrame(data, SCHEMA))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found.collect()) == [(0, 2, None), (5, 2, None), (5, 2, None), (6, 0, 6)]
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 300)]
    edges = [*chain, *star, (7, 7), (1, 2), (2, 1), (1, 2)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(200, 300), 200), 1: 1, 2: 1}
