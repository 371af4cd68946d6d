"""Embedding near-dedup: int8 tile products with proven error bounds, full precision where they leave doubt.

Equal vectors become one class first. Classes of a label are cut into tiles; a task multiplies two
tiles of 8-bit codes, adds to each product a bound on what rounding may have taken away, and computes
the cosine in double precision only for pairs that may reach the threshold. Work is quadratic in the
number of different vectors of a label, as an exact answer without an index asks for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from zeitton.llm.text import known_id
from zeitton.llm.tiles import Linker, in_tiles, joined_classes, tile_links
from zeitton.session import stage

TILE = 4096
BLOCK = 1024  # rows of a product held at a time
EXACT_DIMS = 1024  # so many products of two codes add up exactly in a float
SLACK = 1e-9  # above the rounding of the bounds themselves


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers from -127 to 127), scale and error of unit vectors.

    The error is the length of what the codes miss: ``|u - scale * code|``.
    """
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None])
    error = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error


def upper_bounds(a: tuple, b: tuple) -> np.ndarray:
    """Cosines that pairs of quantised unit vectors cannot exceed.

    With ``u = U + e`` and ``v = V + f``: ``u.v = U.V + U.f + e.v``, and ``|U.f + e.v| <= (1 + |e|) |f| + |e|``.
    """
    (p, s, e), (q, t, f) = a, b
    dot = np.zeros((len(p), len(q)))
    for at in range(0, p.shape[1], EXACT_DIMS):
        dims = slice(at, at + EXACT_DIMS)
        dot += p[:, dims].astype(np.float32) @ q[:, dims].astype(np.float32).T
    dot *= s[:, None]
    dot *= t[None, :]
    dot += e[:, None] + (1 + e)[:, None] * f[None, :] + SLACK
    return dot


def linker(threshold: float) -> Linker:
    def linked(left: list[tuple], right: list[tuple], own: bool) -> tuple[np.ndarray, np.ndarray]:
        units = []
        for side in (left, right):
            vectors = np.array([r[0] for r in side], np.float64)
            vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square over- or underflows
            units.append(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        codes = [quantised(u) for u in units]
        found = []
        for at in range(0, len(left), BLOCK):
            for to in range(at if own else 0, len(right), BLOCK):
                part = [tuple(x[k : k + BLOCK] for x in c) for c, k in zip(codes, (at, to), strict=True)]
                i, j = np.nonzero(upper_bounds(*part) >= threshold)
                i, j = i + at, j + to
                if own:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 65536):
                    x, y = i[k : k + 65536], j[k : k + 65536]
                    near = np.einsum("ij,ij->i", units[0][x], units[1][y]) >= threshold
                    found.append((x[near], y[near]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *(f[k] for f in found)]) for k in (0, 1))

    return linked


def similar_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``df``.

    Two vectors of equal labels and lengths are linked if their cosine in double precision is at least
    ``threshold``. Null or empty vectors, zero vectors, vectors with a null, NaN or infinite component
    and vectors without a label link with nothing. ``n_links`` counts the others linked directly, copies
    included; ``component_id`` is the smallest id reached by links; ``kept`` says whether that is the
    row's own id. A null id counts as the smallest; repeated rows are vectors of their own. Other
    columns are ignored.
    """
    given = df.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = stage(given.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    key = ["label", "h1", "h2"]
    hashes = {f"h{k}": F.xxhash64(F.lit(k), F.col("vector")) for k in (1, 2)}
    sound = rows.where(usable).withColumns(hashes)
    equal = sound.groupBy(*key).agg(
        F.min(F.struct(known_id("vec_id").alias("key"), "row", "vec_id")).alias("first"), F.count("*").alias("copies")
    )
    equal = stage(equal.select(*key, F.col("first.row").alias("node"), "first", "copies"), "vector-classes")
    data = sound.join(equal.select(F.col("node").alias("row"), "copies"), "row").select(
        F.concat_ws("/", F.size("vector"), "label").alias("root"), F.col("row").alias("node"), "copies", "vector"
    )
    placed = in_tiles(data, TILE)
    judged = joined_classes(equal, tile_links(placed, ["vector"], linker(threshold)))
    out = rows.withColumns(hashes).where(usable).select("row", *key)
    mine = out.join(judged.select(*key, "n_links", "head"), key).select("row", "n_links", "head")
    component = F.when(F.col("head").isNull(), F.col("vec_id")).otherwise(F.col("head.vec_id"))
    return (
        rows.select("row", "vec_id")
        .join(mine, "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
