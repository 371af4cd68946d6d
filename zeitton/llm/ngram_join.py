"""N-gram Jaccard join with Bayesian pruning.

Equal texts become one class first. MinHash bands gather classes that may be similar, and the links
of bands are closed to candidate groups. Inside a group, cut into tiles so that a task never holds more
than two of them, MinHash values are compared a few at a time; a pair whose posterior probability of
reaching the threshold falls below the tolerance is dropped, and what remains is verified on the full
shingle sets. A task gives counts and a forest of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zeitton.llm.components import connected_components
from zeitton.llm.memory import lean
from zeitton.llm.packing import batches_of
from zeitton.llm.shingles import Powers, permutations, shingle_hashes, signatures
from zeitton.llm.text import SPACE, hash_pair, known_id, whole
from zeitton.llm.tiles import Linker, in_tiles, joined_classes, tile_links
from zeitton.session import stage

BANDS, BAND_ROWS = 42, 6  # at a similarity of 0.8 all bands miss a pair with probability 3e-6
HASHES = BANDS * BAND_ROWS
STEP = 28  # MinHash values compared between two looks at the posterior
TILE = 512
BATCH_BYTES = 1_000_000  # texts hashed together, at some fifty bytes of arrays for each of theirs


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = HASHES) -> list[int]:
    """After each step, the fewest equal MinHash values with which a pair stays.

    With a uniform prior, the similarity after ``m`` of ``n`` matches is Beta(m + 1, n - m + 1), and it
    reaches the threshold with the probability that of ``n + 1`` trials at most ``m`` succeed.
    """
    fewest = []
    for n in range(step, total + 1, step):
        posterior, m = 0.0, -1
        while posterior < tolerance:
            m += 1
            posterior += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return fewest


def surviving_pairs(a: np.ndarray, b: np.ndarray, own: bool, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (``own``: of one tile, each pair once) that no look at the posterior drops."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        equal += a[:, k, None] == b[None, :, k]
    alive = equal >= fewest[0]
    if own:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(alive)
    matches = equal[i, j]
    for at, least in enumerate(fewest[1:], 1):
        cut = slice(at * STEP, (at + 1) * STEP)
        matches = np.concatenate(
            [matches[:0]]
            + [matches[s : s + 65536] + (a[i[s : s + 65536], cut] == b[j[s : s + 65536], cut]).sum(1) for s in range(0, len(i), 65536)]
        )
        stays = matches >= least
        i, j, matches = i[stays], j[stays], matches[stays]
    return i, j


def shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for pairs of places.

    A few pairs are merged one by one. Where most pairs are asked for, the sets become rows of zeros
    and ones over blocks of shingles, and products of the blocks add up to all sizes.
    """
    if len(i) <= 2 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    values, column = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(values), 2048):
        lo, hi = np.searchsorted(column, [first, first + 2048])
        block = np.zeros((len(a) + len(b), 2048), np.float32)
        block[row[lo:hi], column[lo:hi] - first] = 1
        total += block[: len(a)] @ block[len(a) :].T
    return total[i, j].astype(np.int64)


def sketch(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """``row, doc_id, h1, h2, bands``: a number and a text hash per row; no bands for a text without words."""
    factors, shifts = permutations(HASHES, seed)

    @lean
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at, texts in batches_of(batch.column(3), BATCH_BYTES):
                hashes, places = shingle_hashes(texts, n, powers)
                found = signatures(hashes, places, factors, shifts).view(np.uint64).reshape(len(texts), BANDS, -1)
                keys = np.zeros(found.shape[:2], np.uint64)
                for k in range(found.shape[2]):  # three pairs of values a band
                    keys = (keys ^ found[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                keys ^= np.arange(BANDS, dtype=np.uint64) << np.uint64(58)
                size = np.where(np.diff(places) > 0, BANDS, 0)
                values = pa.array(keys[size > 0].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)
                rest = [batch.column(c).slice(at, len(texts)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=["doc_id", "h1", "h2", "bands"])

    h1, h2 = hash_pair(F.col("text"))
    out = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(
        bands, "doc_id bigint, h1 bigint, h2 bigint, bands array<bigint>"
    )
    return stage(out.select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``node, root``: classes that share a band directly or by others."""
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared_bands = bands.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared_bands = stage(shared_bands, "shared-bands")
    edges = bands.join(shared_bands, "band").where(F.col("node") != F.col("first"))
    return connected_components(edges.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())


def with_sets(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``root, tile, tiles, node, copies`` of candidates with their shingle set and signature as bytes."""
    factors, shifts = permutations(HASHES, seed)

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at, texts in batches_of(batch.column(5), BATCH_BYTES):
                hashes, places = shingle_hashes(texts, n, powers)
                values = signatures(hashes, places, factors, shifts)
                own = [np.unique(hashes[places[k] : places[k + 1]]).tobytes() for k in range(len(texts))]
                rest = [batch.column(c).slice(at, len(texts)) for c in range(5)]
                columns = [*rest, pa.array(own, pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "tile", "tiles", "node", "copies", "own", "sig"])

    return rows.select("root", "tile", "tiles", "node", "copies", "text").mapInArrow(
        sets, "root bigint, tile bigint, tiles bigint, node bigint, copies bigint, own binary, sig binary"
    )


def linker(threshold: float, tolerance: float) -> Linker:
    fewest, percent = least_matches(threshold, tolerance), round(100 * threshold)

    def linked(left: list[tuple], right: list[tuple], own: bool) -> tuple[np.ndarray, np.ndarray]:
        sets = [[np.frombuffer(r[0], np.uint64) for r in side] for side in (left, right)]
        values = [np.array([np.frombuffer(r[1], np.uint32) for r in side]) for side in (left, right)]
        i, j = surviving_pairs(*values, own, fewest)
        sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
        common = shared(*sets, i, j)
        linked = 100 * common >= percent * (sizes[0][i] + sizes[1][j] - common)
        return i[linked], j[linked]

    return linked


def similar_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-9,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, h1, h2, class_id, n_links, kept``, one row per row of ``df``; ``h1, h2`` hash the text.

    Documents are linked if the Jaccard similarity of their sets of ``n``-word shingles (words are runs
    without white space, case counts; a shorter text is one shingle of all its words) is at least
    ``threshold``, given in hundredths. ``n_links`` counts the other documents linked directly, copies
    included; ``class_id`` is the smallest id reached by links; one row of each class, the first with
    that id, is ``kept``. Texts without words, null among them, link with nothing. A null id counts as
    the smallest; repeated rows are documents of their own. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    rows = sketch(docs, n, seed)
    worded = rows.where(F.size("bands") > 0)
    named = worded.select("h1", "h2", F.struct(known_id("doc_id").alias("key"), "row", "doc_id").alias("first"))
    equal = named.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("copies"))
    equal = stage(equal.select("h1", "h2", F.col("first.row").alias("node"), "first", "copies"), "classes")
    classes = worded.select("row", "bands").join(equal.select(F.col("node").alias("row")), "row")
    groups = candidate_groups(classes.select(F.col("row").alias("node"), "bands"))
    placed = in_tiles(groups, TILE)
    h1, h2 = hash_pair(F.col("text"))
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), known_id("doc_id").alias("key"), "text")
    wanted = placed.join(equal, "node").select("h1", "h2", F.col("first.key").alias("key"), "root", "tile", "tiles", "node", "copies")
    candidates = texts.join(wanted, ["h1", "h2", "key"])
    candidates = candidates.dropDuplicates(["node"])  # a row may be repeated with its id
    found = tile_links(with_sets(candidates, n, seed), ["own", "sig"], linker(threshold, tolerance))
    judged = joined_classes(equal, found).select("h1", "h2", "n_links", "head")
    out = rows.select("row", "doc_id", "h1", "h2").join(judged, ["h1", "h2"], "left")
    head = F.col("head")
    return out.select(
        "doc_id",
        "h1",
        "h2",
        F.when(head.isNull(), F.col("doc_id")).otherwise(head["doc_id"]).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(head["row"] == F.col("row"), F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept, one of each class, repeated rows once; see ``similar_documents``.

    Rows without words are in no class: every one stays, repeated ones included.
    """
    has_words = F.rlike(whole(text_col), F.lit(rf"[^{SPACE}]"))
    df, wordless = df.where(has_words), df.where(~has_words)
    h1, h2 = hash_pair(whole(text_col))
    keys = ["__key", "__h1", "__h2"]
    rows = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("__row"), known_id(id_col).alias(keys[0]), h1.alias(keys[1]), h2.alias(keys[2])
    )
    kept = similar_documents(df, id_col, text_col, **options).where("kept")
    kept = kept.select(known_id("doc_id").alias(keys[0]), F.col("h1").alias(keys[1]), F.col("h2").alias(keys[2]))
    # Rows come from the join in the order of their keys, so taking one of each needs no other exchange.
    first = rows.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first("__row").alias("__row"))
    return first.select("__row.*").unionAll(wordless)
