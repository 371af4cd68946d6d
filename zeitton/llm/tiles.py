"""All pairs inside groups, as products of tiles.

A group is cut into tiles of bounded size, so a task holds two tiles whatever the size of the group,
and gives one row per node with links instead of the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from zeitton.llm.components import connected_components, forest
from zeitton.llm.memory import lean
from zeitton.session import stage

LINKS = "node bigint, links bigint, parent bigint"
# Payloads of the left and of the right tile, and whether they are the same one: linked places.
Linker = Callable[[list[tuple], list[tuple], bool], tuple[np.ndarray, np.ndarray]]


def in_tiles(members: DataFrame, size: int) -> DataFrame:
    """``root, node`` with the number of tiles of the group and the tile of the node."""
    tiles = stage(members.groupBy("root").agg(F.ceil(F.count("*") / size).alias("tiles")), "tiles")
    return members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))


def tile_links(rows: DataFrame, payload: list[str], linker: Linker) -> DataFrame:
    """``node, links, parent`` from ``root, tile, tiles, node, copies`` and the payload.

    Per pair of tiles and node with links: the copies of the nodes linked with it, and the smallest
    node of those it reaches there.
    """
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    pairs = rows.withColumn("other", other).select(
        "root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "copies", *payload
    )

    def linked(rows: list[tuple], i: int, j: int) -> pd.DataFrame:
        rows.sort(key=lambda r: r[1])
        tile, node, copies = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        x, y = linker([rows[k][3:] for k in left], [rows[k][3:] for k in right], i == j)
        x, y = left[x], right[y]
        links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        frame = pd.DataFrame({"node": node, "links": links.astype(np.int64), "parent": node[forest(x, y, len(rows))]})
        return frame[frame.links > 0]

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for frame in frames:
            for r in frame.itertuples(index=False, name=None):
                if r[:3] != key:
                    if len(rows) > 1:
                        yield linked(rows, *key[1:])
                    key, rows = r[:3], []
                rows.append(r[3:])
        if len(rows) > 1:
            yield linked(rows, *key[1:])

    dealt = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInPandas(run, LINKS)


def joined_classes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` (``node, first, copies, ...``) with ``n_links`` and ``head``, the least ``first`` of the component."""
    found = stage(found.groupBy("node", "parent").agg(F.sum("links").alias("links")), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    joined = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = stage(joined.groupBy("root").agg(F.min("first").alias("head")), "heads")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return joined.join(heads, "root").withColumn("n_links", n_links).drop("links", "root")
