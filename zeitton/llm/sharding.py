"""Sharding: a uniform shuffle with exact shard sizes.

How many rows of an input partition go to each shard is drawn beforehand: the rows of the
communication matrix are multivariate hypergeometric. Each partition permutes its labels, rows are
exchanged, and each shard is permuted again. A shard is permuted in blocks chosen at random by its
rows, so no task holds a shard; counts of blocks give the offsets of slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from zeitton.session import stage

BLOCK_ROWS = 100_000  # about so many rows are permuted in one group
SAFE = 10**9 - 1  # the generator's own bound on a population


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good items among ``n`` drawn. Beyond the generator's bound by inversion around the mode."""
    if good + bad <= SAFE:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = int(40 * (1 + (n * share * (1 - share)) ** 0.5))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # P(k + 1) / P(k)
    log = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    total = np.cumsum(np.exp(log - log.max()))
    return first + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows of each partition for each shard. Row sums are ``counts``, column sums ``sizes``."""
    rng, left = np.random.default_rng(seed), list(sizes)
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, count in enumerate(counts):
        for j in range(len(sizes)):
            rest = sum(left[j + 1 :])
            matrix[i, j] = hypergeometric(rng, left[j], rest, count)
            count -= int(matrix[i, j])
            left[j] -= int(matrix[i, j])
    return matrix


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """All columns of ``df`` with ``shard`` and ``slot``: a uniform permutation, shard sizes at most one apart.

    The first ``rows % n_shards`` shards have one row more; slots of a shard are 0, 1, 2 and so on.
    Rows are never compared, so nulls, equal rows and groups of equal texts need no rule: each row is
    placed on its own. Columns named ``shard`` or ``slot`` are replaced. An empty table gives an empty one.
    """
    given = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    stored = stage(given, "rows-to-shard")  # from here on a row's partition and number are fixed
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    parts, total = sorted(counts), sum(counts.values())
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    rows_of = dict(zip(parts, communication_matrix([counts[p] for p in parts], sizes, seed), strict=True))
    n_blocks = max(1, -(-sizes[0] // BLOCK_ROWS))

    @F.pandas_udf("shard int, draw bigint")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            at = batch.to_numpy()
            shard, draw = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
            for p in np.unique(at >> 33).tolist():
                if p not in held:  # rows of a partition are read together, so one permutation is held
                    rng = np.random.default_rng([seed, p])
                    labels = rng.permutation(np.repeat(np.arange(n_shards, dtype=np.int32), rows_of[p]))
                    held = {p: (labels, rng.integers(0, 2**62, len(labels)))}
                mine = at >> 33 == p
                i = at[mine] & (2**33 - 1)
                shard[mine], draw[mine] = held[p][0][i], held[p][1][i]
            yield pd.DataFrame({"shard": shard, "draw": draw})

    def labelled(columns: list[str]) -> DataFrame:
        drawn = stored.select(*columns, "at", label("at").alias("to"))
        return drawn.select(*columns, "at", "to.shard", "to.draw", (F.col("to.draw") % n_blocks).alias("block"))

    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        labelled([])
        .groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("draw", "at")) - 1
    placed = labelled(["row"]).withColumn("rank", rank).join(offsets, ["shard", "block"])
    others = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*others, "shard", (F.col("offset") + F.col("rank")).alias("slot"))
