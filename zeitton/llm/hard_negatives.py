"""Hard negatives: rows of other labels whose scores come close to those of an anchor's best rows of its own label.

Anchors are clustered by direction, and every cluster has one list of candidates, sorted once by a bound on the
scores they can reach: the candidate's length times the cosine of its angle to the cluster's centre less the
cluster's radius. All members walk that list; a member stops where the bound of what follows, times its own
length, is below what it still needs, which proves that nothing was missed. A list is walked in a fixed number of
slices, whose few best rows are joined. Candidates that no member of a cluster can need are not shuffled.

The first walk, over lists by label, finds the positives; the second one, over lists of all rows, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from zeitton.session import stage

CLUSTER = 64  # anchors per cluster, about
MAX_CLUSTERS = 1024
SAMPLE = 4096  # anchors that the centres are fitted to, at most
ROUNDS = 8  # of fitting
GROUP = 1024  # members of a cluster that walk together
SLICE = 65_536  # candidates of a list walked by one task, while there are few
MAX_SLICES = 32
CHUNK = 512  # candidates scored at a time
SLACK = 1e-9  # relative; above the rounding of bounds
LEAST = -(2**63)

SLOTS = "array<struct<slot:int,low:bigint,high:bigint>>"
LISTED = f"cluster int, part int, slice int, label string, bound double, row bigint, id bigint, vector array<bigint>, own string, slots {SLOTS}"
WALKED = "anchor bigint, slot int, row bigint, id bigint, score bigint"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def centres_of(vectors: np.ndarray, count: int) -> np.ndarray:
    """Directions that the vectors gather around: spherical k-means from evenly spaced rows."""
    units = unit_rows(vectors)
    centres = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, np.argmax(units @ centres.T, axis=1), units)
        moved = unit_rows(sums)
        centres = np.where(np.any(moved != 0, axis=1, keepdims=True), moved, centres)
    return centres


def angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(vectors) @ centres.T, -1, 1))


def bounds(vectors: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Per candidate and cluster: what a member of length 1 can score at most."""
    least = np.maximum(0, angles(vectors, centres) - radii[None, :] - 1e-7)
    reach = np.linalg.norm(vectors, axis=1)[:, None] * np.cos(least)
    return reach + np.abs(reach) * SLACK


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones go on with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    rows = np.zeros((len(sizes), dims), np.int64)
    rows[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return rows


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles while sums stay below 2^53, else as long numbers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise OverflowError("scores may not fit a long number")


@dataclass
class Walk:
    """The members of one list, what each of their slots still needs, and the ``k`` best rows of every slot so far.

    A slot takes rows with scores from ``low`` to ``high``; of those the higher scores, then the smaller ids.
    """

    members: np.ndarray
    rows: np.ndarray
    labels: list[str]
    member: np.ndarray  # of each slot
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool  # rows of the member's own label, or of others

    def __post_init__(self):
        self.norms = np.linalg.norm(self.members.astype(np.float64), axis=1)[self.member]
        self.need = self.low.copy()
        self.codes = {label: code for code, label in enumerate(sorted(set(self.labels)))}
        self.own = np.array([self.codes[label] for label in self.labels])
        self.best = np.zeros((0, 4), np.int64)  # slot, score, id, row

    def open_slots(self, bound: float) -> np.ndarray:
        """Slots that rows of this bound may still serve."""
        reach = self.norms * bound
        return np.flatnonzero(reach + np.abs(reach) * SLACK + SLACK >= self.need)

    def offer(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: list[str], slots: np.ndarray) -> None:
        codes = np.array([self.codes.get(label, -1) for label in labels])
        who, place = np.unique(self.member[slots], return_inverse=True)
        scores = products(self.members[who], vectors)
        fits = (self.own[who][:, None] == codes[None, :]) == self.same
        fits &= self.rows[who][:, None] != rows[None, :]
        mine = scores[place]
        taken = fits[place] & (mine >= self.need[slots][:, None]) & (mine <= self.high[slots][:, None])
        i, j = np.nonzero(taken)
        pool = np.concatenate([self.best, np.column_stack([slots[i], mine[i, j], ids[j], rows[j]])])
        pool = pool[np.lexsort((pool[:, 3], pool[:, 2], ~pool[:, 1], pool[:, 0]))]
        begins = np.flatnonzero(np.diff(pool[:, 0], prepend=-1))
        rank = np.arange(len(pool)) - np.repeat(begins, np.diff(np.append(begins, len(pool))))
        self.best = pool[rank < self.k]
        last = pool[rank == self.k - 1]
        self.need[last[:, 0]] = last[:, 1]

    def found(self) -> pa.RecordBatch:
        slot = self.best[:, 0]
        columns = [
            pa.array(self.rows[self.member[slot]]), pa.array(self.slot[slot].astype(np.int32)),
            pa.array(self.best[:, 3]), pa.array(self.best[:, 2]), pa.array(self.best[:, 1]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "row", "id", "score"])


def walk_lists(listed: DataFrame, k: int, same: bool, dims: int) -> DataFrame:
    """The ``k`` best rows of every slot, from members and candidates by list and slice."""

    keys = ["cluster", "part", "slice", "label"]

    def begun(rows: pa.Table) -> Walk:
        slots = rows.column("slots").to_pylist()
        member = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        flat = [s for some in slots for s in some]
        slot, low, high = (np.array([s[name] for s in flat], np.int64) for name in ("slot", "low", "high"))
        vectors = dense(rows.column("vector").combine_chunks(), dims)
        return Walk(vectors, rows.column("row").to_numpy(), rows.column("own").to_pylist(), member, slot, low, high, k, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, walk = None, [], None
        for batch in batches:
            columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in keys]
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                own = tuple(c[at] for c in columns)
                if own != key:
                    if walk:
                        yield walk.found()
                    key, waiting, walk = own, [], None
                some = pa.Table.from_batches([batch.slice(at, end - at)])
                is_member = some.column("slots").is_valid()
                if members := some.filter(is_member):
                    waiting.append(members)
                others = some.filter(pc.invert(is_member))
                if not len(others) or not waiting:
                    continue  # without members there is nobody to walk
                walk = walk or begun(pa.concat_tables(waiting))
                for to in range(0, len(others), CHUNK):
                    part = others.slice(to, CHUNK)
                    slots = walk.open_slots(part.column("bound")[0].as_py())
                    if not len(slots):
                        break  # bounds fall: all that follows is proven to be of no use
                    walk.offer(
                        dense(part.column("vector").combine_chunks(), dims), part.column("row").to_numpy(),
                        part.column("id").to_numpy(), part.column("own").to_pylist(), slots,
                    )
        if walk:
            yield walk.found()

    falling = F.col("bound").desc_nulls_first()  # members first
    walked = listed.repartition(*keys).sortWithinPartitions(*keys, falling).mapInArrow(run, WALKED)
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "row")
    return walked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def listed_rows(
    rows: DataFrame, members: DataFrame, centres: np.ndarray, radii: np.ndarray, cuts: np.ndarray, parts: np.ndarray,
    slices: int, dims: int, by_label: bool,
) -> DataFrame:
    """Members of all lists, once per slice, and the candidates that some member of a cluster may need."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 32_768 // int(parts.sum()))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                row = some.column("row").to_numpy()
                reach = bounds(dense(some.column("vector"), dims).astype(np.float64), centres, radii)
                place, cluster = np.nonzero(reach >= cuts[None, :])
                bound, often = reach[place, cluster], parts[cluster]
                part = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
                place, cluster, bound = (np.repeat(x, often) for x in (place, cluster, bound))
                taken = some.take(pa.array(place))
                none = pa.nulls(len(place), pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))
                label = taken.column("label")
                columns = [
                    pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((row[place] % slices).astype(np.int32)),
                    label if by_label else pa.array([""] * len(place), pa.string()), pa.array(bound),
                    taken.column("row"), taken.column("id"), taken.column("vector"), label, none,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["cluster", "part", "slice", "label", "bound", "row", "id", "vector", "own", "slots"]
    slice_of = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    listed = members.select(
        "cluster", "part", slice_of.alias("slice"), F.col("label").alias("own"), F.lit(None).cast("double").alias("bound"), "row", "id", "vector", "slots"
    ).withColumn("label", F.col("own") if by_label else F.lit(""))
    return listed.select(*names).unionByName(rows.select("row", "id", "label", "vector").mapInArrow(candidates, LISTED))


def mine(
    df: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column,
    positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of vectors of whole numbers; a shorter vector goes on with zeros. Higher scores come
    first, then smaller ids. The positives of an anchor are the first ``positives`` other rows of its label. For each
    of them the first ``negatives`` rows of other labels are returned whose scores lie between ``low_percent`` and ``high_percent`` of
    the positive's, both included. Rows with a null id, label, vector or component take no part; repeated rows
    are rows of their own (one may be the other's positive). Scores beyond a long number raise an error. Other columns are
    left out; without rows or anchors the result is empty.

    Centres are fitted to ``SAMPLE`` anchors at most, those of the least hashes; every row is listed and every anchor walks.
    """
    given = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).dropna(subset=["id", "label", "vector"]).where(F.forall("vector", lambda x: x.isNotNull()))
    rows = stage(given.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    anchors = rows.where("anchor")
    whole = rows.agg(F.max(F.size("vector")).alias("dims"), F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    dims, slices = whole["dims"] or 0, min(MAX_SLICES, -(-whole["rows"] // SLICE)) or 1
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    fitted = dense(sample, dims).astype(np.float64) if len(sample) else np.zeros((1, dims))
    centres = centres_of(fitted, max(1, min(MAX_CLUSTERS, -(-whole["anchors"] // CLUSTER), len(fitted))))

    @F.pandas_udf("struct<cluster:int,angle:double,norm:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        points = dense(pa.array(vectors, pa.list_(pa.int64())), dims).astype(np.float64)
        apart = angles(points, centres)
        cluster = apart.argmin(axis=1)
        return pd.DataFrame({"cluster": cluster, "angle": apart[np.arange(len(points)), cluster], "norm": np.linalg.norm(points, axis=1)})

    placed = stage(anchors.withColumn("at", nearest("vector")).select("row", "id", "label", "vector", "at.*"), "anchors")
    radii, parts = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # MAX_CLUSTERS rows at most
        radii[r["cluster"]], parts[r["cluster"]] = r["radius"], -(-r["n"] // GROUP)
    part = F.pmod(F.xxhash64("row"), F.element_at(F.lit(parts.tolist()).cast("array<bigint>"), F.col("cluster") + 1)).cast("int")
    members = placed.withColumn("part", part)

    def slots(slot: Column, low: Column, high: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    any_score = F.array(slots(F.lit(0), F.lit(LEAST), F.lit(2**63 - 1)))
    everywhere = np.full(len(centres), -np.inf)
    lists = listed_rows(rows, members.withColumn("slots", any_score), centres, radii, everywhere, parts, slices, dims, True)
    first = stage(walk_lists(lists, positives, True, dims).select("anchor", "rank", "id", "score"), "positives")

    # low * p <= 100 * n <= high * p, for whole n; a negative p allows none.
    p = F.col("score").cast("decimal(20,0)")
    ends = {"low": F.ceil(p * low_percent / 100).cast("bigint"), "high": F.floor(p * high_percent / 100).cast("bigint")}
    windows = first.where("score >= 0").withColumns(ends).where("low <= high")
    by_anchor = windows.groupBy("anchor").agg(F.collect_list(slots(F.col("rank"), F.col("low"), F.col("high"))).alias("slots"))
    seekers = stage(members.join(by_anchor.withColumnRenamed("anchor", "row"), "row"), "seekers")
    needed = F.when(F.col("norm") > 0, F.array_min(F.transform("slots", lambda s: s["low"])) / F.col("norm"))
    cuts = np.full(len(centres), np.inf)  # a cluster without seekers needs no candidates
    for r in seekers.groupBy("cluster").agg(F.min(F.coalesce(needed, F.lit(float("-inf")))).alias("cut")).collect():
        cuts[r["cluster"]] = r["cut"] - abs(r["cut"]) * SLACK
    lists = listed_rows(rows, seekers, centres, radii, cuts, parts, slices, dims, False)
    second = walk_lists(lists, negatives, False, dims).select(
        "anchor", F.col("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = first.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        second.join(named, ["anchor", "slot"])
        .join(placed.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
