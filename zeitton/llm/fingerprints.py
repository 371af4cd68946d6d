"""Document fingerprints: every shingle hash below a fixed share of all hashes.

The share is the same for all texts, so a fingerprint grows with its text, the fingerprint of a union is the
union of fingerprints, and the part of a short text that a very long one contains can be read off both.
A text whose hashes all lie above keeps its smallest one, so only texts without words have none.

For comparisons with the next document, rows are dealt to parts by ranges of their key, and the first row
of a part goes to the part before it as well. A task then sees neighbours side by side, and texts are
shuffled once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from zeitton.llm.packing import batches_of
from zeitton.llm.shingles import Powers, shingle_hashes
from zeitton.llm.text import known_id, whole

SHARE = 8  # one hash in so many stays
WORDS = 5  # of a shingle
PART_BYTES = 64_000_000  # texts of a part, at most about
PARTS_PER_TASK = 4
BATCH_BYTES = 2_000_000  # texts hashed side by side; hashing holds some fifty bytes for each
U = np.uint64


def fingerprints(texts: pa.Array, words: int, share: int, powers: Powers) -> list[np.ndarray]:
    """The sorted hashes that each text keeps."""
    found: list[np.ndarray] = []
    limit = U(2**64 // share)
    for _, some in batches_of(texts, BATCH_BYTES):
        hashes, places = shingle_hashes(some, words, powers)
        low = hashes < limit
        ends = np.concatenate([[0], np.cumsum(low)])[places]
        kept = hashes[low]
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            own = np.unique(kept[a:b])
            if not len(own) and places[i] < places[i + 1]:
                own = hashes[places[i] : places[i + 1]].min(keepdims=True)
            found.append(own)
    return found


def merged(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The fingerprint of two texts' shingles together; a smallest hash above the limit yields to others."""
    both = np.union1d(a, b)
    low = both[both < U(2**64 // share)]
    return low if len(low) else both[:1]


def as_text(fingerprint: np.ndarray) -> str:
    """Sixteen hexadecimal digits per hash, ascending."""
    return fingerprint.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of the smaller fingerprint that the larger one contains; 1 for two without hashes, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``doc_id, fingerprint``, one row per row of ``df``, without a shuffle.

    A fingerprint holds the hashes of all ``words``-word shingles below ``2^64 / share``, or the smallest one if none is;
    a text of fewer words is one shingle. It is text of sixteen hexadecimal digits per hash: equal texts have equal ones. A null, empty or blank text has an
    empty one. Null ids stay null; repeated rows are kept; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            shown = [as_text(f) for f in fingerprints(batch.column(1), words, share, powers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=["doc_id", "fingerprint"])

    given = df.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id bigint, fingerprint string")


def hashes_in(shown: Column) -> Column:
    """The hashes of a fingerprint as an array of texts."""
    return F.filter(F.split(F.regexp_replace(shown, "(.{16})", "$1,"), ","), lambda x: x != "")


def containment(a: Column, b: Column) -> Column:
    """The part of the shingles of ``a`` that ``b`` contains, as estimated from two fingerprints."""
    shared = F.size(F.array_intersect(hashes_in(a), hashes_in(b)))
    return F.when(F.length(a) == 0, F.lit(1.0)).otherwise(shared * 16 / F.length(a))


def dealt_to_parts(df: DataFrame, key: list[str], size: Column) -> DataFrame:
    """``df`` with ``part`` and ``ahead``: ranges of the key, each with the first row of the next range.

    The last range gets the first row of all, after its own. Cuts are one key per part, so they number one per
    ``PART_BYTES`` of texts or a few per task.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(total["rows"], max(PARTS_PER_TASK * tasks, (total["bytes"] or 0) // PART_BYTES)))
    ranged = df.select(*key).repartitionByRange(parts, *key).withColumn("__part", F.spark_partition_id())
    firsts = ranged.groupBy("__part").agg(F.min(F.struct(*key)).alias("first"))
    cuts = sorted(tuple(r["first"]) for r in firsts.collect())  # one row per part
    places = np.array(cuts, np.int64).reshape(-1, len(key))

    @F.pandas_udf("array<int>")
    def parts_of(*columns: pd.Series) -> pd.Series:
        """The part of a row, and for the first row of a part the one before it."""
        own = list(map(tuple, places.tolist()))
        out = []
        for row in zip(*(c.tolist() for c in columns), strict=True):
            part = bisect_right(own, row) - 1
            out.append([part, (part - 1) % len(own)] if own[part] == row else [part])
        return pd.Series(out)

    split = df.withColumn("__parts", parts_of(*key)).select("*", F.posexplode("__parts").alias("ahead", "part"))
    return split.drop("__parts").repartition("part")


def with_next(df: DataFrame, schema: str, judge: Callable[[list, list[str], list[str]], pa.RecordBatch]) -> DataFrame:
    """Rows made by ``judge`` from ids, texts and the next documents' texts.

    ``df`` has ``doc_id`` and ``text``; the order is by id, a null id first, then by a hash of the text, and the first document follows the last.
    Of rows with equal id and text each follows another, in the order of the stored rows, so ``df`` must be read from a table.
    """
    key = ["__id", "__tie", "__row"]
    rows = df.select(
        "doc_id", "text", known_id("doc_id").alias("__id"), F.xxhash64("text").alias("__tie"),
        F.monotonically_increasing_id().alias("__row"),
    )
    dealt = dealt_to_parts(rows, key, F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at, texts in batches_of(batch.column(1), BATCH_BYTES):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                part, ahead = (batch.column(k).slice(at, len(texts)).to_pylist() for k in (2, 3))
                lined = list(zip(ids, texts.to_pylist(), part, ahead, strict=True))
                if last:
                    lined.insert(0, last)
                last = lined[-1]
                pairs = [(a, b) for a, b in zip(lined[:-1], lined[1:], strict=True) if not a[3]]
                if any(a[2] != b[2] for a, b in pairs):
                    raise RuntimeError("a part lacks its last neighbour: the table changed between two scans")
                if pairs:
                    yield judge([a[0] for a, _ in pairs], [a[1] for a, _ in pairs], [b[1] for _, b in pairs])
        if last and not last[3]:
            raise RuntimeError("a part lacks its last neighbour: the table changed between two scans")

    ordered = dealt.sortWithinPartitions("part", "ahead", *key).select("doc_id", "text", "part", "ahead")
    return ordered.mapInArrow(run, schema)


NEXT = "doc_id bigint, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_and_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = 4, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next``, one row per row of ``df``.

    ``edited`` is the text with its last ``floor(n / cut)`` of ``n`` code points replaced by the first as many, or all, of the next
    document's: the one of the next larger id, for the last one the first. The two last columns tell how like the text's fingerprint is to
    that of the edited text and to the next document's: the part of the smaller that the larger contains. A
    null text is empty; two texts without words are alike. A null id is the smallest; rows of equal id follow
    by a hash of their texts, equal rows in any order. Other columns are left out; an empty table gives an empty one.
    """

    def judge(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        powers = Powers()
        edited = [t[: len(t) - len(t) // cut] + u[: len(t) // cut] for t, u in zip(texts, nexts, strict=True)]
        follow = [*texts[1:], nexts[-1]]  # rows of one batch mostly follow one another
        own = fingerprints(pa.array([*texts, nexts[-1]], pa.string()), words, share, powers)
        changed = fingerprints(pa.array(edited, pa.string()), words, share, powers)
        after = [
            own[i + 1] if follow[i] is nexts[i] else fingerprints(pa.array([nexts[i]], pa.string()), words, share, powers)[0]
            for i in range(len(texts))
        ]
        columns = [
            pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(edited, pa.string()),
            pa.array(map(as_text, own[:-1]), pa.string()), pa.array(map(as_text, changed), pa.string()),
            pa.array(map(likeness, own, changed), pa.float64()), pa.array(map(likeness, own, after), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NEXT.split(", ")])

    given = df.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return with_next(given, NEXT, judge)
