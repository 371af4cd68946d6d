"""Periodic runs: stretches of a text in which the same words come round again and again.

Periods are taken by octaves. For the octave of periods ``q`` with ``half <= q < 2 * half`` a text has a
boundary every ``2 * half`` words, and a tile around each: as many words to the left, twice as many to the
right. A run of four periods or more has a boundary inside, and in the tile two Z-functions, one to
each side of the boundary, tell for every period how far the words go on repeating. What a
tile finds is an interval of places that equal the place one period on, cut off at the tile's
edges; neighbouring tiles overlap, so the shuffle by document and period stitches the intervals.

Tiles of all texts of a batch lie side by side in one array. Long texts are exploded into rows of
bounded tiles, which are dealt out to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from zeitton.llm.packing import batches_of
from zeitton.llm.text import hash_pair, known_id, whole
from zeitton.session import stage

BATCH_BYTES = 8_000_000  # texts solved side by side
LONG_BYTES = 2_000_000  # longer texts are exploded into tiles that go to other tasks
CORE = 1 << 17  # words between the margins of a tile, as far as the octave allows

KEY = "id bigint, h1 bigint, h2 bigint"
FRAGMENT = KEY + ", period bigint, first bigint, past bigint"
TILE = KEY + ", octave int, octaves int, base bigint, margin bigint, codes binary"
SHOWN = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and the number of words before each text and in all."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets]


def z_function(values: list) -> list[int]:
    """For each place the length of the longest stretch from there that equals the beginning."""
    n, left, right = len(values), 0, 0
    found = [0] * n
    for i in range(1, n):
        k = found[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and values[k] == values[i + k]:
                k += 1
            left, right = i, i + k
        found[i] = k
    return found


def possible(codes: np.ndarray, at: int, count: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of the octave that may belong to a run.

    Inside a run the words after the boundary or those before it equal the ones a period on for a whole
    period at least; three places of each are looked at.
    """
    step = 2 * half
    tiles = codes[at : at + count * step].reshape(count, step)
    tile, above = np.nonzero(tiles[:, :1] == tiles[:, half:])
    boundary, period = at + tile * step, half + above

    def same(offset: int) -> np.ndarray:
        return codes[boundary + offset] == codes[boundary + offset + period]

    right = same(half // 2) & same(half - 1)
    left = same(-1) & same(-(half + 1) // 2) & same(-half)
    return boundary[right | left], period[right | left]


def repeats_around(codes: np.ndarray, boundary: int, half: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """Period, begin and end of the interval around the boundary that equals the words one period on."""
    step, end = 2 * half, object()
    right = z_function(codes[boundary : boundary + 2 * step].tolist())
    back = codes[boundary - step : boundary + step][::-1].tolist()
    left = z_function([*back[step:], end, *back])
    return [(q, boundary - left[2 * step + 1 - q], boundary + min(right[q], step)) for q in periods]


def stitched(found: np.ndarray) -> np.ndarray:
    """Rows of period, begin, end, sorted, with overlapping and touching intervals of a period as one."""
    if not len(found):
        return found.reshape(0, 3)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    width = found[:, 2].max() + 1
    begins, ends = found[:, 0] * width + found[:, 1], np.maximum.accumulate(found[:, 0] * width + found[:, 2])
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]]))
    return np.column_stack([found[new, 0], found[new, 1], np.maximum.reduceat(found[:, 2], new)])


def solve(codes: np.ndarray, reach: list[tuple[int, int, int]]) -> np.ndarray:
    """Stitched intervals of all tiles: ``reach`` has the octave, and the begin and end of its boundaries."""
    found = []
    for octave, begin, end in reach:
        half = 1 << octave
        boundary, period = possible(codes, begin, -(-(end - begin) // (2 * half)), half)
        if len(boundary):
            cuts = np.flatnonzero(np.diff(boundary)) + 1
            for some, periods in zip(boundary[[0, *cuts]].tolist(), np.split(period, cuts), strict=True):
                found += repeats_around(codes, some, half, periods.tolist())
    return stitched(np.array(found, np.int64))


def octaves_of(n: int, exponent: int) -> int:
    """Octaves with a period that ``n`` words hold ``exponent`` times."""
    return max(0, int(n) // exponent).bit_length()


def unlike(n: int) -> np.ndarray:
    """Codes that equal no word and not each other."""
    return -1 - np.arange(n, dtype=np.int64)


def solve_texts(words: np.ndarray, offsets: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts as codes: which text, and rows of period, begin, end of the intervals of its runs."""
    count = np.diff(offsets)
    order = np.argsort(-count, kind="stable")
    count = count[order]
    octaves = octaves_of(count[0] if len(count) else 0, exponent)
    margin = 4 << octaves
    place = margin + np.cumsum(count + 1) - (count + 1)  # one unlike code parts the texts
    codes = unlike(int(place[-1] + count[-1]) + 2 * margin if len(count) else 0)
    target = np.repeat(place - offsets[order], count) + np.repeat(offsets[order], count)
    codes[target + np.arange(len(target)) - np.repeat(np.cumsum(count) - count, count)] = words[
        np.repeat(offsets[order] - (np.cumsum(count) - count), count) + np.arange(len(target))
    ]
    reach = []
    for octave in range(octaves):
        last = np.searchsorted(-count, -(exponent << octave), side="right") - 1
        reach.append((octave, margin, int(place[last] + count[last])))
    found = solve(codes, reach)
    whole_run = found[:, 2] - found[:, 1] + found[:, 0] >= np.maximum(length, exponent * found[:, 0])
    found = found[whole_run]
    text = np.searchsorted(place, found[:, 1], side="right") - 1
    found[:, 1:] -= place[text][:, None]
    return order[text], found


def tiles_of(words: np.ndarray, exponent: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """First octave, number of octaves, place of the first boundary, words before it, and the codes of each tile.

    Octaves whose tiles are short beside ``CORE`` share blocks of that many words, others have blocks of four steps.
    """
    octaves, at = octaves_of(len(words), exponent), 0
    while at < octaves:
        shared = max(1, min(octaves, (CORE // 8).bit_length() - 1) - at)
        step = 2 << (at + shared - 1)
        core = max(CORE, 4 * step)
        for base in range(0, len(words), core):
            begin = max(0, base - step)
            yield at, shared, base, base - begin, words[begin : base + core + 2 * step]
        at += shared


def fragments(df: DataFrame, length: int, exponent: int) -> DataFrame:
    """Intervals of all runs by document and period, cut where the tiles of long texts end."""

    def columns(batch: pa.RecordBatch, at: int, rows: np.ndarray) -> list[pa.Array]:
        return [batch.column(k).take(pa.array(at + rows)) for k in range(3)]

    def solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(3), BATCH_BYTES):
                words, offsets = word_lists(texts)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                text, found = solve_texts(codes, offsets, length, exponent)
                yield pa.RecordBatch.from_arrays([*columns(batch, at, text), *map(pa.array, found.T)], names=names)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                words, _ = word_lists(batch.column(3).slice(at, 1))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                for first, octaves, base, margin, some in tiles_of(codes, exponent):
                    values = (first, octaves, base, margin, some.astype("<i4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [*columns(batch, at, np.zeros(1, np.int64)), *(pa.array([v], t) for v, t in zip(values, kinds))],
                        names=[*names[:3], "octave", "octaves", "base", "margin", "codes"],
                    )

    def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.select(["octave", "octaves", "base", "margin", "codes"]).to_pylist()):
                words, step = np.frombuffer(row["codes"], "<i4"), 2 << (row["octave"] + row["octaves"] - 1)
                codes = unlike(len(words) + 8 * step)
                codes[4 * step : 4 * step + len(words)] = words
                begin = 4 * step + row["margin"]
                end = min(begin + max(CORE, 4 * step), 4 * step + len(words))
                found = solve(codes, [(row["octave"] + k, begin, end) for k in range(row["octaves"])])
                found[:, 1:] += row["base"] - begin
                rows = np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([*columns(batch, at, rows), *map(pa.array, found.T)], names=names)

    names = ["id", "h1", "h2", "period", "first", "past"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    long = F.octet_length("text") > LONG_BYTES
    tiles = df.where(long).mapInArrow(explode, TILE).repartition("id", "h1", "h2", "octave", "base")
    return df.where(~long).mapInArrow(solve_batches, FRAGMENT).unionByName(tiles.mapInArrow(solve_tiles, FRAGMENT))


def runs_of(found: DataFrame, length: int, exponent: int) -> DataFrame:
    """All runs of each document as an array, from the intervals."""
    keys = ["id", "h1", "h2"]
    line = Window.partitionBy(*keys, "period").orderBy("first", "past")
    before = F.max("past").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") <= before, 0).otherwise(1)
    whole_runs = (
        found.distinct()  # rows of equal id and text find the same
        .withColumn("run", F.sum(new).over(line))
        .groupBy(*keys, "period", "run")
        .agg(F.min("first").alias("start"), (F.max("past") - F.min("first") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(length), exponent * F.col("period")))
    )
    # A run of period q also has the periods 2q, 3q, ...: the same stretch, found again in later octaves.
    smallest = whole_runs.groupBy(*keys, "start", "length").agg(F.min("period").alias("period"))
    return smallest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that a run holds after its first period, from ``doc_id, text, runs``."""
    for batch in batches:
        for at, texts in batches_of(batch.column(1), BATCH_BYTES):
            words, offsets = word_lists(texts)
            runs = batch.column(2).slice(at, len(texts))
            text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
            start, period, size = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, offsets[text] + start + period, 1)
            np.add.at(depth, offsets[text] + start + size, -1)
            kept = np.cumsum(depth[:-1]) == 0
            places = np.concatenate([[0], np.cumsum(kept)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), words.filter(pa.array(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), pa.array(np.diff(offsets), pa.int64()), runs, pc.binary_join(lists, " ")],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, one row per row of ``df``.

    A run is a stretch of words of which each equals the one ``period`` words on, the smallest such
    period, as long as it goes, of at least ``min_length`` words and ``min_exponent`` (4 at least) periods. ``runs`` holds
    ``start`` (number of its first word), ``period`` and ``length`` of all runs by start, then
    period. ``collapsed`` is the words joined by one blank, without those that a run holds after its
    first ``period`` words. A null or empty text has no words and no runs; a null id stays null.
    Rows of equal id and text have equal results; other columns are left out; an empty table gives an empty one.
    """
    if min_exponent < 4:
        raise ValueError("a run of fewer than four periods may have no boundary inside")
    h1, h2 = hash_pair(F.col("text"))
    given = df.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    keyed = given.select("doc_id", known_id("doc_id").alias("id"), h1.alias("h1"), h2.alias("h2"), "text")
    runs = stage(runs_of(fragments(keyed.drop("doc_id"), min_length, min_exponent), min_length, min_exponent), "runs")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    # The same join at every size: texts cross the network once, whether or not the runs would fit a broadcast.
    joined = keyed.join(runs.hint("merge"), ["id", "h1", "h2"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return joined.mapInArrow(collapse, SHOWN)
