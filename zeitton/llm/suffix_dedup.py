"""Suffix-array dedup: bytes covered by strings of 200 bytes that also start elsewhere.

Which windows of 200 bytes can be equal is found without comparing all of them. The anchor of a window
is the least hash of 48 bytes in it, so equal windows have equal anchors, at the same place. A text
falls into contexts: runs of windows with one anchor, together with their bytes. Anchors found once
are done; where all contexts of an anchor are equal, every window repeats. For the rest the different
contexts of an anchor go to one suffix array, and suffixes that are neighbours there and
share 200 bytes are repeats. An anchor with very many different contexts is split by longer common strings, down to single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zeitton.functions.text import once
from zeitton.llm.memory import lean
from zeitton.llm.packing import batches_of
from zeitton.llm.shingles import Powers, U, buffers, mix
from zeitton.llm.suffix_array import ranges, suffix_arrays
from zeitton.llm.text import known_id, let, whole
from zeitton.session import stage

ANCHOR = 48
BATCH_BYTES = 1_000_000  # texts hashed together, at some hundred bytes of arrays for each of theirs
ARRAY_BYTES = 1_500_000  # strings whose suffixes are sorted side by side
MOST = 64  # different contexts of one key that share a suffix array
PARTS = (35, 9, 2, 1)  # windows per part when keys are split again
KEY = ["fp", "ctx"]
DOC = ["doc", "hash"]


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts_of(texts: pa.Array, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """For every run of windows with one anchor: the text, the first window in it, windows less one, place of the anchor, and two hashes."""
    data, offsets = buffers(texts)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers.of(n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:n])])
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    # The upper half of the hash decides; of equal ones the first place.
    ranked = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    owner = (least_in_windows(ranked, length - ANCHOR + 1) & U(0xFFFFFFFF)).astype(np.int64)
    ends = np.zeros(n + 1, np.int32)  # the last windows of a text would leave it
    np.add.at(ends, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(ends, offsets[1:], -1)
    starts = np.flatnonzero(np.cumsum(ends[:n])[: len(owner)] == 0)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    owner = owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    low, high = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    place = owner[begin]
    whole_run = (sums[high + length] - sums[low]) * down[low]
    ctx = mix(whole_run ^ mix(((high - low) * 1024 + (place - low)).astype(U)))
    text = np.searchsorted(offsets, low, side="right") - 1
    return text, low - offsets[text], high - low, place - low, mix(grams[place] + U(1)).view(np.int64), ctx.view(np.int64)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """``doc, hash, fp, ctx, low, more, place``: one row per context of each text of ``doc, hash, text``."""
    names = [*DOC, *KEY, "low", "more", "place"]

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at, texts in batches_of(batch.column(2), BATCH_BYTES):
                text, low, more, place, fp, ctx = contexts_of(texts, length, powers)
                own = [batch.column(k).slice(at, len(texts)).take(pa.array(text)) for k in (0, 1)]
                rest = [pa.array(x) for x in (fp, ctx, low, more.astype(np.int32), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *rest], names=names)

    return docs.mapInArrow(find, "doc bigint, hash bigint, fp bigint, ctx bigint, low bigint, more int, place int")


def repeated_windows(groups: list[list[tuple[bytes, int]]], length: int, powers: Powers) -> list[list[np.ndarray]]:
    """For groups of ``(bytes, windows)``: which windows of each string start anywhere else in the group."""
    strings = [s for group in groups for s in group]
    sizes = np.array([len(data) + 1 for data, _ in strings], np.int64)
    cuts = np.cumsum([0] + [sum(len(data) + 1 for data, _ in group) for group in groups])
    text = np.frombuffer(b"\0".join(data for data, _ in strings) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    text[ends - 1] = 1  # between strings
    text[cuts[1:] - 1] = 0  # and at the end of a group
    windows = np.array([w for _, w in strings], np.int64)
    owned = np.zeros(len(text), bool)
    owned[ranges(ends - sizes, windows)] = True
    array = suffix_arrays(text, cuts)
    up, down = powers.of(len(text) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(text.astype(U) * up[: len(text)])])
    hashed = np.zeros(len(text), U)
    at = np.flatnonzero(owned)
    hashed[at] = mix((sums[at + length] - sums[at]) * down[at])
    a, b = array[:-1], array[1:]
    same = owned[a] & owned[b] & (hashed[a] == hashed[b])
    same[cuts[1:-1] - 1] = False  # neighbours of two groups
    again = np.zeros(len(text), bool)
    again[a[same]] = again[b[same]] = True
    flags = iter([again[e - s : e - s + w] for e, s, w in zip(ends, sizes, windows, strict=True)])
    return [[next(flags) for _ in group] for group in groups]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def sorted_out(rows: DataFrame, length: int) -> DataFrame:
    """``key, sub, begin, end`` of repeated bytes from ``size, key, sub, n, windows, data``, sizes bounded."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[list[tuple]] = []
        weight = 0

        def done() -> pa.RecordBatch:
            found = []
            open_groups = [g for g in held if len(g) > 1]
            flags = repeated_windows([[(r[4], r[3]) for r in g] for g in open_groups], length, powers) if open_groups else []
            by_group = iter(flags)
            for group in held:
                some = next(by_group) if len(group) > 1 else [np.zeros(group[0][3], bool)]
                for (key, sub, n, windows, _), again in zip(group, some, strict=True):
                    begin, last = runs(np.ones(windows, bool) if n > 1 else again)
                    found += [(key, sub, b, e + length) for b, e in zip(begin.tolist(), last.tolist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "sub", "begin", "end"]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not held or held[-1][0][0] != row[0]:
                    if weight > ARRAY_BYTES:
                        yield done()
                        held, weight = [], 0
                    held.append([])
                held[-1].append(row)
                weight += len(row[4])
        if held:
            yield done()

    dealt = rows.select("size", "key", "sub", "n", "windows", "data").repartition("key")
    return dealt.sortWithinPartitions("size", "key").mapInArrow(run, "key bigint, sub bigint, begin int, end int")


def split_again(rows: DataFrame, part: int, length: int) -> DataFrame:
    """Contexts in parts of at most ``part`` windows, with a key from the bytes that all windows of a part share.

    Parts and shared bytes are counted from the anchor, so those of equal windows are equal.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pylist()
            out = []
            for r in table:
                for j in range((r["place"] - r["windows"] + 1) // part, r["place"] // part + 1):
                    first, last = r["place"] - (j + 1) * part + 1, r["place"] - j * part
                    a, b = max(first, 0), min(last, r["windows"] - 1)
                    shared = r["data"][last : first + length]
                    out.append(r | {"shared": shared, "part": j, "rel": r["rel"] + a, "windows": b - a + 1, "place": r["place"] - a, "data": r["data"][a : b + length]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = {"fp": pa.int64(), "ctx": pa.int64(), "rel": pa.int32(), "n": pa.int64(), "windows": pa.int32(), "place": pa.int32(), "data": pa.binary(), "shared": pa.binary(), "part": pa.int32()}
    schema = pa.schema(kinds)
    columns = "fp bigint, ctx bigint, rel int, n bigint, windows int, place int, data binary, shared binary, part int"
    made = rows.select("fp", "ctx", "rel", "n", "windows", "place", "data").mapInArrow(run, columns)
    return made.select(
        F.xxhash64("fp", "part", "shared").alias("key"),
        F.xxhash64(F.lit(1), "data", "windows", "place").alias("sub"),
        "fp", "ctx", "rel", "n", "windows", "place", "data",
    )


def resolved(contexts: DataFrame, length: int) -> DataFrame:
    """``fp, ctx, begin, end``: repeated bytes of each context, by suffix arrays of bounded size."""
    level = contexts.select(F.col("fp").alias("key"), F.col("ctx").alias("sub"), "*")
    found = []
    for part in (*PARTS, None):
        level = stage(level, "contexts")
        distinct = level.select("key", "sub", "n", "windows", "data")
        if found:
            distinct = distinct.groupBy("key", "sub").agg(
                F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("data").alias("data")
            )
        sizes = level.select("key", "sub").distinct().groupBy("key").agg(F.count("*").alias("size"))
        sizes = stage(sizes, "context-counts")
        small = sizes if part is None else sizes.where(F.col("size") <= MOST)
        repeats = sorted_out(distinct.join(small, "key"), length)
        places = level.select("key", "sub", "fp", "ctx", "rel")
        found.append(
            repeats.join(places, ["key", "sub"]).select(
                "fp", "ctx", (F.col("rel") + F.col("begin")).alias("begin"), (F.col("rel") + F.col("end")).alias("end")
            )
        )
        large = sizes.where(F.col("size") > MOST)
        if part is None or large.isEmpty():
            break
        level = split_again(level.join(large.select("key"), "key"), part, length)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cut_out(df: DataFrame, as_text: bool) -> DataFrame:
    """``df`` (``text, spans`` and others) with ``kept``, ``n_removed`` and ``n_spans`` in place of both."""
    kind, arrow_kind = ("string", pa.string()) if as_text else ("binary", pa.binary())

    @F.arrow_udf(f"kept {kind}, n_removed bigint, n_spans bigint")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, removed, parts = [], [], []
        for data, own in zip(texts.cast(pa.binary()), spans, strict=True):
            data, out, at, n, gone = data.as_py(), [], 0, 0, 0
            end = -1
            for begin, stop in sorted((s["begin"], s["end"]) for s in own.as_py() or ()):
                if begin > end:  # spans that touch are one
                    n += 1
                    out.append(data[at:begin])
                end = max(end, stop)
                at = end
            out.append(data[at:])
            rest = b"".join(out)
            gone = len(data) - len(rest)
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            removed.append(gone)
            parts.append(n)
        return pa.StructArray.from_arrays(
            [pa.array(kept, arrow_kind), pa.array(removed, pa.int64()), pa.array(parts, pa.int64())],
            names=["kept", "n_removed", "n_spans"],
        )

    # A filter on what is kept would cut every text again, with workers of its own.
    done = once(df, "done", cut(F.col("text"), F.col("spans")))
    return done.select(*(c for c in df.columns if c not in ("text", "spans")), "done.kept", "done.n_removed", "done.n_spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, as_text: bool = False) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct), ``n_bytes, n_removed, n_spans, kept`` (bytes).

    Every byte covered by a string of ``length`` bytes of the UTF-8 text that also starts anywhere else,
    in another text or in the same one, is removed; all copies go, overlaps count, and strings never cross texts. ``n_spans``
    counts longest removed runs. Null and shorter texts stay whole (null: empty); repeated rows are texts of their
    own, so both lose what they share; a null id is an id. ``length`` is between 50 and 200. With
    ``as_text``, ``kept`` is text, without the rests of characters that lost some of their bytes.
    """
    docs = df.select(known_id(id_col).alias("doc"), F.xxhash64(whole(text_col)).alias("hash"), whole(text_col).alias("text"))
    found = anchors(docs, length)
    shared = found.groupBy("fp").agg(F.count("*").alias("count"), F.min("ctx").alias("least"), F.max("ctx").alias("most"))
    shared = shared.where("count > 1").select("fp", (F.col("least") != F.col("most")).alias("mixed"))
    # Stored, the counts leave the join free to split an anchor that very many texts share.
    repeated = stage(found.join(stage(shared, "shared-anchors"), "fp"), "repeated-anchors")
    mixed = repeated.where("mixed")
    wanted = mixed.groupBy(*KEY).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*DOC, "low", "more", "place"))
    )
    per_doc = wanted.groupBy(*DOC).agg(F.collect_list(F.struct(*KEY, "n", "low", "more", "place")).alias("wanted"))
    taken = docs.join(per_doc, DOC).dropDuplicates(DOC)  # a row may be repeated

    def slices(data):
        return F.transform(
            "wanted",
            lambda w: F.struct(
                w["fp"].alias("fp"), w["ctx"].alias("ctx"), F.lit(0).alias("rel"), w["n"].alias("n"),
                (w["more"] + 1).alias("windows"), w["place"].alias("place"),
                F.substr(data, (w["low"] + 1).cast("int"), w["more"] + length).alias("data"),
            ),
        )

    contexts = taken.select(F.explode(let(F.col("text").cast("binary"), slices)).alias("c")).select("c.*")
    marks = resolved(contexts, length)
    spans = mixed.join(marks, KEY).select(
        *DOC, (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("end")).alias("end")
    )
    full = repeated.where(~F.col("mixed")).select(
        *DOC, F.col("low").alias("begin"), (F.col("low") + F.col("more") + length).alias("end")
    )
    by_doc = full.unionByName(spans).groupBy(*DOC).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = df.select(
        F.struct(*(df[c] for c in df.columns if c != text_col)).alias("row"), known_id(id_col).alias("doc"),
        F.xxhash64(whole(text_col)).alias("hash"), whole(text_col).alias("text"),
    )
    joined = rows.join(by_doc, DOC, "left")
    return cut_out(joined.select("row", F.octet_length("text").cast("bigint").alias("n_bytes"), "text", "spans"), as_text)
