"""Packing: documents as token sequences of equal length with little padding.

Texts become token ids inside the tasks, and only the pieces' places, lengths and checksums go on.
Pieces are dealt at random to groups of about equal size, and each group is packed on its own by
first-fit decreasing; a tournament tree over the bins' free space finds the first bin that fits.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from zeitton.llm.memory import lean
from zeitton.llm.shingles import buffers
from zeitton.llm.text import whole
from zeitton.session import stage

GROUP_PIECES = 20_000  # pieces packed together, about
BATCH_BYTES = 1_000_000  # texts tokenised together
CACHED_WORDS = 100_000  # words per generation of the cache; two generations are held during a task
END_ID = 2

# The parts of a word in lower case, as the tokenizer splits it, if all that is not ASCII is letters.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\U0010ffff]+|[0-9]|[^a-z0-9\x80-\U0010ffff]+"
ODD = r"[\s\x00-\x1f\x7f-\x9f]|<\|"
UNCUT = r"[^\x21-\x7e]|['<]"  # a word with one of these is not cut by the classes of its bytes
NO_LETTER = "\n"

DIGIT, UNCUT_KIND = 2, 3
KINDS = np.array(
    [UNCUT_KIND if p > 127 or re.match(UNCUT, chr(p)) else DIGIT if chr(p).isdigit() else int(chr(p).isalpha()) for p in range(256)], np.uint8
)

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = PIECE + ", sequence_id bigint, offset bigint"


class Recent:
    """A cache of two generations: what is asked for moves to the young one, the old one is dropped as a whole."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Keys that neither generation holds; the others are in the young one afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, unknown = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    unknown.append(key)
        return unknown


class Letters(dict):
    """For ``str.translate``: characters as the pre-tokenizer writes them, if it takes them for letters, else ``NO_LETTER``.

    ASCII characters stay as they are.
    """

    def __init__(self, pre_tokenizer):
        super().__init__((p, chr(p)) for p in range(128))
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, point: int) -> str:
        found = self.pre_tokenizer.pre_tokenize_str(f"a{chr(point)}a")  # a letter does not part its neighbours
        self[point] = found[0][0][1:-1] if len(found) == 1 else NO_LETTER
        return self[point]


class WordTokenizer:
    """Token ids of texts, part by part.

    The tokenizer replaces white space by blanks and then drops it, so the ids of a text are those of its words, one
    after another, and those of a word are the ids of its parts: runs of letters, single digits, runs of
    other characters. Words of plain ASCII are cut into parts all together, by the classes of neighbouring bytes; words
    with other characters or an apostrophe stay whole and are split by patterns. Each different unit of a batch
    is coded once, and ids stay in caches. Words that hold white space of other kinds, a control character
    or the beginning of a special token go through the whole tokenizer.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = Letters(self.tokenizer.pre_tokenizer)
        self.parts, self.odd, self.uncut = re.compile(PARTS).findall, re.compile(ODD).search, re.compile(UNCUT).search
        self.units, self.pieces = Recent(CACHED_WORDS), Recent(CACHED_WORDS // 2)

    def _split(self, words: list[str]) -> list[list[str]]:
        """Parts of words as the model takes them; words of ASCII need no more than their lower case."""
        out, others, parts, letters = [], [], self.parts, self.letters
        for i, w in enumerate(words):
            if w.isascii():
                out.append(parts(w.lower()))
            else:
                others.append(i)
                out.append([])
        normalizer, pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for at in range(0, len(others), 1000):  # the library keeps some fifty bytes per character of a call
            some = others[at : at + 1000]
            for i, w in zip(some, normalizer.normalize_str(" ".join(words[i] for i in some)).split(" "), strict=True):
                written = w.translate(letters)
                if NO_LETTER in written:
                    out[i] = [part for part, _ in pre_tokenizer.pre_tokenize_str(w)]
                else:
                    out[i] = parts(written)
        return out

    def _code(self, parts: list[str]) -> Iterator[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return (array("I", [t.id for t in tokenize(part)]).tobytes() for part in parts)

    def _encode(self, units: list[str]) -> None:
        uncut, odd, known, young = self.uncut, self.odd, self.pieces, self.units.young
        whole = [u for u in units if uncut(u)]
        apart = set(whole)
        cut = [u for u in units if u not in apart]
        young.update(zip(cut, self._code([u.lower() for u in cut]), strict=True))
        plain = [w for w in whole if not odd(w)]
        split = self._split(plain)
        new = known.missing({p for parts in split for p in parts})
        known.young.update(zip(new, self._code(new), strict=True))
        ids = known.young
        young.update((w, b"".join([ids[p] for p in parts])) for w, parts in zip(plain, split, strict=True))
        for w in apart.difference(plain):
            own = self.tokenizer.encode(w, add_special_tokens=False).ids
            young[w] = array("I", own).tobytes()

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of the texts, one after another, and the number of units up to the end of each text."""
        words = pc.ascii_split_whitespace(texts)
        data, offsets = buffers(words.flatten())
        kind = KINDS[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        first = offsets[:-1][np.diff(offsets) > 0]
        opening = np.zeros(len(data), bool)
        opening[first] = True
        whole = np.zeros(len(first), bool)
        whole[np.searchsorted(first, np.flatnonzero(kind == UNCUT_KIND), side="right") - 1] = True
        at = np.flatnonzero(begins | opening)
        opens = opening[at]
        at = at[opens | ~whole[np.cumsum(opens) - 1]]
        cuts = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        ends = offsets[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        return pa.StringArray.from_buffers(len(at), cuts, pa.py_buffer(data)), np.searchsorted(at, ends)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids up to the end of each text."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        units, done = self._units(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._encode(self.units.missing(distinct))
        young = self.units.young
        parts = [young[u] for u in distinct]
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        first = np.cumsum(size) - size
        unit = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[unit]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[unit] - (ends - sizes), sizes) + np.arange(total)] if total else flat[:0]
        return ids, np.concatenate([[0], ends])[done]


def batches_of(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """The array in slices of about ``limit`` bytes, with the place of each; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def cut_pieces(df: DataFrame, definition: str, id_col: str, text_col: str, length: int) -> DataFrame:
    """One row per piece: each document's ids and the end id, cut every ``length`` ids."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(definition)
        for batch in batches:
            for at, texts in batches_of(batch.column(1), BATCH_BYTES):
                ids, ends = tokenizer.ids(texts)
                rows, begin = [], 0
                for i, end in enumerate(ends.tolist()):
                    own = np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4")
                    begin, doc = end, batch.column(0)[at + i].as_py()
                    for start in range(0, len(own), length):
                        piece = own[start : start + length]
                        rows.append((doc, start, len(piece), zlib.crc32(piece), len(own)))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    given = df.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return given.mapInArrow(cut, PIECE)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; ``lengths`` fall. Node 1 is the root, a node holds the most free space below it."""
    width = 1
    while width < max(1, len(lengths)):
        width *= 2
    free = [capacity] * (2 * width)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < width:
            node *= 2
            if free[node] < n:  # the left half has no bin that fits
                node += 1
        bins.append(node - width)
        offsets.append(capacity - free[node])
        free[node] -= n
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, seed: int = 29
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``length`` ids.

    A document is its ids and then id 2; a null or empty text has only that. Documents longer than a
    sequence are cut every ``length`` ids. Columns: ``doc_id, start`` (ids of the document before the
    piece), ``length, ids_crc32`` (ids as little-endian unsigned 32-bit numbers), ``doc_tokens,
    sequence_id, offset`` (gapless from 0 in the sequence). Repeated rows and null ids are documents of
    their own; other columns are left out; an empty table gives an empty one.
    """
    pieces = cut_pieces(df, Path(tokenizer_path).read_text("utf-8"), id_col, text_col, length)
    stored = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-stored.count() // GROUP_PIECES))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(group["length"].tolist(), length)
        base = int(group["group"].iloc[0]) << 32
        group = group.assign(sequence_id=np.array(bins, dtype=np.int64) + base, offset=np.array(offsets, dtype=np.int64))
        return group.drop(columns=["row", "group"])

    dealt = stored.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fit, PACKED)
