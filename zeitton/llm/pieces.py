"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts are cut into marked words: a run of blanks and what follows up to the next blank; no piece
crosses such a cut. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order: a word keeps the forward states of the prefix it shares with the word before it
and adds states for the rest. Words of earlier batches are kept in a cache of bounded size. All of it
is narrow: no row leaves its task.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from zeitton.llm.packing import batches_of
from zeitton.llm.shingles import buffers
from zeitton.llm.text import whole

BATCH_BYTES = 2_000_000
BATCH_IDS = 400_000  # decoded together
CACHED_WORDS = 120_000  # per generation; two are held
CACHED_PAIRS = 150_000
MARK = "▁"
UNKNOWN = -1

Trace = list[tuple[float, str, str]]


class Vocabulary:
    """Pieces with ids and scores; characters that no piece has fall back to the pieces of their bytes.

    ``merges``: the model is a BPE, whose encoding is what merging the best-scored neighbours, leftmost
    first, ends with. Its last piece is the one piece that stays apart from the last piece of the rest, so
    forward states of prefixes give it too: a pair that would merge has no score. Otherwise
    scores are logarithms, and the segmentation with the largest sum is wanted.
    """

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], merges: bool):
        self.scores, self.byte_ids, self.merges = scores, byte_ids, merges
        self.longest = max(map(len, scores), default=1)
        self.lowest = min((s for _, s in scores.values()), default=0.0)
        self.ids = {piece: i for piece, (i, _) in scores.items()}
        self.costs = {piece: -s for piece, (_, s) in scores.items()}
        self.names = {i: piece for piece, i in self.ids.items()}
        self.width = max(self.names, default=0) + 1
        self.reach: dict[str, int] = {}  # the longest piece that ends with these two characters
        for piece in scores:
            if len(piece) > 1:
                self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 0))
        self.traces: dict[int, Trace | None] = {}
        self.apart: dict[int, bool] = {}

    @classmethod
    def of_model(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        scores, byte_ids = {}, [0] * 256
        for i in range(reader.get_piece_size()):
            if reader.is_byte(i):
                byte_ids[int(reader.id_to_piece(i)[1:-1], 16)] = i
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                scores[reader.id_to_piece(i).replace(MARK, " ")] = (i, reader.get_score(i))
        # Scores of a BPE are the negative ranks of its merges.
        return cls(scores, byte_ids, all(s == int(s) and s <= 0 for _, s in scores.values()))

    def merged(self, text: str) -> tuple[list[str], Trace]:
        """The pieces that merging ends with, and each merge's cost with the first and last piece before it."""
        costs, trace = self.costs, []
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []
        last = len(parts) - 1

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in costs:
                    heapq.heappush(queue, (costs[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while queue:
            cost, i, both = heapq.heappop(queue)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            trace.append((cost, parts[0], parts[last]))
            j = after[i]
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if j == last:
                last = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None], trace

    def trace(self, i: int) -> Trace | None:
        """The merges that lead to a piece, and the piece at no cost that could come; null if merging ends with other pieces."""
        if i not in self.traces:
            piece = self.names[i]
            parts, trace = self.merged(piece)
            self.traces[i] = [*trace, (math.inf, piece, piece)] if parts == [piece] else None
        return self.traces[i]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces ends with them.

        As long as nothing merges across their border, each side goes through the merges of its own piece, the cheapest next, and
        among equal costs the leftmost. They stay apart if the merge across the border is never the next one.
        """
        own, other, costs = self.trace(left), self.trace(right), self.costs
        if own is None or other is None:
            return False
        i = j = 0
        while True:
            a, _, end = own[i]
            b, begin, _ = other[j]
            across = costs.get(end + begin, math.inf)
            if across < a and across <= b and across < math.inf:
                return False
            if a == b == math.inf:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def _go_on_by_merges(self, word: str, last: list[int], begins: list[int]) -> None:
        """Add the states of the rest of a word: the last piece of each prefix, and where it begins."""
        id_of, reach, width, known = self.ids.get, self.reach.get, self.width, self.apart
        for end in range(len(last), len(word) + 1):
            best, at = UNKNOWN, end - 1
            stop = end - reach(word[end - 2 : end], 1)
            for begin in range(end - 1, stop - 1 if stop > 0 else -1, -1):
                piece = id_of(word[begin:end])
                if piece is None:
                    continue
                before = last[begin]
                if before != UNKNOWN:
                    pair = before * width + piece
                    apart = known.get(pair)
                    if apart is None:
                        apart = known[pair] = self.stay_apart(before, piece)
                    if not apart:
                        continue
                best, at = piece, begin
                break
            last.append(best)
            begins.append(at)

    def _go_on_by_sums(self, word: str, last: list[int], begins: list[int], sums: list[float]) -> None:
        """The same for scores whose sum counts."""
        for end in range(len(last), len(word) + 1):
            best = None
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                entry = self.scores.get(word[begin:end])
                if entry is not None and (best is None or sums[begin] + entry[1] > best[0]):
                    best = (sums[begin] + entry[1], entry[0], begin)
            if best is None:  # a character of no piece
                best = (sums[end - 1] + self.lowest - 10, UNKNOWN, end - 1)
            for column, value in zip((sums, last, begins), best, strict=True):
                column.append(value)

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted words. A state: the last piece of the best path here, where that begins, and the path's score."""
        if len(self.apart) > CACHED_PAIRS:
            self.apart.clear()
        last, begins, sums = [UNKNOWN], [0], [0.0]
        found, previous = [], ""
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :], sums[shared + 1 :]
            if self.merges:
                self._go_on_by_merges(word, last, begins)
            else:
                self._go_on_by_sums(word, last, begins, sums)
            ids, at = [], len(word)
            while at:
                piece, begin = last[at], begins[at]
                if piece == UNKNOWN:
                    ids.extend(self.byte_ids[b] for b in reversed(word[begin:at].encode("utf-8")))
                else:
                    ids.append(piece)
                at = begin
            ids.reverse()
            found.append(ids)
            previous = word
        return found


class Encoder:
    """Ids of texts, with a cache of words in two generations: what is asked for moves to the young one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.young, self.old = vocabulary, {}, {}

    def ids(self, texts: pa.Array) -> pa.Array:
        data, offsets = buffers(pc.replace_substring(texts, MARK, " "))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[filled], 32)  # the mark before a text
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[filled]] = True
        cuts = np.append(np.flatnonzero(begins), len(data))
        words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = self._parts(distinct)
        flat = np.frombuffer(b"".join(parts), np.int32)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[word]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[word] - (ends - sizes), sizes) + np.arange(total)]
        places = np.concatenate([[0], ends])[np.searchsorted(cuts[:-1], offsets)]
        return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids))

    def _parts(self, distinct: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        young, old, unknown = self.young, self.old, []
        for w in distinct:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    unknown.append(w)
        unknown.sort()
        for w, ids in zip(unknown, self.vocabulary.encode_sorted(unknown), strict=True):
            young[w] = array("i", ids).tobytes()
        return [young[w] for w in distinct]


def encode(text: Column, model: bytes) -> Column:
    """Ids of a text as ``array<int>``. Null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary.of_model(model))
        for batch in batches:
            done = [encoder.ids(texts) for _, texts in batches_of(batch, BATCH_BYTES)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return ids(whole(text))


def few_at_a_time(lists: pa.Array) -> Iterator[pa.Array]:
    """An array of lists in slices of about ``BATCH_IDS`` ids."""
    ends, at = lists.offsets.to_numpy()[1:], 0
    while at < len(lists):
        done = int(ends[at - 1]) if at else lists.offsets[0].as_py()
        end = max(at + 1, int(np.searchsorted(ends, done + BATCH_IDS, side="right")))
        yield lists.slice(at, end - at)
        at = end


def decode(ids: Column, model: bytes) -> Column:
    """The text of ids. Null gives an empty text; bytes that are no UTF-8 become U+FFFD, ids of control pieces and of no piece nothing."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.of_model(model)
        of_id = {i: p.encode("utf-8") for p, (i, _) in vocabulary.scores.items()}
        of_id |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids) if i}
        top = max(of_id, default=0) + 2  # the last place is for ids of no piece
        table = [of_id.get(i, b"") for i in range(top)]
        flat = np.frombuffer(b"".join(table) + b"\0", np.uint8)
        size = np.array([len(p) for p in table], np.int64)
        first = np.cumsum(size) - size

        def some(lists: pa.Array) -> pa.Array:
            offsets = lists.offsets.to_numpy().astype(np.int64)
            own = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            own[(own < 0) | (own >= top)] = top - 1
            sizes = size[own]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            data = flat[np.repeat(first[own] - ends[:-1], sizes) + np.arange(ends[-1])]
            cuts = ends[offsets - offsets[0]]
            begin = cuts[:-1][(np.diff(cuts) > 0)]
            begin = begin[data[begin] == 32]  # the mark before a text
            data = np.delete(data, begin)
            cuts = cuts - np.searchsorted(begin, cuts)
            raw = pa.BinaryArray.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]
            )
            try:
                return raw.cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

        for batch in batches:
            parts = [some(lists) for lists in few_at_a_time(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def encode_documents(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the piece ids of its texts; a column named ``ids_col`` is replaced.

    A null or empty text has an empty array; equal rows stay equal rows; an empty table stays empty.
    """
    return df.withColumn(ids_col, encode(F.col(text_col), Path(model_path).read_bytes()))


def decode_documents(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the texts of its ids; a column named ``text_col`` is replaced, null ids give an empty text."""
    return df.withColumn(text_col, decode(F.col(ids_col), Path(model_path).read_bytes()))
