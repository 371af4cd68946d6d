"""Packing: tokens of every piece against the tokenizer, and first fit against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.helpers import documents
from zeitton.llm import packing
from zeitton.llm.packing import first_fit_decreasing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_first_fit_decreasing():
    draw = random.Random(6)
    for _ in range(50):
        lengths = sorted((draw.randint(1, 20) for _ in range(draw.randint(0, 60))), reverse=True)
        free, want = [], []
        for n in lengths:
            k = next((k for k, room in enumerate(free) if room >= n), len(free))
            if k == len(free):
                free.append(20)
            want.append((k, 20 - free[k]))
            free[k] -= n
        assert list(zip(*first_fit_decreasing(lengths, 20), strict=True)) == want


def test_pieces_cover_every_document(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    draw = random.Random(7)
    odd = [None, "", " ", "<|endoftext|> inside<|endoftext|>", "ΣΑΣ İ é don't l'été's", "a\x1cb\x85c\xa0d", "word" * 3000, "same", "same"]
    words = ["Ab", "the", "x1", "été", "...", "straße", "\n", "\t", "  "]
    texts = odd + [" ".join(draw.choice(words) for _ in range(draw.randint(1, 700))) for _ in range(40)]
    docs = documents(spark, [*texts, (None, "no id")]).withColumnRenamed("lang", "length")
    tokenizer = Tokenizer.from_file(PATH)
    tokens = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in [*texts, "no id"]]
    covered, bins = defaultdict(int), defaultdict(list)
    for r in pack(docs, PATH, length=256).collect():
        own = tokens[r.doc_id if r.doc_id is not None else -1]
        piece = np.array(own[r.start : r.start + r.length], "<u4")
        assert (len(piece), zlib.crc32(piece.tobytes()), len(own)) == (r.length, r.ids_crc32, r.doc_tokens)
        covered[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(covered.values()) == sum(map(len, tokens)) and len(covered) == len(tokens)
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert pack(docs.limit(0), PATH).collect() == []


def test_parts_are_those_of_the_tokenizer():
    """Many characters between letters, at both ends of a word and after marks: ids by parts equal those of whole texts."""
    definition = open(PATH, encoding="utf-8").read()
    own, whole = packing.WordTokenizer(definition), Tokenizer.from_file(PATH)
    points = [chr(p) for p in range(1, 0x20000) if not 0xD800 <= p < 0xE000]
    texts = [" ".join(f"x{c}y 'S{c}1 {c}̣́" for c in points[at : at + 4000]) for at in range(0, len(points), 4000)]
    texts += ["<|endoftext|>a don't<|startoftext|> Ị̇ ΑΣ <|END", "", "a\0b \0"]
    ids, ends = own.ids(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == whole.encode(text, add_special_tokens=False).ids
        begin = end


def test_special_tokens_are_told_by_their_case():
    """Texts are lower-cased together only where that cannot make a special token."""
    definition = open(PATH, encoding="utf-8").read()
    for texts in (["A<|endoftext|>B", "<|ENDOFTEXT|> Ça", "PLAIN"], ["PLAIN É\u0301 A\u0301 İ K ΑΣ", "Don'T 'S"]):
        own, whole = packing.WordTokenizer(definition), Tokenizer.from_file(PATH)
        ids, ends = own.ids(pa.array(texts))
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and np.diff(ends, prepend=0).tolist() == list(map(len, want))


def test_caches_drop_old_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    own, whole = packing.WordTokenizer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    draw = random.Random(8)
    for _ in range(30):
        text = " ".join(f"w{draw.randint(0, 60)}, {draw.randint(0, 9)}" for _ in range(15))
        assert own.ids(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_parts_of_different_words_are_coded_once():
    """Words that differ in marks and digits alone have the same parts, which a batch codes and keeps once."""
    own, whole = packing.WordTokenizer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    text = " ".join(f"{a}{w}{i}{b}" for w in ("word", "Other") for i in range(40) for a in ("", "(") for b in ("", ",", "!"))
    assert own.ids(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    kept = sum(len(c.young) for c in vars(own).values() if isinstance(c, packing.Recent))
    assert kept <= 2 + 10 + 3  # letters, digits and marks, not 480 words
