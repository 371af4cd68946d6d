"""SentencePiece encoding against the library, its decoder, and brute force over segmentations."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import documents
from zeitton.llm.pieces import Encoder, Vocabulary, decode_documents, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "  ", " ", "\n", "\t", "é", "é", "ß", "漢", "🎉", "▁", "1", "...", "</s>", "<0x0A>", "\0", "ing", " " * 17]


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


def test_ids_equal_the_library(model):
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert Encoder(Vocabulary.of_model(model)).ids(pa.array(texts)).to_pylist() == library.encode(texts)


def segmentations(word, scores):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in scores:
            for rest in segmentations(word[n:], scores):
                yield (word[:n], *rest)


def test_viterbi_finds_the_largest_sum():
    draw = random.Random(2)
    scores = {c: -4.0 for c in " abc"}
    scores |= {"".join(draw.choice("abc") for _ in range(draw.randint(2, 4))): -draw.uniform(1, 6) for _ in range(25)}
    table = {p: (i, s) for i, (p, s) in enumerate(scores.items())}
    vocabulary = Vocabulary(table, [0] * 256, merges=False)
    words = sorted({"".join(draw.choice("abc ") for _ in range(draw.randint(1, 9))) for _ in range(200)})
    names = list(scores)
    for word, ids in zip(words, vocabulary.encode_sorted(words), strict=True):
        assert "".join(names[i] for i in ids) == word
        best = max(sum(scores[p] for p in s) for s in segmentations(word, scores))
        assert abs(sum(scores[names[i]] for i in ids) - best) < 1e-9


def test_round_trip_and_odd_rows(spark):
    texts = ["", None, " two  blanks ", "x" * 50_000, "é\n\tß", "same", "same"]
    docs = documents(spark, texts).withColumnRenamed("lang", "ids")
    coded = encode_documents(docs, MODEL)
    assert coded.columns == docs.columns
    back = {r.doc_id: r.text for r in decode_documents(coded.drop("text"), MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_documents(docs.limit(0), MODEL).collect() == []


def test_decode_of_odd_ids(spark, model):
    rows = spark.createDataFrame([(1, None), (2, [1, 2, 10**6, -5]), (3, [3 + 0xC3])], "doc_id int, ids array<int>")
    found = {r.doc_id: r.text for r in decode_documents(rows, MODEL).collect()}
    assert found[1] == found[2] == "" and found[3] == "�"


def test_border_of_two_pieces_is_judged_as_by_merging():
    """Costs with ties and pieces that merging does not reach; a piece is merged once, however many pairs it is in."""
    draw = random.Random(5)
    for _ in range(20):
        names = ["a", "b", "c", *{"".join(draw.choice("abc") for _ in range(draw.randint(2, 5))) for _ in range(25)}]
        vocabulary = Vocabulary({p: (i, -float(draw.randint(0, 12))) for i, p in enumerate(names)}, [0] * 256, merges=True)
        merged, calls = vocabulary.merged, []
        vocabulary.merged = lambda text, merged=merged, calls=calls: calls.append(text) or merged(text)
        found = {(i, j): vocabulary.stay_apart(i, j) for i in range(len(names)) for j in range(len(names))}
        assert len(calls) == len(names)
        for (i, j), apart in found.items():
            assert apart == (merged(names[i] + names[j])[0] == [names[i], names[j]])
