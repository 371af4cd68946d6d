"""The pipeline stage by stage against plain Python."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import documents
from tests.llm.test_ngram_join import expected as similar_texts
from tests.llm.test_suffix_dedup import expected as repeated_bytes

SPACE = " \t\n\x0b\x0c\r"


def corpus():
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = [word() for _ in range(150)], prose(60)
    near = []
    for _ in range(4):
        own = list(base)
        own[draw.randrange(150)] = word()
        near.append(" ".join(own))
    shared_line = "a line that several pages share"
    copied = prose(80) + "\n" + prose(30)
    return [
        None, "", "too short", copied, copied, copied.upper(), passage, prose(100), "x y " * 60, *near,
        *(f"{prose(70)} {passage} {prose(20)}" for _ in range(3)),
        *(f"{prose(40)}\n{shared_line}\n{prose(40)}" for _ in range(3)), prose(9000),
    ]


def test_stages(spark, tmp_path):
    texts = dict(enumerate(corpus()))
    docs, steps = documents(spark, list(texts.items())), iter(corpus_pipeline.STAGES)
    columns = docs.columns

    rows_kept = []

    def next_stage(name):
        nonlocal docs
        found, function = next(steps)
        assert found == name
        out = function(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return docs

    def check(want):
        rows = docs.collect()
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r.text.strip(SPACE) and r.n_chars == len(r.text) for r in rows)  # nothing empty goes on
        rows_kept.append(len(rows))
        return want

    next_stage("quality rules")
    texts = check({i: t for i, t in texts.items() if len((t or "").split()) >= 50 and not t.startswith("x y")})

    next_stage("line dedup")
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(line.strip(SPACE).lower(), set()).add(i)
    gone = lambda line, i: len(line.strip(SPACE)) >= 10 and min(holders[line.strip(SPACE).lower()]) != i
    cut = {i: "\n".join(x for x in t.split("\n") if not gone(x, i)) for i, t in texts.items()}
    want = {i: t for i, t in cut.items() if t.strip(SPACE)}
    assert want != texts and len(want) == len(texts) - 2  # the copies, of which no line is left
    texts = check(want)

    next_stage("n-gram join")
    ids = list(texts)
    want = {ids[k]: texts[ids[k]] for k, v in similar_texts(list(texts.values())).items() if v[2]}
    assert len(want) == len(texts) - 3
    texts = check(want)

    next_stage("suffix-array dedup")
    cut = {i: w[3].decode("utf-8", "ignore") for i, w in zip(texts, repeated_bytes(list(texts.values())), strict=True)}
    want = {i: t for i, t in cut.items() if t.strip(SPACE)}
    assert want != texts and len(want) == len(texts) - 1  # the document that is one repeated passage
    texts = check(want)

    next_stage("packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter({i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()})
    covered = Counter()
    for r in docs.collect():
        covered[r.doc_id] += r.length
    assert covered == tokens
    assert rows_kept == [16, 14, 11, 10]


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100 and max(r.offset + r.length for r in rows) <= 4096
