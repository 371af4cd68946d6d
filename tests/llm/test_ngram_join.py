"""N-gram join against all pairs of shingle sets."""

import random
import re

import numpy as np

from tests.llm.helpers import documents
from zeitton.llm import ngram_join
from zeitton.llm.ngram_join import keep_one, least_matches, shared, similar_documents


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(texts):
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    links = [[j for j in range(len(sets)) if j != i and near(sets[i], sets[j])] for i in range(len(sets))]
    label, changed = list(range(len(sets))), True
    while changed:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(sets))]
        label, changed = new, new != label
    return {i: (label[i], len(links[i]), label[i] == i) for i in range(len(sets))}


def corpus(size=40):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6)))
    texts = [None, "", "  \n", "one", "one", "one two", "one  two", "a b c d", "a b c d e", "a b c d e f"]
    for changes in (0, 1, 2, 4, 8):
        base = [word() for _ in range(120)]
        for _ in range(size // 5):
            own = list(base)
            for _ in range(changes):
                own[draw.randrange(120)] = word()
            texts.append(" ".join(own))
    return [*texts, *(" ".join(word() for _ in range(80)) for _ in range(20)), " ".join(word() for _ in range(30_000))]


def test_links_classes_and_kept(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)  # several tiles a group
    texts = corpus()
    docs = documents(spark, texts).withColumnRenamed("lang", "kept").withColumnRenamed("source", "class_id")
    found = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in similar_documents(docs).collect()}
    assert found == expected(texts)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, v in expected(texts).items() if v[2]]


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "some words that are long enough to count"
    docs = documents(spark, [(7, text), (7, text), (None, text), (3, "other words that nobody else has here")])
    rows = sorted(((r.doc_id or 0), r.class_id, r.n_links) for r in similar_documents(docs).collect())
    assert rows == [(0, None, 2), (3, 3, 0), (7, None, 2), (7, None, 2)]
    assert sorted((r.doc_id or 0) for r in keep_one(docs).collect()) == [0, 3]
    assert similar_documents(docs.limit(0)).collect() == []


def test_rows_without_words_all_stay(spark):
    text, blanks = "some words that are long enough to count", ["", "", None, None, " \t\n\x0b\x0c\r", " \t\n\x0b\x0c\r", "\n"]
    rows = [(None, t) for t in blanks] + [(5, ""), (5, ""), (None, text), (None, text), (5, "\xa0"), (5, "\xa0"), (6, "\x1f\x85")]
    got = keep_one(documents(spark, rows)).collect()
    shown = lambda rows: sorted((-1 if i is None else i, t is None, t or "") for i, t in rows)
    assert shown((r.doc_id, r.text) for r in got) == shown(rows[:10] + rows[11:12] + rows[13:])
    assert len(keep_one(documents(spark, [(None, t) for t in blanks])).collect()) == len(blanks)


def test_posterior_bounds():
    fewest = least_matches(0.8, 1e-9)
    draw = np.random.default_rng(1)
    matches = np.cumsum(draw.random((20_000, 252)) < 0.8, axis=1)[:, 27::28]
    assert (matches >= np.array(fewest)).all()  # true links are not lost
    assert fewest[-1] > 252 * 0.6  # and clearly smaller similarities are


def test_both_ways_to_intersect():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 4000, 300)).astype(np.uint64) for _ in range(12)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert shared(sets, sets, i, j).tolist() == want
    assert shared(sets, sets, i[:20], j[:20]).tolist() == want[:20]
