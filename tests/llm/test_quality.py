"""Quality rules on rows chosen by hand."""

import random

import corpus_pipeline
from tests.llm.helpers import documents
from zeitton.llm.quality import judge


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def run(spark, texts, source="s", **options):
    return {r.doc_id: r for r in judge(documents(spark, texts, source), **options).collect()}


def test_measures(spark):
    got = run(spark, ["a b c d a b c\n\n# x\n# x\n", "", None, "a a a a", "#*$%&|<>!"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(got[i][n] for n in names) for i in range(5)] == [
        (11, 11, 2, 1, 6), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (4, 4, 0, 0, 4), (1, 9, 8, 0, 0),
    ]
    assert all(r.base_failed and not r.kept for r in got.values())


def template_host(name, first, pages, others):
    """Pages of a host that are one template around a few words, and other pages of the host, ids from ``first``."""
    menu = "\n".join(prose(f"{name}-{k}", 14) for k in range(4))
    rows = [(first + i, f"{menu}\n{prose(f'{name}/{i}', 12)}") for i in range(pages)]
    return rows + [(first + pages + i, prose(f"{name}?{i}", 80)) for i in range(others)]


def test_depleted_documents_of_small_and_large_hosts(spark):
    """Production parameters: a template goes at any size of host, pages that share little and rare lines stay."""
    hosts = {"small": template_host("s", 0, 8, 4), "large": template_host("l", 1000, 200, 600), "rare": template_host("r", 3000, 40, 560)}
    hosts["few"] = template_host("f", 5000, 5, 0)
    docs = None
    for host, rows in hosts.items():
        some = documents(spark, rows, host)
        docs = some if docs is None else docs.union(some)
    found = {r.doc_id: r for r in judge(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [i for i in range(12) if found[i].kept] == [0, 8, 9, 10, 11]
    assert [i for i in range(1000, 1800) if found[i].kept] == [1000, *range(1200, 1800)]
    assert all(found[i].n_removed_words == 56 for i in [*range(1, 8), *range(1001, 1200)])
    # 40 of 600 pages are less than a tenth, and 5 pages are no more than the least number.
    assert all(r.kept and r.n_removed_words == 0 for i, r in found.items() if i >= 3000)


def test_documents_count_and_not_texts(spark):
    line, texts = prose(1, 16), [prose(10 + k, 100) for k in range(3)]
    rows = [(i, f"{line}\n{texts[i % 3]}") for i in range(30)] + [(100 + i, prose(200 + i, 60)) for i in range(30)]
    again = [(0, f"{line}\n{texts[0]}")] * 4  # rows of one id are one document
    found = judge(documents(spark, rows + again)).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert [i for i in range(30) if kept[i]] == [0, 1, 2] and all(kept[i] for i in range(100, 130))
    few = [(i, f"{line}\n{prose(50 + i, 60)}") for i in range(5)] + again
    assert all(r.kept and r.n_removed_words == 0 for r in judge(documents(spark, few)).collect())


def test_null_hosts_lose_nothing(spark):
    rows = template_host("n", 0, 30, 0)
    assert all(r.kept and r.n_removed_words == 0 for r in judge(documents(spark, rows, None)).collect())


def test_hosts_nulls_repeats_and_clashing_columns(spark):
    texts = [(1, prose(1, 60)), (1, prose(1, 60)), (None, prose(2, 60)), (None, None)]
    docs = documents(spark, texts, None).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "n_words")
    rows = judge(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 0, False), (0, 60, True), (1, 60, True), (1, 60, True)]
    assert judge(docs.limit(0)).collect() == []


def test_long_text(spark):
    words = prose(3, 30_000).split()
    got = run(spark, [" ".join(words), " ".join(words[:10_000] * 2)])
    assert got[0].kept and got[1].n_repeat_words == 20_000 and got[1].base_failed


def test_removed_lines_leave_the_text(spark):
    """Production parameters: 60 documents of a host share two lines that are 60 % of each; other hosts do not count."""
    shared, short = [prose(500, 40), prose(501, 35)], "Menu"
    texts = {i: "\n".join([shared[0], short, prose(i, 30), f"\t{shared[1].upper()} ", prose(100 + i, 20), ""]) for i in range(60)}
    cut = {0: texts[0]} | {i: "\n".join([short, prose(i, 30), prose(100 + i, 20), ""]) for i in range(1, 60)}
    other = documents(spark, [(1000, texts[7]), (1001, None)], "other")
    docs = documents(spark, list(texts.items())).union(other)
    found = {r.doc_id: r for r in judge(docs).collect()}
    assert {i: found[i].text for i in range(60)} == cut
    assert found[1000].text == texts[7] and found[1001].text is None
    assert all(found[i].kept and found[i].n_removed_words == (75 if i else 0) and found[i].n_words == 126 for i in range(60))
    stage = {r.doc_id: r for r in corpus_pipeline.keep_good(spark, docs, "").collect()}
    assert {i: r.text for i, r in stage.items()} == cut | {1000: texts[7]}
    assert all(r.n_chars == len(r.text) for r in stage.values())


def test_one_id_with_two_texts_loses_own_lines_only(spark):
    line = prose(1, 12)
    texts = [(0, line), (1, f"{line}\n{prose(2, 60)}"), (1, f"{prose(3, 30)}\n{prose(4, 30)}\n{line}"), (None, prose(5, 60))]
    rows = judge(documents(spark, texts), min_docs=1).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows) == sorted(
        [(-1, prose(5, 60)), (0, line), (1, prose(2, 60)), (1, f"{prose(3, 30)}\n{prose(4, 30)}")]
    )
