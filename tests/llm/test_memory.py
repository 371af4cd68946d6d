"""What tasks of the corpus operators hold at a time, and what they leave to the worker."""

import random
import tracemalloc
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from zeitton.llm import memory, ngram_join, packing, suffix_dedup


def sketch(docs):
    ngram_join.sketch(docs.select("doc_id", "text"), 5, 11)


def sets(docs):
    ngram_join.with_sets(docs.select(*(F.col("doc_id").alias(c) for c in ("root", "tile", "tiles", "node", "copies")), "text"), 5, 11)


def anchors(docs):
    suffix_dedup.anchors(docs.select("doc_id", F.lit(0).alias("hash"), "text"), 200)


def cut(docs):
    packing.cut_pieces(docs, Path(public_tokenizers.path("word_bpe_49k.json")).read_text("utf-8"), "doc_id", "text", 4096)


@pytest.mark.parametrize(("build", "numbers", "limit_mb"), [(sketch, 3, 100), (sets, 5, 100), (anchors, 2, 150), (cut, 1, 110)])
def test_memory_does_not_grow_with_the_batch(spark, monkeypatch, build, numbers, limit_mb):
    """Four megabytes of texts that come in one batch are worked on a part at a time."""
    docs, found = documents(spark, ["a text"]), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *a, **k: found.append(f) or real(df, f, *a, **k))
    build(docs)
    draw = random.Random(5)
    texts = [" ".join(f"{draw.randrange(36**6):x}" for _ in range(250)) for _ in range(1900)]
    assert sum(map(len, texts)) > 3_500_000
    columns = [pa.array(range(len(texts)))] * numbers + [pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(numbers + 1)])
    del texts
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in found[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < limit_mb


def test_memory_is_handed_back_after_a_task_has_let_go_of_it(monkeypatch):
    order = []
    monkeypatch.setattr(memory, "release", lambda: order.append("released"))

    class Held:
        def __del__(self):
            order.append("let go")

    @memory.lean
    def doubled(batches):
        held = Held()
        for x in batches:
            yield 2 * x
        del held

    assert list(doubled(iter([1, 2]))) == [2, 4]
    assert order == ["let go", "released"]
    run = doubled(iter([3]))
    assert next(run) == 6
    run.close()  # a task that ends early
    assert order == ["let go", "released"] * 2


def test_memory_can_be_handed_back():
    memory.release()


def test_a_filter_on_the_rest_does_not_cut_texts_again(spark):
    cut = suffix_dedup.remove_repeats(documents(spark, ["a" * 300, "b"]), as_text=True).where(F.col("kept") != "")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.kept for r in cut.collect()] == ["b"]
