"""Line dedup on rows chosen by hand."""

from tests.llm.helpers import documents
from zeitton.llm.line_dedup import dedup_lines

LONG = "A line that is long enough"


def run(spark, texts, **options):
    rows = dedup_lines(documents(spark, texts).withColumnRenamed("lang", "n_lines"), **options).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_lines, r.n_dropped) for r in rows)


def test_smallest_id_keeps_all_its_lines(spark):
    texts = [f"own one\n{LONG}\n{LONG}", f"\t{LONG.upper()} \r\nshort\nshort", "short", f"{LONG}", "", None]
    assert run(spark, texts) == [
        (0, texts[0], 3, 0), (1, "short\nshort", 3, 1), (2, "short", 1, 0), (3, "", 1, 1), (4, "", 1, 0), (5, "", 1, 0),
    ]


def test_only_ascii_case_is_ignored(spark):
    texts = ["ÉCOLE DE DANSE", "école de danse", "école DE danse", "É" * 9, "É" * 9]
    assert [r[3] for r in run(spark, texts)] == [0, 0, 1, 0, 0]


def test_repeated_rows_and_null_ids(spark):
    assert run(spark, [(3, LONG), (3, LONG), (4, LONG)]) == [(3, LONG, 1, 0), (3, LONG, 1, 0), (4, "", 1, 1)]
    assert run(spark, [(None, LONG), (1, LONG)]) == [(-1, LONG, 1, 0), (1, "", 1, 1)]


def test_threshold_empty_table_and_long_text(spark):
    texts = [LONG, LONG, "another shared line"] + ["another shared line"] * 2
    assert [r[3] for r in run(spark, texts, min_docs=3)] == [0, 0, 0, 1, 1]
    assert dedup_lines(documents(spark, ["x"]).limit(0)).collect() == []
    many = "\n".join(f"line number {i}" for i in range(20_000))
    assert [r[2:] for r in run(spark, [many, many])] == [(20_000, 0), (20_000, 20_000)]
