"""Chat logs folded, rendered and read back."""

from zeitton.llm.chat import digests, fold_events, log_of_rows, read_back, render, streamed_log

LOG = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string"
ROWS = "conv_id bigint, turn bigint, role string, text string, kept string"


def folded(spark, events):
    rows = fold_events(spark.createDataFrame(events, LOG)).collect()
    return sorted((r.conv_id, r.turn, r.role, r.text) for r in rows)


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, "assistant", "llo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "delta", 3, "assistant", "old"), (1, 6, "edit", 0, "user", "hi!"),
        (1, 7, "regenerate", 1, "assistant", ""), (1, 8, "delta", 1, "assistant", "new"), (1, 9, "delta", 1, "assistant", None),
        (1, 10, "message", 2, "user", "again"), (1, 11, "noise", 9, "user", "?"),
        (2, 1, "delta", 0, None, "only"), (2, 2, "delta", 0, None, " deltas"),
    ]
    want = [(1, 0, "user", "hi!"), (1, 1, "assistant", "new"), (1, 2, "user", "again"), (2, 0, "", "only deltas")]
    assert folded(spark, reversed(events)) == want
    assert folded(spark, []) == []


def test_control_strings_come_back(spark):
    texts = ["<|turn|>x<|end|>", "\\", "\\\\<|", "<\\|end|>", "a\nb", None, "", "<<||>>", "é漢🎉", "x" * 100_000, "same", "same"]
    rows = [(1, i, "assistant" if i % 2 else "us<|text|>er", t, "") for i, t in enumerate(texts)]
    rows += [(2, 0, None, "p", ""), (2, 0, None, "p", ""), (None, None, "user", "q", "")]
    shown = render(fold_events(log_of_rows(spark.createDataFrame(rows, ROWS))))
    got = {r.conv_id: r for r in read_back(shown).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert got[1].loss_text == "".join(t or "" for t in texts[1::2])
    assert [tuple(t) for t in got[2].turns] == [("", "p"), ("", "p")]
    assert [tuple(t) for t in got[None].turns] == [("user", "q")]
    stored = {r.conv_id: r for r in shown.collect()}
    for r in stored.values():
        assert r.spans[-1].text_end + len("<|end|>") == len(r.formatted) == got[r.conv_id].formatted_chars
    assert digests(read_back(shown)).count() == 3


def test_streamed_log_folds_back_to_its_turns(spark):
    """Drafts, turns taken back and halves of texts leave nothing behind, at the end of a conversation either."""
    texts = ["q", "an answer", None, "", "é🎉x", "x", "same", "same", "end"]
    rows = [(c, i, "assistant" if (i + c) % 2 else "user", t, "") for c in (1, 2) for i, t in enumerate(texts)]
    rows += [(3, 0, "assistant", "a", ""), (3, 0, "assistant", "b", ""), (4, 0, None, "p", ""), (None, None, "assistant", "r", "")]
    df = spark.createDataFrame(rows, ROWS)
    log = streamed_log(df)
    assert {r.kind for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    want = sorted(map(str, fold_events(log_of_rows(df)).collect()))
    assert sorted(map(str, fold_events(log).collect())) == want and len(want) == len(rows)
    assert streamed_log(df.limit(0)).collect() == []
