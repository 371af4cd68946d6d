"""Chat formatting from event logs: fold events into final messages, render them, read them back.

One exchange by conversation serves all steps: events of a message are folded by an aggregate, a
window over the turns drops branches that a regeneration replaced and adds up offsets, and one row per
conversation comes out. Everything is a DataFrame function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from zeitton.llm.text import whole

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """No control string is left: backslashes are doubled, and one goes into each ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    return F.when(F.contains(text, F.lit("\\")), plain).otherwise(text)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of a log ``conv_id, seq, kind, turn, role, text``.

    Events of a turn apply in the order of ``seq``: ``message``, ``edit`` and ``regenerate`` replace
    the text, ``delta`` appends to it; the role is that of the last replacing event, else of the first delta. A ``regenerate`` also drops all
    later turns that were written before it. Events of equal ``seq`` go by role and text. Null text
    and role are empty; other kinds are ignored; null conversations and turns are values of their own.
    """
    said = events.where(F.col("kind").isin("message", "edit", "regenerate", "delta"))
    said = said.select("conv_id", "turn", "kind", F.struct("seq", whole("role").alias("role"), whole("text").alias("text")).alias("e"))
    kind = F.col("kind")
    folded = said.groupBy("conv_id", "turn").agg(
        F.max(F.when(kind != "delta", F.col("e"))).alias("base"),
        F.collect_list(F.when(kind == "delta", F.col("e"))).alias("deltas"),
        F.min("e").alias("first"),
        F.max(F.when(kind == "regenerate", F.col("e.seq"))).alias("redone"),
    )
    base = F.col("base")
    later = F.filter(F.sort_array("deltas"), lambda d: base.isNull() | (d["seq"] > base["seq"]))
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.select(
            "conv_id",
            "turn",
            F.coalesce(base["role"], F.col("first.role")).alias("role"),
            F.concat(F.coalesce(base["text"], F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), "")).alias("text"),
            F.coalesce(base["seq"], F.col("first.seq")).alias("written"),
            "redone",
        )
        .withColumn("cut", F.max("redone").over(earlier_turns))
        .where(F.col("cut").isNull() | (F.col("written") > F.col("cut")))
        .select("conv_id", "turn", "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``spans`` of its turns.

    A span has the code-point offsets ``start`` of the turn, ``text_start`` and ``text_end`` of its
    text, and ``loss``: whether the text is under the loss mask (the turns of the assistant).
    """
    role, text = escaped(whole("role")), escaped(whole("text"))
    pieces = messages.select(
        "conv_id",
        "turn",
        F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("piece"),
        (F.length(role) + len(TURN) + len(TEXT)).cast("bigint").alias("head"),
        (whole("role") == TRAINED_ROLE).alias("loss"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    turns = pieces.withColumn("start", start).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece", "head", "loss"))).alias("turns")
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            "turns",
            lambda t: F.struct(
                t["start"].alias("start"),
                (t["start"] + t["head"]).alias("text_start"),
                (t["start"] + F.length(t["piece"]) - len(END)).alias("text_end"),
                t["loss"].alias("loss"),
            ),
        ).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` as they stand in rendered conversations.

    The output is cut after each end mark, which no escaped text holds, so reading is linear; texts
    under the loss mask are taken by their offsets.
    """

    def turn_of(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        return F.struct(
            unescaped(F.substr(role, F.lit(len(TURN) + 1))).alias("role"),
            unescaped(
                F.substr(piece, F.length(role) + len(TEXT) + 1, F.length(piece) - F.length(role) - len(TEXT) - len(END))
            ).alias("text"),
        )

    def under_mask(piece: Column, span: Column) -> Column:
        cut = F.substr(
            piece,
            (span["text_start"] - span["start"] + 1).cast("int"),
            (span["text_end"] - span["text_start"]).cast("int"),
        )
        return F.when(span["loss"], unescaped(cut)).otherwise("")

    pieces = F.array_remove(F.split("formatted", r"(?<=<\|end\|>)"), "")
    return formatted.select("conv_id", "formatted", "spans", pieces.alias("pieces")).select(
        "conv_id",
        F.transform("pieces", turn_of).alias("turns"),
        F.array_join(F.zip_with("pieces", "spans", under_mask), "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def log_of_rows(rows: DataFrame) -> DataFrame:
    """Stored turns ``conv_id, turn, role, text`` as a log: one ``message`` event per row.

    Rows go by turn, role and text, and each is a turn of its own, repeated ones included.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(order).alias("seq"), F.lit("message").alias("kind"), "role", "text"
    ).withColumn("turn", F.col("seq"))


def streamed_log(rows: DataFrame) -> DataFrame:
    """Stored turns as the log of a chat that led to them.

    A turn of the trained role was streamed in deltas, gone on from, and regenerated: a first draft, a further turn that the
    regeneration takes back, and the deltas of the text that stayed. Any other turn was sent as a draft and edited.
    Folding gives the turns of ``log_of_rows`` again.
    """

    def event(at: int, kind: str, text: Column, turn: int = 0, role: Column = F.col("role")) -> Column:
        return F.struct(
            (F.col("seq") * 8 + at).alias("seq"), F.lit(kind).alias("kind"), (F.col("turn") + turn).alias("turn"),
            role.alias("role"), text.alias("text"),
        )

    text, half = F.col("text"), F.floor(F.length(whole("text")) / 2).cast("int")
    begin, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    streamed = F.array(
        event(0, "delta", F.concat(F.lit("draft of "), begin)),
        event(1, "message", F.lit("taken back"), turn=1, role=F.lit("user")),
        event(2, "regenerate", F.lit("")), event(3, "delta", begin), event(4, "delta", rest),
    )
    edited = F.array(event(0, "message", F.lit("draft")), event(1, "edit", text))
    events = F.explode(F.when(whole("role") == TRAINED_ROLE, streamed).otherwise(edited))
    return log_of_rows(rows).select("conv_id", events.alias("e")).select("conv_id", "e.*")


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
