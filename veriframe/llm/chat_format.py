"""Chat formatting: conversations rebuilt from an event log, then rendered with a template and a loss mask.

The log is partitioned by conversation and sorted by sequence. Events of one message (start, streamed deltas, edits,
regenerations) fold into its final text; messages of one conversation fold into the rendered text. Only a message's own
events and a conversation's own messages ever meet in one row, as the rendered conversation itself does.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each message. Inside texts and roles, `<|` gets a backslash before the
bar, and one more where backslashes already stand there, so that the marks of the template never occur in them; taking
one backslash away restores the text. A role stands on one line: its backslashes are doubled and its line feeds written
as backslash and n before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    """Text without any `<|`: `<`, k backslashes, `|` becomes the same with k + 1."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role on one line: backslashes doubled and line feeds written as backslash n, then as a text."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    parts = F.split(unescape(c), r"\\\\", -1)  # at doubled backslashes, where no other backslash can hide
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def as_events(rows: DataFrame, order_col: str = "turn") -> DataFrame:
    """A log with one `start` event for each row, so that rows of one place stay messages of their own."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(order_col, "role", "text"))
    return rows.select("conv_id", order_col, "role", "text").select(
        "conv_id", place.alias("message"), F.lit(0).alias("seq"), F.lit("start").alias("kind"), "role", "text"
    )


def as_streamed_events(rows: DataFrame, order_col: str = "turn") -> DataFrame:
    """A log as a chat service writes it, that folds into the same messages: texts come in parts, and not all at first hand.

    Of every three messages of a conversation the first is streamed in deltas, the second is begun, thrown away and
    regenerated, and the third is begun with other text, edited and gone on with. Only a message's first event has its role.
    """
    placed = as_events(rows, order_col).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    part = lambda a, b: F.substring(F.col("text"), F.floor(n * a / 3).cast("int") + 1, F.floor(n * b / 3).cast("int") - F.floor(n * a / 3).cast("int"))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), (F.col("role") if i == 0 else F.lit(None).cast("string")).alias("role"), t.alias("text")) for i, (k, t) in enumerate(events)])

    streamed = log(("start", F.lit("")), ("delta", part(0, 1)), ("delta", part(1, 2)), ("delta", part(2, 3)))
    again = log(("start", part(1, 3)), ("delta", part(0, 2)), ("regenerate", part(0, 1)), ("delta", part(1, 3)))
    edited = log(("start", part(0, 1)), ("delta", F.lit("?")), ("edit", part(0, 2)), ("delta", part(2, 3)))
    kind = F.col("message") % 3
    return placed.select("conv_id", "message", F.explode(F.when(kind == 1, streamed).when(kind == 2, again).otherwise(edited)).alias("e")).select("conv_id", "message", "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """Messages from an event log: conv_id, message, role, text.

    events: conv_id, message (its place in the conversation), seq, kind, role, text. Kinds: `start` and `regenerate`
    throw away what the message held and begin anew with their text, `edit` replaces it, `delta` appends to it, and
    `delete` removes the message until a later `start` or `regenerate`. Null texts are empty; unknown or null kinds
    append as deltas. The role is the last that is not null, else empty. Ties in seq are ordered by kind, role and text.
    """
    one = F.struct(
        F.col("seq"),
        F.when(F.col("kind").isin("start", "regenerate"), 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "delete", 3).otherwise(2).alias("kind"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_message = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(one)).alias("log"))
    # Where the last event that sets the whole text stands; only deltas after it count.
    places = F.transform("log", lambda e, i: F.when(e["kind"] != 2, i + 1))
    begin = F.coalesce(F.array_max(places), F.lit(0))
    setter = F.try_element_at("log", F.when(F.col("begin") > 0, F.col("begin")))
    tail = F.filter("log", lambda e, i: (i >= F.col("begin")))
    roles = F.array_compact(F.transform("log", lambda e: e["role"]))
    return (
        by_message.withColumn("begin", begin)
        .withColumn("set", setter)
        .filter("set is null or set.kind <> 3")
        .select(
            "conv_id",
            "message",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.concat(F.coalesce("set.text", F.lit("")), F.array_join(F.transform(tail, lambda e: e["text"]), "")).alias("text"),
        )
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    messages: conv_id, message (order), role, text. Rows of one place are all kept, ordered by role and text. Null roles
    and texts are empty, null places come first, and null conv_ids make one conversation. `loss_spans` are (start,
    length) of the trained role's escaped texts, in characters of `formatted` from 0. Other columns are not read; an
    empty table gives no row.
    """
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("trained"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))).alias("parts"),
    )

    def step(acc, p):
        at, n = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        spans = F.when(p["trained"], F.concat(acc["spans"], F.array(F.struct(at.alias("start"), n.alias("length"))))).otherwise(acc["spans"])
        return F.struct((at + n + len(END)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", zero, step)["spans"].alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text and formatted, from the rendered text and its mask alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p):
        body = F.substring(p, len(START) + 1, 2147483647)
        cutting = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), cutting - 1)).alias("role"),
            unescape(F.substring(body, cutting + 1, F.lit(2147483647))).alias("text"),
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """What read_back returns, as counts and hashes."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
