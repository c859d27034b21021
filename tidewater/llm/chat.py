"""Chat formatting from event logs.

A conversation is an event log. Events are partitioned by conversation and sorted by sequence number;
streamed deltas, edits and regenerations fold into final messages, which are rendered with a template.
Only DataFrame expressions are used. One exchange by conversation serves the fold, the positions and the
rendering; a conversation becomes one row, so that row is the largest thing a task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template: how a turn begins, what divides role and text, how a turn ends.
OPEN, DIVIDE, CLOSE = "### ", ": ", "</turn>\n"

#: Events that discard what their message held before, and the one that adds to it.
RESETS, APPENDS = ("message", "edit", "regenerate"), ("delta",)


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, seq, msg, kind, role, text`` events -> ``conv_id, msg, first_seq, role, text`` messages.

    ``message`` starts message ``msg`` with a text, ``delta`` adds to it, ``edit`` puts another text in its
    place, ``regenerate`` empties it (its own text, if any, is the new beginning). The final text is all that
    was added since the last reset. Null texts are empty; the role is the first one given, else empty;
    events of other kinds, or none, are passed over. Null ``conv_id`` and ``msg`` are values like others; null
    ``seq`` sorts first; events of equal ``seq`` are ordered by kind (resets first), then text. Repeated
    events count as often as they occur.
    """
    known = events.where(F.col("kind").isin(*RESETS, *APPENDS))
    event = F.struct(
        F.col("seq"), F.col("kind").isin(*APPENDS).alias("adds"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("role", F.lit("")).alias("role"),
    )
    log = known.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.filter(F.transform(F.col("log"), lambda e, k: F.when(~e["adds"], k)), lambda k: k.isNotNull())
    log = log.withColumn("last", F.coalesce(F.array_max(resets), F.lit(0)))
    since = F.transform(F.slice("log", F.col("last") + 1, F.size("log")), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    return log.select(
        "conv_id", "msg", F.get("log", F.lit(0))["seq"].alias("first_seq"),
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(since, "").alias("text"),
    )


def escape(text: Column) -> Column:
    """Make the template's control strings impossible in a text; ``unescape`` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(DIVIDE), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(messages: DataFrame, *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages -> one row per conversation.

    Columns: ``conv_id, n_turns, formatted``, ``segments`` (text and whether it is under the loss mask, which
    joined give ``formatted``) and ``loss_spans`` (start from 0 and length in characters). Messages are
    ordered by first sequence number, then ``msg``; only texts of ``trained`` roles are under the mask. A
    conversation without messages has no row.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("first_seq").asc_nulls_first(), F.col("msg").asc_nulls_first(), "role", "text")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(DIVIDE))
    turns = messages.withColumns({"head": head, "body": escape(F.col("text")), "loss": F.col("role").isin(*trained)})
    width = F.length("head") + F.length("body") + len(CLOSE)
    before = F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select(
        "conv_id", "head", "body", "loss", F.row_number().over(order).alias("pos"), (before + F.length("head")).alias("start"),
    )
    turn = F.struct("pos", "head", "body", "loss", "start")
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(CLOSE), F.lit(False)),
    )))
    masked = F.filter("turns", lambda t: t["loss"] & (t["body"] != ""))
    spans = F.transform(masked, lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("bigint").alias("length")))
    out = convs.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), parts.alias("segments"), spans.alias("loss_spans"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "loss_spans")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    at = lambda p: F.instr(p, DIVIDE)
    return F.transform(turns, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - (len(OPEN) + 1))).alias("role"),
        unescape(F.substring(p, at(p) + len(DIVIDE), F.length(p))).alias("text"),
    ))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, read back and unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives: turns, text under the mask, size."""
    back = chats.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def as_events(rows: DataFrame) -> DataFrame:
    """Stored turns (``conv_id, turn, role, text``) as a log with one ``message`` event each.

    Rows of one turn number, repeated rows included, stay separate messages, ordered by role and text. Other columns are
    not read. A conversation is one row of a task, however long its texts; an empty table gives an empty log.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.select("conv_id", F.col("turn").alias("seq"), F.row_number().over(order).alias("msg"), F.lit("message").alias("kind"), "role", "text")


def as_streamed_events(rows: DataFrame) -> DataFrame:
    """Stored turns as a log of what may have led to them; folding it gives the turns back.

    By a hash of conversation and turn, a turn is streamed in two parts, or a draft that is regenerated as a stream, or
    a first part that an edit replaces. Turns without a number or a text, and numbers that leave no room for the
    order of such events, are one ``message`` event.
    """
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    way = F.when(F.col("seq").between(-(2**60), 2**60) & text.isNotNull(), F.pmod(F.xxhash64("conv_id", "seq"), F.lit(3)))
    events = (
        F.when(way == 0, F.array(event(0, "message", first), event(1, "delta", second)))
        .when(way == 1, F.array(event(0, "message", F.concat(F.lit("draft "), first)), event(1, "regenerate", F.lit(None).cast("string")), event(2, "delta", first), event(3, "delta", second)))
        .when(way == 2, F.array(event(0, "message", first), event(1, "edit", text)))
        .otherwise(F.array(event(0, "message", text)))
    )
    seq = F.when(way.isNotNull(), F.col("seq") * 4 + F.col("e.k")).otherwise(F.when(F.col("seq").between(-(2**60), 2**60), F.col("seq") * 4).otherwise(F.col("seq")))
    told = as_events(rows).select("*", F.explode(events).alias("e"))
    return told.select("conv_id", seq.alias("seq"), "msg", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ': ', ':\ ')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 8 AS chars FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
