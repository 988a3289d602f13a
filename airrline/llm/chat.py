"""Chat formatting with a grammar round trip; DataFrame functions only.

Template: ``<turn ROLE>\\nTEXT</turn>\\n`` for each turn. A turn is rendered as
it is, parsed again, and compared with its source; where they differ, the
conflicting strings in its text are escaped: every ``<``, backslashes, ``turn``
or ``/turn`` gets one backslash more, so no text can begin or end a turn, and
reading takes one away. One more backslash always suffices, so the loop "escape until
identical" is two steps long and fits an expression. The result is compared once
more as a whole conversation; a difference there stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_OPEN, _HEAD_END, _CLOSE = "<turn ", ">\n", "</turn>\n"
_CODES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))  # in roles; the first is undone last


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _role_out(role: Column) -> Column:
    for raw, coded in _CODES:
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def _role_in(role: Column) -> Column:
    for raw, coded in reversed(_CODES):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(_OPEN), _role_out(role), F.lit(_HEAD_END), body, F.lit(_CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text, as an array of (role, text): each ends at ``</turn>`` and begins at the last ``<turn`` before."""
    segments = F.split(formatted, r"</turn>\n?")
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)  # nothing follows the last end of turn

    def turn(s: Column) -> Column:
        own = F.substring_index(s, _OPEN, -1)
        cut = F.instr(own, _HEAD_END)
        body = F.substring(own, cut + len(_HEAD_END), F.length(own))
        return F.struct(_role_in(F.substring(own, F.lit(1), cut - 1)).alias("role"), _unescape(body).alias("text"))

    return F.transform(segments, turn)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted``, ``loss_spans`` and ``identical``.

    Turns go by number, NULL first, ties by role and text; repeated rows are
    turns of their own. NULL roles and texts are empty. Rows with a NULL id form
    one conversation. ``loss_spans`` holds (start, end) in code points, end
    exclusive, of the bodies whose role is ``learn``, in order, escaped as they
    stand. ``identical`` says that parsing gives back the source turns; where it
    does not, reading ``formatted`` is an error. An empty
    table gives an empty result; other columns are not read. A conversation is
    one text, so its rows meet in one task; no other rows do.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    again = parse(_render(F.col("role"), F.col("text")))
    source = F.array(F.struct("role", "text"))
    turns = turns.withColumn("body", F.when(again == source, F.col("text")).otherwise(_escape(F.col("text"))))
    turns = turns.withColumn("shown", _render(F.col("role"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("shown")).over(place) - len(_CLOSE)
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))
    span = F.when(F.col("role") == learn, F.struct("start", "end"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "shown", span.alias("span")))).alias("t"))
    chats = chats.withColumn("formatted", F.array_join(F.col("t.shown"), ""))
    kept = F.filter(F.col("t.span"), lambda s: s.isNotNull())
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    chats = chats.withColumn("identical", same)
    told = F.when(F.col("identical"), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back as its turns")))
    return chats.select(F.col("conv_id").alias(conv_col), told.alias("formatted"), kept.alias("loss_spans"), "identical")


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, read back: an array of texts."""
    return F.transform(spans, lambda s: _unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What parsing reads back from ``formatted``, and what ``loss_spans`` mark in it, as counts and SHA-256."""
    t = chats.withColumn("turns", parse(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    t = t.withColumn("whole", whole).withColumn("loss", loss)
    return t.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode("whole", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
