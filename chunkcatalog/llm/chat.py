"""Chat formatting with a grammar round trip.

Grammar: a conversation is a sequence of turns ``<s>ROLE[INST] TEXT [/INST]</s>``; ROLE and TEXT hold no control string
(``<s>``, ``</s>``, ``[INST]``, ``[/INST]``). Escaping puts a backslash behind the opening bracket of a control string,
and one more where backslashes stand there already; unescaping takes one away, so it is reversible for every text.

Each conversation is first rendered as it is, reparsed by a deterministic parser and compared with its source turns. If
they differ, its conflicting content is escaped and it is rendered, reparsed and compared again; as escaping is
reversible the second round is always identical, and ``raise_error`` says so if it ever were not.

Only DataFrame functions are used. A conversation becomes one string, so its turns meet in one task by nature.

Cases: null text or role counts as empty; turns are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order and all stay; null conv_id is a conversation of its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
_ESCAPABLE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
_OPEN, _ROLE_END, _TEXT_END, _CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _render(turns: Column, how) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(_OPEN), how(t["role"]), F.lit(_ROLE_END), how(t["text"]), F.lit(_TEXT_END), F.lit(_CLOSE)))


def _segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their closing marks."""
    cut = F.split(formatted, _CLOSE, -1)
    return F.slice(cut, 1, F.size(cut) - 1)


def _role(segment: Column) -> Column:
    return F.substring_index(F.substr(segment, F.lit(len(_OPEN) + 1)), _ROLE_END, 1)


def _text_start(segment: Column) -> Column:
    return F.length(_role(segment)) + len(_OPEN) + len(_ROLE_END) + 1


def _text_length(segment: Column) -> Column:
    return F.length(segment) - _text_start(segment) + 1 - len(_TEXT_END)


def _turn(segment: Column) -> Column:
    """``(role, text)`` of one segment, or null where it is no turn: every marker must stand in its place, and fields hold no control string."""
    text = F.substr(segment, _text_start(segment), F.greatest(_text_length(segment), F.lit(0)))
    marked = F.startswith(segment, F.lit(_OPEN)) & F.endswith(segment, F.lit(_TEXT_END)) & F.contains(segment, F.lit(_ROLE_END)) & (_text_length(segment) >= 0)
    plain = ~_role(segment).rlike(CONTROL) & ~text.rlike(CONTROL)
    return F.when(marked & plain, F.struct(unescape(_role(segment)).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of ``(role, text)``, or null for what is no sentence of the grammar: a turn that is none, or something behind the last one."""
    turns = F.transform(_segments(formatted), _turn)
    whole = (formatted == "") | F.endswith(formatted, F.lit(_CLOSE))
    return F.when(whole & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, source, formatted, escaped, mask)`` for each conversation.

    ``source``: array of ``(role, text)``; ``mask``: for each assistant turn its place in the conversation (from 0) and
    the start (from 1) and length of its text inside that turn's segment of ``formatted``, in code points.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    x = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ordered"))
    x = x.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    x = x.withColumn("raw", F.array_join(_render(F.col("source"), lambda c: c), ""))
    x = x.withColumn("escaped", ~F.coalesce(parse(F.col("raw")).eqNullSafe(F.col("source")), F.lit(False)))
    x = x.withColumn("formatted", F.when(F.col("escaped"), F.array_join(_render(F.col("source"), escape), "")).otherwise(F.col("raw"))).drop("raw")
    x = x.withColumn("back", parse(F.col("formatted")))
    x = x.withColumn("back", F.when(F.col("back").eqNullSafe(F.col("source")), F.col("back")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back"))))
    segments = F.transform(_segments(F.col("formatted")), lambda s, i: F.struct(i.alias("turn"), _text_start(s).alias("start"), _text_length(s).alias("length")))
    mask = F.filter(F.arrays_zip(segments.alias("span"), F.transform("back", lambda b: b["role"]).alias("role")), lambda z: z["role"] == "assistant")
    return x.withColumn("mask", F.transform(mask, lambda z: z["span"])).select("conv_id", "source", "formatted", "escaped", "back", "mask")


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    segments = _segments(formatted)
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(F.element_at(segments, m["turn"] + 1), m["start"], m["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says when read back: counts and digests for each conversation."""
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = formatted.withColumn("segments", _segments(F.col("formatted")))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.element_at("segments", m["turn"] + 1), m["start"], m["length"]))), "")
    x = x.withColumn("loss", loss)
    return x.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
