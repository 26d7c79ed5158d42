"""Chat formatting from event logs, in DataFrame functions only.

A log row is an event: ``message`` begins a message with a text, ``delta`` appends
to it, ``edit`` replaces its text, ``regenerate`` empties it for the deltas that
follow (or for its own text). Events are folded message by message, messages are
put together by conversation and rendered by a template of marked turns. Control
strings inside texts are escaped, so that the formatted text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPE = "\u241b"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double the escape sign, then put one after the first character of each control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, "(?:(<)(?=\\||/?s>|</?SYS>>)|(\\[)(?=/?INST\\]))", f"$1$2{ESCAPE}")


def escape_role(role: Column) -> Column:
    """Also for text that has to stay on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape(text: Column) -> Column:
    """What was escaped: a single sign stands for nothing (before n for a line end), a pair for one."""
    lines = F.regexp_replace(text, f"(?<!{ESCAPE}){ESCAPE}n", "\n")
    single = F.regexp_replace(lines, f"(?<!{ESCAPE}){ESCAPE}(?!{ESCAPE})", "")
    return F.replace(single, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, seq, message_id, number, role, text.

    ``log`` has conv_id, seq, message_id, event, role, text. Events of a message go
    by seq, ties by event, role and text; ``seq`` of a message is that of its first
    event. Each ``message`` event begins a message of its own (``number`` counts those
    with one id, repeated rows included). Deltas before any ``message`` event begin one.
    Null texts and roles count as empty, null events as messages, null ids as one id.
    """
    known = F.when(F.lower("event").isin("delta", "edit", "regenerate"), F.lower("event")).otherwise("message")
    order = F.when(known == "message", 0).otherwise(1)
    event = F.struct(
        F.col("seq"), order.alias("order"), known.alias("event"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = log.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    starts = F.filter(
        F.transform("events", lambda e, i: F.when((e["event"] == "message") | (i == 0), i)), lambda i: i.isNotNull())
    whole = whole.withColumn("starts", starts)

    def message(begin: Column, number: Column) -> Column:
        end = F.coalesce(F.get("starts", number + 1), F.size("events"))
        own = F.slice("events", begin + 1, end - begin)
        reset = F.array_max(F.transform(own, lambda e, i: F.when(e["event"] != "delta", i).otherwise(0)))
        texts = F.transform(F.slice(own, reset + 1, end - begin), lambda e: e["text"])
        first = F.get("events", begin)
        return F.struct(number.alias("number"), first["role"].alias("role"), F.array_join(texts, "").alias("text"))

    folded = whole.select("conv_id", F.get("events", F.lit(0))["seq"].alias("seq"), "message_id", F.explode(F.transform("starts", message)).alias("m"))
    return folded.select("conv_id", "seq", "message_id", "m.number", "m.role", "m.text")


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, formatted, spans.

    ``spans`` is the loss mask: for each message of the learned role the number of its
    turn, where its turn and its escaped text begin in ``formatted`` and how long the
    text is, in code points. Messages go by seq, message_id and number; where each
    begins is a running sum, so a long conversation costs no more than its length.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = messages.withColumns({"head": head, "body": body}).select(
        "conv_id", "seq", "message_id", "number", (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.length("head").alias("before"), F.length("body").alias("length"), F.concat("head", "body", F.lit(END)).alias("block"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "message_id", "number")
    ahead = F.coalesce(F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"turn": F.row_number().over(order) - 1, "begin": ahead})
    span = F.struct("turn", F.col("begin").alias("turn_start"), (F.col("begin") + F.col("before")).alias("start"), "length")
    turn = F.struct("turn", "block", F.when(F.col("learned"), span).alias("span"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say: conv_id, turns (role, text), loss_text under the mask, formatted."""
    pieces = F.split("formatted", F.lit("<\\|im_end\\|>\n"))
    rows = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        own = F.substr(piece, F.lit(len(START) + 1))
        line = F.instr(own, "\n")
        return F.struct(unescape(F.substr(own, F.lit(1), line - 1)).alias("role"), unescape(F.substr(own, line + 1)).alias("text"))

    under_mask = F.transform("spans", lambda s: unescape(F.substr(F.get("pieces", s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"])))
    return rows.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(under_mask, "").alias("loss_text"), "formatted")
