"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    r"""No "<|" is left: a backslash becomes \s, "<|" becomes <\p, a line feed \n where asked for."""
    return _replace(_replace(c, "\\", "\\s"), "<|", "<\\p")


def unescape(c: Column) -> Column:
    return _replace(_replace(c, "\\p", "|"), "\\s", "\\")


def _escape_role(c: Column) -> Column:
    return _replace(escape(c), "\n", "\\n")


def _unescape_role(c: Column) -> Column:
    return unescape(_replace(c, "\\n", "\n"))


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One training example for every assistant turn: all turns before it as context, only its text trainable.

    Returns conv_id, example (from 0), formatted (the template's text), loss_start
    and loss_length (in code points: the trainable span), whole (it holds all
    turns of its conversation). Turns that no assistant turn follows, and
    conversations without one, come as a last example without a trainable span,
    so no row is lost. Rows go by turn, then role and text, nulls first; null
    texts and roles are empty; a null conversation id is one conversation;
    repeated rows are turns of their own; other columns are not read; an empty
    table gives an empty one. An example is one row, and one task makes all of a
    conversation, so a conversation must fit in a row, some hundred MB at most;
    n replies make n prefixes, about n / 2 times its text.
    """
    body = escape(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(OPEN), _escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
            head.alias("head"), body.alias("body"),
            F.coalesce(F.col(role) == "assistant", F.lit(False)).alias("reply"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    last = F.size("ts") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("ts", i + 1)["reply"] | (i == last))
    examples = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(f"{CLOSE}\n"))).alias("pieces"),
        F.transform("ts", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["reply"].alias("reply"))).alias("sizes"),
        F.posexplode(ends).alias("example", "end"),
    )
    size = F.element_at("sizes", F.col("end") + 1)
    formatted = examples.select(
        "conv_id", "example",
        F.array_join(F.slice("pieces", F.lit(1), F.col("end") + 1), "").alias("formatted"),
        F.when(size["reply"], size["body"]).otherwise(0).alias("loss_length"),
        size["body"].alias("body"), size["reply"].alias("reply"),
        (F.col("end") + 1 == F.size("pieces")).alias("whole"),
    )
    before_close = F.length("formatted") - (len(CLOSE) + 1)
    return formatted.select(
        "conv_id", "example", "formatted",
        F.when(F.col("reply"), before_close - F.col("body")).otherwise(F.length("formatted")).alias("loss_start"),
        "loss_length", "whole",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE.replace("|", "\\|") + "\n", -1)
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(inner, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
    ))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what the examples say when read back."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    turns = F.when(F.col("whole"), read_turns(F.col("formatted")))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select(
        "conv_id", F.size(turns).alias("n"), F.sha2(told, 256).alias("turns"),
        F.struct("example", loss.alias("loss")).alias("loss"), F.length("formatted").cast("long").alias("chars"), "whole",
    )
    every = F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "")
    return rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).cast("long").alias("n_turns"),
        F.max("turns").alias("turns_sha256"),
        F.length(every).cast("long").alias("loss_chars"),
        F.sha2(every, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )
