"""Chat formatting: render conversations, parse the rendering again, escape what does not come back.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings all begin with ``<|``. The escape
puts a backslash into every ``<|``, ``<\\|``, ``<\\\\|`` ... of a text, and the parser takes one out again, so an
escaped text never holds ``<|``, and escaping is one to one. A turn is escaped only where the plain rendering
of its conversation does not parse back to the turns it came from; the escaped rendering is parsed and compared in its turn, and a
difference, which the escape leaves no room for, ends the job instead of passing wrong text on.

Only SQL expressions; one shuffle, by conversation, of which a single row is made.
Nulls: text and role count as empty, a null turn sorts first, rows with a null conv_id make one conversation.
Ties in ``turn`` are ordered by role, then text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: ``<|`` with any number of backslashes between; $1 holds them
_CONFLICT = r"<(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONFLICT, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """A role stands on one line: newlines are written ``\\n`` and backslashes are doubled before the common escape."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _escaped(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(_escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a rendering: split at the start marks, then at the first newline; the first end mark closes a turn."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turn(b: Column) -> Column:
        at = F.instr(b, F.lit("\n"))
        return F.struct(
            _unescape_role(F.substring_index(F.substring(b, F.lit(1), at - 1), END, 1)).alias("role"),
            unescape(F.substring_index(F.substring(b, at + 1, F.length(b)), END, 1)).alias("text"),
        )

    return F.transform(blocks, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to ``conv_id, formatted, escaped, parsed, loss_text``.

    ``parsed`` and ``loss_text`` (all assistant texts, in order) are read back from ``formatted``.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    )
    plain = source.withColumn("plain", _render(F.col("turns")))
    kept = parse(F.col("plain")) == F.col("turns")
    out = plain.withColumn("escaped", ~kept).withColumn("formatted", F.when(F.col("escaped"), _render(_escaped(F.col("turns")))).otherwise(F.col("plain")))
    again = out.withColumn("parsed", parse(F.col("formatted")))
    out = again.withColumn("parsed", F.when(F.col("parsed") == F.col("turns"), F.col("parsed")).otherwise(F.raise_error(F.lit("a rendering does not parse back to its turns"))))
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select("conv_id", "formatted", "escaped", "parsed", loss.alias("loss_text"))
