"""Conversations as one marked text each, with a loss mask, by Spark expressions only.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Adjacent turns
of one role share the marks, with ``<|im_sep|>`` between their texts.  Inside
roles and texts ``\\`` becomes ``\\\\``, ``<|`` becomes ``<\\|`` and, in roles, a
line feed becomes ``\\n``; so marks never occur in them, and reading back is
exact.  The mask lists the spans of assistant texts in code points.

Turns are ordered by turn number (NULL first), then role, then text.  NULL
roles and texts count as empty; rows without ``conv_id`` form one
conversation; repeated rows are turns of their own.  A conversation is one row
of the output and must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Characters of a part of a text that is read by its mask.
PART = 1024


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped`` and of ``escaped_role``.

    Between doubled backslashes a single one starts an escape.
    """
    pieces = F.transform(
        F.split(text, r"\\\\"),
        lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(pieces, "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``; ``loss`` holds ``(start, chars)`` of each assistant text.

    Marks and ends of the pieces come from one pass over the sorted turns, so the work
    grows with their number and not its square.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        escaped_role(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    # What stands before each text: marks for the first of a role, a separator for those merged into it.
    opening = F.concat(
        F.when(before.isNull(), "").otherwise(END), F.lit(START), F.col("role"), F.lit("\n")
    )
    mark = F.when(before == F.col("role"), SEPARATOR).otherwise(opening)
    piece = rows.withColumn("_mark", mark).select(
        "conv_id", "turn", "role", "text",
        F.concat("_mark", "text").alias("piece"),
        F.length("text").cast("long").alias("chars"),
        (F.col("role") == LEARNED).alias("learned"),
    )
    upto = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = piece.withColumn("end", upto)
    # A piece is never empty, so its end tells its place.
    chats = ended.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("end", "piece", "chars", "learned"))).alias("_pieces")
    )
    return chats.select(
        "conv_id",
        F.concat(F.array_join(F.transform("_pieces", lambda p: p["piece"]), ""), F.lit(END)).alias("formatted"),
        F.transform(
            F.filter("_pieces", lambda p: p["learned"]),
            lambda p: F.struct((p["end"] - p["chars"]).alias("start"), p["chars"].alias("chars")),
        ).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, learned)`` read back from ``formatted`` and ``loss`` alone.

    ``turns`` holds ``(role, text)`` in order, ``learned`` the texts under the
    mask; both unescaped.
    """
    quoted = "".join("\\" + x if x in "|" else x for x in END.rstrip("\n"))
    blocks = F.filter(F.split("formatted", quoted + "\n"), lambda x: x != "")
    opened = formatted.withColumn("_blocks", F.transform(blocks, lambda x: F.substr(x, F.lit(len(START) + 1))))
    turn = lambda role: lambda text: F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
    turns = F.flatten(
        F.transform(
            "_blocks",
            lambda x: F.transform(
                F.split(F.substr(x, F.locate("\n", x) + 1), SEPARATOR.replace("|", "\\|")),
                turn(F.substring_index(x, "\n", 1)),
            ),
        )
    )
    # Finding the nth character of a long text means counting from its start; in parts of
    # ``PART`` characters only from the part's.  A transform over one element evaluates them once.
    learned = F.expr(
        f"""transform(array(regexp_extract_all(formatted, '(?s).{{1,{PART}}}', 0)), parts -> transform(loss, x ->
            substring(array_join(slice(parts, CAST(x.start DIV {PART} AS int) + 1,
                                       CAST((x.start + x.chars) DIV {PART} - x.start DIV {PART} AS int) + 1), ''),
                      CAST(x.start % {PART} AS int) + 1, CAST(x.chars AS int))))[0]"""
    )
    learned = F.transform(learned, unescaped)
    return opened.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
