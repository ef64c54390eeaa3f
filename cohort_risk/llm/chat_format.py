"""Chat formatting [native] by prefix-target expansion: every assistant turn
becomes its own example whose context is all that precedes it and whose only
trainable text is that reply.

Template of a turn: ``### <role>: <text></turn>`` and a newline. Inside texts
``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h`` (in roles also
``:`` to ``\\c``), so no control string can occur in a text and the escape is
undone exactly.

A conversation is formatted once; an example refers to it by the length of its
context and the span of its target, and ``with_context=True`` cuts the context
out as text. So the work grows with the turns, not with their square, until
the contexts themselves are asked for. One exchange on the conversation id
serves the running offsets, the assembly, the expansion and the digest.

Defined results: null role or text is empty; turns with equal numbers are
ordered by role, then text (repeated rows are repeated turns); null turn
numbers come first; rows with a null conversation id form one conversation; a
conversation without assistant turn has no example. One conversation must fit
a row (under 2 GB)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``targets``
    (array of start, length in code points of the escaped reply texts)."""
    turns = df.select(
        F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
    )
    turns = turns.select(
        "__conv", "__turn", "__role", "__text",
        F.concat(F.lit(HEAD), escape(F.col("__role"), ROLE_ESCAPES), F.lit(SEP)).alias("__head"),
        escape(F.col("__text")).alias("__body"),
    )
    order = Window.partitionBy("__conv").orderBy("__turn", "__role", "__text")
    size = F.length("__head") + F.length("__body") + len(END)
    placed = turns.select(
        "__conv", F.row_number().over(order).alias("__seq"), F.col("__role") == target_role,
        F.concat("__head", "__body", F.lit(END)).alias("__piece"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - F.length("__body")).alias("__start"),
        F.length("__body").alias("__length"),
    ).toDF("__conv", "__seq", "__target", "__piece", "__start", "__length")
    pieces = F.sort_array(F.collect_list(F.struct("__seq", "__piece")))
    spans = F.sort_array(F.collect_list(F.when(F.col("__target"), F.struct(F.col("__start").alias("start"), F.col("__length").alias("length")))))
    return placed.groupBy("__conv").agg(
        F.array_join(F.transform(pieces, lambda p: p["__piece"]), "").alias("formatted"), spans.alias("targets")
    ).withColumnRenamed("__conv", conv_col)


def expand_examples(chats: DataFrame, keep_empty: bool = False, with_context: bool = True) -> DataFrame:
    """One row per target: the other columns of ``chats``, ``example`` (0, 1, ...),
    ``context_chars``, ``context`` (on request) and ``target``, still escaped.
    ``keep_empty`` keeps a conversation without target as one row of nulls."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = chats.select("*", explode("targets").alias("example", "__span"))
    cut = [F.col("__span.start").alias("context_chars"), F.expr("substring(formatted, cast(__span.start as int) + 1, __span.length)").alias("target")]
    if with_context:
        cut.append(F.expr("substring(formatted, 1, cast(__span.start as int))").alias("context"))
    return rows.select(*[f"`{c}`" for c in chats.columns if c not in ("targets", "formatted")], "formatted", "example", *cut).drop("formatted")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), SEP, 1)
        text = F.substr(p, F.lit(len(HEAD) + len(SEP) + 1) + F.length(role))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)
