"""Chat formatting: conversations as one stream of marked turns, an example for each reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.scratch import Scratch

# Marks of the template.
ROLE, TEXT, END = "<|role|>", "<|text|>", "</s>"
#: Strings that steer a model or this template, and how they are written inside texts.
#: A backslash is doubled first; then each string gets one behind its first character.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TRAINED_ROLE = "assistant"
#: Turn numbers of one block, which one task lays out.
BLOCK_TURNS = 256


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """The stream of every conversation, one row for each turn.

    ``conversations(conv_id, turn, role, text)`` gives conv_id, block, seq (from 0), formatted,
    start and end (characters of the stream, end exclusive) and trained (the role is
    ``assistant``). Turns are ordered by turn, role, text, nulls first; rows that repeat are
    turns of their own. Null roles and texts are empty, a null conv_id is a conversation. An
    empty table gives an empty table. A conversation is laid out in blocks of turn numbers:
    a window runs inside a block, and one row per block carries what lies before it.
    """
    shape = F.concat(F.lit(ROLE), escaped(_blank("role")), F.lit(TEXT), escaped(_blank("text")), F.lit(END))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("long")
    rows = conversations.select(
        "conv_id", "turn", "role", "text", block.alias("block"), shape.alias("formatted"),
        (_blank("role") == TRAINED_ROLE).alias("trained"),
    )
    size = F.length("formatted").cast("long")
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    offset = F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("offset")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), first, offset)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    end = F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", F.row_number().over(inside) - 1).withColumn("reach", end)
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    stop = F.col("offset") + F.col("reach")
    return joined.select(
        "conv_id", "block", (F.col("first") + F.col("place")).alias("seq"), "formatted",
        (stop - size).alias("start"), stop.alias("end"), "trained",
    )


def role_of(formatted: Column) -> Column:
    """The role, read back from a formatted turn."""
    return unescaped(F.substr(F.split_part(formatted, F.lit(TEXT), F.lit(1)), F.lit(len(ROLE) + 1)))


def text_of(formatted: Column) -> Column:
    """The text, read back from a formatted turn."""
    marked = F.split_part(formatted, F.lit(TEXT), F.lit(2))
    return unescaped(F.left(marked, F.length(marked) - len(END)))


def replies(turns: DataFrame) -> DataFrame:
    """One row for each trained turn of ``formatted_turns``, which becomes an example.

    The context is the stream before the turn, ``context_chars`` long and ``context_turns``
    turns. ``reply`` is the formatted turn; the loss mask covers the characters of context
    and reply from ``loss_start`` to ``loss_end``, which is exclusive.
    """
    text_at = F.length(F.split_part("formatted", F.lit(TEXT), F.lit(1))) + len(TEXT)
    return turns.where("trained").select(
        "conv_id", "block", "seq", F.col("seq").alias("context_turns"), F.col("start").alias("context_chars"),
        F.col("formatted").alias("reply"), (F.col("start") + text_at).alias("loss_start"),
        (F.col("end") - len(END)).alias("loss_end"),
    )


def examples(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, block, seq, example, loss_start, loss_end)``: every trained turn with its context.

    All contexts of a conversation are prefixes of its stream, so the stream is joined once to
    the narrow rows of its replies, and each row cuts its example from it: what is shuffled
    grows with the turns, while the examples, which together grow with the square of a
    conversation's turns, exist one at a time in the task that reads them. The streams are
    written first, so that Spark splits the replies of a long conversation.
    """
    streams = in_order(turns, F.col("formatted")).select(F.col("conv_id").alias("c"), "joined")
    streams = scratch.table(streams, "streams")
    narrow = replies(turns).select(
        "conv_id", "block", "seq", (F.col("context_chars") + F.length("reply")).alias("size"), "loss_start", "loss_end"
    )
    joined = narrow.join(streams, F.col("conv_id").eqNullSafe(F.col("c")))
    example = F.left("joined", F.col("size").cast("int")).alias("example")
    return joined.select("conv_id", "block", "seq", example, "loss_start", "loss_end")


def under_mask(example: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text that an example's loss mask covers, unescaped."""
    return unescaped(F.substr(example, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))


def turns_in(example: Column) -> Column:
    """How many turns an example holds; no text holds the mark that ends them."""
    without = F.length(F.replace(example, F.lit(END), F.lit("")))
    return ((F.length(example) - without) / len(END)).cast("long")


def in_order(rows: DataFrame, text: Column) -> DataFrame:
    """``(conv_id, joined)``: the texts of a conversation's rows in order of seq.

    Blocks are joined first, so what is sorted per conversation are a few long strings.
    """
    parts = F.sort_array(F.collect_list(F.struct("seq", text.alias("t"))))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_join(parts["t"], "").alias("t"))
    whole = F.sort_array(F.collect_list(F.struct("block", "t")))
    return blocks.groupBy("conv_id").agg(F.array_join(whole["t"], "").alias("joined"))


def oracle(extra: str) -> str:
    """DuckDB SQL for the digests of ``conversations`` and the rows of ``extra``."""
    def esc(column: str) -> str:
        sql = f"replace({column}, '\\', '\\\\')"
        for control in CONTROL:
            sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
        return sql

    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
f AS (SELECT *, CAST(length('{ROLE}' || {esc("role")} || '{TEXT}' || {esc("text")} || '{END}') AS BIGINT) AS size FROM c),
w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id {order} ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id {order}) - 1 AS before FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = '{TRAINED_ROLE}') AS n_examples,
  CAST(coalesce(sum(upto) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS example_chars,
  CAST(coalesce(sum(before) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS context_turns
FROM w GROUP BY conv_id"""
