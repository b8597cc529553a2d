"""Chat formatting after cumulative-snapshot collapse; DataFrame functions only.

Loggers write a conversation again whenever it grows, so most logs are prefixes of longer ones. Each
turn is hashed with its number, role and text; the running sum of these hashes is the rolling hash of
the prefix that ends there. A conversation whose whole hash is a shorter prefix of another one goes
(anti-join on distinct prefix hashes); of equal ones the smallest id stays. The rest is rendered.

Rows are numbered, and their hashes summed, in three steps: by blocks of ``block`` turns, within a
block by turn and the beginning of the hash, and within such a cell row by row. So neither a very long
conversation nor one in which millions of rows share a turn, or have none, stands in one task as a
whole; it is rendered in parts of ``block`` rows each, one for usual lengths. Conversations that many
logs share meet as pre-aggregated hashes, never as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KEY = ["n", "a", "b", "c"]


def _halves(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def render_turn(role: Column, text: Column) -> Column:
    """One turn as training text; a null role is written as unknown, a null text as empty.

    ``<|im_start|>`` and ``<|im_end|>`` within a role or text get a space after the bar, so that no
    turn can begin or end another one.
    """
    plain = lambda x: F.replace(F.replace(x, F.lit("<|im_start|>"), F.lit("<| im_start|>")), F.lit("<|im_end|>"), F.lit("<| im_end|>"))
    return F.concat(F.lit("<|im_start|>"), plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), plain(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def numbered(turns: DataFrame, *, block: int = 256) -> DataFrame:
    """Distinct rows with their number ``n`` in the conversation, from 1, its length ``whole`` and running hash sums a, b, c."""
    h, g = F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit("second"), "text", "turn", "role")
    (a, b), (c, _) = _halves(h), _halves(g)
    cut = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(0)) / block)
    own = turns.select("conv_id", "turn", "role", "text").distinct().select("*", cut.alias("block"), a.alias("a"), b.alias("b"), c.alias("c"))
    own = common.materialize(own.withColumn("cell", F.shiftright("a", 16)), "turns")
    cells = own.groupBy("conv_id", "block", "turn", "cell").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in "abc"])
    cells = common.materialize(cells, "turn-cells")
    blocks = cells.groupBy("conv_id", "block").agg(*[F.sum(x).alias(x) for x in KEY])
    every = Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", *[_earlier(x, every.orderBy("block")).alias(f"{x}0") for x in KEY], F.sum("n").over(every).alias("whole"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "cell")
    inner = cells.select("conv_id", "block", "turn", "cell", *[_earlier(x, within).alias(f"{x}1") for x in KEY])
    inner = _met(inner, blocks, "conv_id", "block").select("conv_id", "block", "turn", "cell", "whole", *[(F.col(f"{x}0") + F.col(f"{x}1")).alias(f"{x}0") for x in KEY])
    inner = common.materialize(inner, "turn-offsets")
    order = Window.partitionBy("conv_id", "block", "turn", "cell").orderBy("a", "b", "c").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.select("conv_id", "block", "turn", "cell", "role", "text", F.count("*").over(order).alias("n1"), *[F.sum(x).over(order).alias(f"{x}1") for x in "abc"])
    return _met(rows, inner, "conv_id", "block", "turn", "cell").select("conv_id", "turn", "role", "text", "whole", *[(F.col(f"{x}0") + F.col(f"{x}1")).alias(x) for x in KEY])


def _earlier(x: str, over: Window) -> Column:
    return F.coalesce(F.sum(x).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Equal keys, null ones too; the left side's names."""
    right = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    met = [left[k].eqNullSafe(right[f"other_{k}"]) for k in keys]
    return left.join(right, met).drop(*[f"other_{k}" for k in keys])


def maximal(rows: DataFrame) -> DataFrame:
    """Conversations of ``numbered`` rows that no longer one continues: conv_id, n turns, copies (logs with equal turns)."""
    prefixes = rows.filter("n < whole").select(*KEY).distinct()
    equal = rows.filter("n = whole").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return equal.join(prefixes, KEY, "left_anti").select("conv_id", "n", "copies")


def format_chats(turns: DataFrame, *, block: int = 256) -> DataFrame:
    """Rendered text of maximal conversations: conv_id, part, n_turns in the part, copies, text.

    ``turns`` has conv_id, turn, role, text. Fully repeated rows count once; rows without conv_id make
    up one conversation; turns may start anywhere, be null or have gaps; ties are ordered by content.
    Conversations of up to ``block`` rows have one part; parts join end to end in their order. Other
    columns are left out. An empty table gives no rows.
    """
    rows = common.materialize(numbered(turns, block=block), "numbered-turns")
    kept = common.materialize(maximal(rows), "maximal").select(F.col("conv_id").alias("conv_id"), "copies")
    rows = _met(rows, kept, "conv_id").withColumn("part", F.floor((F.col("n") - 1) / block))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    parts = rows.groupBy("conv_id", "part", "copies").agg(F.count("*").alias("n_turns"), lines.alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("lines", lambda x: render_turn(x["role"], x["text"])), "").alias("text"))
