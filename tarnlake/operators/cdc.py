"""Current rows of a change feed, kept up batch by batch (SCD type 1).

The state of a table is itself a table: for each key its last event, deletes included, and one row for the last
truncate. Everything in it is a maximum by sequence, so a state and a batch merge by one aggregate with partial
maxima, and any split of the events into batches, in any order, gives the state that one pass gives.
A delete stays in the state as a tombstone, so that an event that comes late never revives its key; ``forget``
drops tombstones once no event that old can come any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import content_hash

#: Columns of a state besides the keys: whether the row stands for a truncate, the last event's place in the
#: sequence, whether it deletes, the last delete's place, and the columns' values with their places.
MARK, ORDER, GONE, DELETED, VALUES = "__mark", "__order", "__gone", "__deleted", "__values"


def _expr(x: Column | str | None) -> Column:
    if x is None:
        return F.lit(False)
    return F.coalesce(F.expr(x) if isinstance(x, str) else x, F.lit(False))


def _payload(events: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in events.columns if c not in keys]


def fold_changes(
    events: DataFrame,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    *,
    deletes: Column | str | None = None,
    truncates: Column | str | None = None,
    ignore_nulls: bool = False,
    state: DataFrame | None = None,
) -> DataFrame:
    """The state after these events, from the state before them.

    ``sequence_by`` names the sequence and its tie-breaks; of equal ones the content decides. A truncate clears
    what its sequence or an earlier one wrote, also what comes in later. With ``ignore_nulls`` a column holds its
    last value that isn't null since the last delete. Null keys are a key like any other. A state goes on only
    with the settings that it was made with.
    """
    payload = _payload(events, keys)
    at, gone = F.struct(F.struct(*sequence_by).alias("s"), content_hash(events).alias("h")), _expr(deletes)
    clears = _expr(truncates)
    if ignore_nulls:
        value = lambda c: F.when(~gone & F.col(f"`{c}`").isNotNull(), F.struct(at.alias("at"), F.col(f"`{c}`").alias("v")))
    else:
        value = lambda c: F.struct(at.alias("at"), F.col(f"`{c}`").alias("v"))
    # dealt out by the sequence, which no key with many events makes uneven: a row with its places is wide, and the
    # partial aggregate sorts all that its task reads
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.repartition(parts, *sequence_by).select(
        *[F.when(~clears, F.col(f"`{k}`")).alias(k) for k in keys],
        clears.alias(MARK),
        at.alias(ORDER),
        gone.alias(GONE),
        F.when(gone & ~clears, at).alias(DELETED),
        F.struct(*[F.when(~clears, value(c)).alias(c) for c in payload]).alias(VALUES),
    )
    if state is not None:
        rows = state.unionByName(rows)
    if ignore_nulls:
        last = lambda c: F.max_by(F.col(VALUES)[c], F.col(VALUES)[c]["at"]).alias(c)
        kept = F.struct(*[last(c) for c in payload])
    else:
        kept = F.max_by(VALUES, ORDER)
    names = [f"__k{i}" for i in range(len(keys))]
    by = rows.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], MARK)
    folded = by.agg(F.max(ORDER).alias(ORDER), F.max_by(GONE, ORDER).alias(GONE), F.max(DELETED).alias(DELETED), kept.alias(VALUES))
    folded = folded.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], MARK, ORDER, GONE, DELETED, VALUES)
    if truncates is None:
        return folded
    clear = folded.filter(MARK).select(F.col(ORDER)["s"].alias("__clear"))
    out = folded.join(F.broadcast(clear), F.lit(True), "left")  # one row at most
    return out.filter(F.col(MARK) | F.col("__clear").isNull() | (F.col(ORDER)["s"] > F.col("__clear"))).drop("__clear")


def current_rows(state: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, except_columns: Sequence[str] = ()) -> DataFrame:
    """The rows that a state holds: keys whose last event is no delete."""
    clear = state.filter(MARK).select(F.col(ORDER)["s"].alias("__clear"))
    rows = state.filter(~F.col(MARK) & ~F.col(GONE)).join(F.broadcast(clear), F.lit(True), "left")  # one row at most
    since = lambda c: (F.col(DELETED).isNull() | (F.col(VALUES)[c]["at"] > F.col(DELETED))) & (F.col("__clear").isNull() | (F.col(VALUES)[c]["at"]["s"] > F.col("__clear")))
    names = [f.name for f in state.schema[VALUES].dataType.fields]
    made = rows.select(*[F.col(f"`{k}`") for k in keys], *[F.when(since(c), F.col(VALUES)[c]["v"]).alias(c) for c in names])
    wanted = [c for c in (columns or made.columns) if c not in except_columns]
    return made.select(*[F.col(f"`{c}`") for c in wanted])


def forget(state: DataFrame, before: Column, sequence: str) -> DataFrame:
    """A state without the tombstones of deletes sequenced before a point, after which no event that old may come."""
    old = F.col(GONE) & ~F.col(MARK) & (F.col(ORDER)["s"][sequence] < before)
    return state.filter(~F.coalesce(old, F.lit(False)))


def same_state(left: DataFrame, right: DataFrame) -> bool:
    """Whether two states hold the same; for tests and audits."""
    flat = lambda df: df.select(content_hash(df).alias("h"))
    sums = [flat(df).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first() for df in (left, right)]
    return reduce(lambda a, b: a == b, sums)
