"""Running values and point-in-time joins whose tasks don't grow with a key.

Rows are dealt to blocks by ranges of the order, cut at quantiles of all rows, so that a key with a large share of
the rows, or no key at all, is many tasks. A block's partial value comes from an aggregate, the values before each block
from a window over one row a key and block, and only then do windows run within the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import fresh_names

#: By kind: the aggregate of a block, and how a value before the block and one within it combine.
KINDS = {
    "sum": (F.sum, lambda before, own: before + own),
    "count": (F.count, lambda before, own: before + own),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "product": (F.product, lambda before, own: before * own),
}


def cut_points(df: DataFrame, order: str, blocks: int, accuracy: int = 10_000) -> list:
    """Up to ``blocks - 1`` ascending values that cut the rows into ranges of about the same size: bounded, whatever the rows."""
    if blocks < 2:
        return []
    kind = df.schema[order].dataType.simpleString()
    number = F.col(order)
    if kind in ("timestamp", "timestamp_ntz"):
        number = F.unix_micros(F.col(order).cast("timestamp"))
    elif kind == "date":
        number = F.unix_date(order)
    marks = df.agg(F.percentile_approx(number, [k / blocks for k in range(1, blocks)], accuracy)).first()[0]
    return sorted(set(marks or []))


def block_of(df: DataFrame, order: str, marks: Sequence) -> Column:
    """How many cut points a row's place reaches; rows of one place share a block, and a null place comes first."""
    kind = df.schema[order].dataType.simpleString()
    number = F.col(order)
    if kind in ("timestamp", "timestamp_ntz"):
        number = F.unix_micros(F.col(order).cast("timestamp"))
    elif kind == "date":
        number = F.unix_date(order)
    if not marks:
        return F.lit(0)
    cuts = F.array(*[F.lit(m) for m in marks])
    return F.coalesce(F.when(number.isNotNull(), F.size(F.filter(cuts, lambda m: m <= number))), F.lit(0))


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{x}`").eqNullSafe(F.col(f"`{y}`")) for x, y in zip(left, right, strict=True)], F.lit(True))


def running(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, str]], *, tie_break: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """Running values from a key's first row to each row: ``values`` maps a new column to (kind, column).

    Kinds are sum, count, min, max and product; nulls are passed over, as windows do. ``order`` is a number, date or
    timestamp, and rows that are equal in it and ``tie_break`` come in no fixed order, so name enough columns.
    Without keys all rows are one series. Null keys are a key, null places come first. Equal to a window over
    the whole series but for the rounding of doubles.
    """
    for kind, _ in values.values():
        if kind not in KINDS:
            raise ValueError(f"no such running value: {kind}")
    block, *rest = fresh_names([*df.columns, *values], "block", *[f"k{i}" for i in range(len(keys))], "b", *[f"p{i}" for i in range(len(values))])
    names, at, parts = rest[: len(keys)], rest[len(keys)], rest[len(keys) + 1 :]
    placed = df.withColumn(block, block_of(df, order, cut_points(df, order, blocks)))
    partial = [KINDS[kind][0](F.col(f"`{c}`")).alias(p) for (kind, c), p in zip(values.values(), parts, strict=True)]
    own = placed.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(block).alias(at)).agg(*partial)
    # a row a key and block: at most as many as there are blocks for each key
    earlier = Window.partitionBy(*names).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"count": F.sum}
    before = own.select(*names, at, *[fold.get(kind, KINDS[kind][0])(p).over(earlier).alias(p) for (kind, _), p in zip(values.values(), parts, strict=True)])
    met = placed.join(before, _equal([*keys, block], [*names, at]))
    so_far = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], block).orderBy(F.asc_nulls_first(order), *tie_break).rowsBetween(Window.unboundedPreceding, 0)
    out = met
    for (name, (kind, c)), p in zip(values.items(), parts, strict=True):
        within, both = KINDS[kind][0](F.col(f"`{c}`")).over(so_far), KINDS[kind][1]
        if kind in ("min", "max"):
            whole = both(F.col(p), within)  # least and greatest pass over nulls
        else:
            whole = F.when(F.col(p).isNull(), within).when(within.isNull(), F.col(p)).otherwise(both(F.col(p), within))
        out = out.withColumn(name, whole)
    return out.drop(block, at, *names, *parts)


def numbered(df: DataFrame, order: str, name: str, *, keys: Sequence[str] = (), tie_break: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """Row numbers from 1 along an order, over all rows or each key's."""
    one = fresh_names(df.columns, "one")[0]
    return running(df.withColumn(one, F.lit(1)), keys, order, {name: ("count", one)}, tie_break=tie_break, blocks=blocks).drop(one)


def drawdowns(df: DataFrame, keys: Sequence[str], order: str, growth: str, *, equity: str = "equity", drawdown: str = "drawdown", tie_break: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """The running product of a growth factor, and its distance from its running maximum."""
    grown = running(df, keys, order, {equity: ("product", growth)}, tie_break=tie_break, blocks=blocks)
    peak = fresh_names([*grown.columns, drawdown], "peak")[0]
    out = running(grown, keys, order, {peak: ("max", equity)}, tie_break=tie_break, blocks=blocks)
    return out.withColumn(drawdown, F.col(equity) / F.col(peak) - 1).drop(peak)


def as_of_join(
    facts: DataFrame, history: DataFrame, key: str, at: str, *, how: str = "left", start: str = "__START_AT", end: str = "__END_AT", blocks: int = 64
) -> DataFrame:
    """Each fact with the version of its key that held at its time: start <= at, and at < end or no end.

    ``key`` and the time ``at`` are columns of the facts; the history has the key under the same name, and versions of
    a key don't overlap. Facts and versions are one series a key and block of time, in which the last version is
    carried forward; what holds at a block's beginning is carried over from the blocks before. No range is
    joined, and a key with most of the facts is as many tasks as there are blocks. A fact without a version,
    key or time has nulls, or goes with ``how="inner"``. Of versions that start together the one that ends
    last holds. Columns of the history that a fact's columns clash with are to be renamed before.
    """
    if how not in ("left", "inner"):
        raise ValueError("left or inner")
    payload = [c for c in history.columns if c != key]
    clash = {c.lower() for c in payload} & {c.lower() for c in facts.columns}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    version, fact, time, block, is_fact, held = fresh_names([*facts.columns, *history.columns], "version", "fact", "time", "block", "is_fact", "held")
    kind = facts.schema[at].dataType
    versions = history.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key), F.col(start).cast(kind).alias(time), F.struct(*payload).alias(version))
    mine = facts.select(F.col(key), F.col(at).alias(time), F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias(fact))
    both = versions.select(key, time, version, F.lit(None).cast(mine.schema[fact].dataType).alias(fact), F.lit(0).alias(is_fact)).unionByName(
        mine.select(key, time, F.lit(None).cast(versions.schema[version].dataType).alias(version), fact, F.lit(1).alias(is_fact))
    )
    marks = cut_points(mine, time, blocks)
    placed = both.withColumn(block, block_of(both, time, marks))
    ended = lambda v: F.coalesce(F.col(v)[end].cast(kind), F.lit(None).cast(kind))
    # the last version of each key and block, and from it the one that holds where a block begins
    last = placed.filter(F.col(is_fact) == 0).groupBy(key, block).agg(F.max_by(version, F.struct(time, ended(version).isNull(), ended(version))).alias(held))
    known = placed.select(key, block).distinct().join(last, [key, block], "left")
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select(F.col(key).alias("__key_"), F.col(block).alias("__block_"), F.last(held, ignorenulls=True).over(earlier).alias(held))
    met = placed.join(carried, F.col(key).eqNullSafe(F.col("__key_")) & (F.col(block) == F.col("__block_"))).drop("__key_", "__block_")
    so_far = Window.partitionBy(key, block).orderBy(F.asc_nulls_first(time), is_fact, ended(version).isNull(), ended(version)).rowsBetween(Window.unboundedPreceding, 0)
    found = met.withColumn(held, F.coalesce(F.last(version, ignorenulls=True).over(so_far), F.col(held))).filter(F.col(is_fact) == 1)
    holds = F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(held).isNotNull() & (ended(held).isNull() | (F.col(time) < ended(held)))
    out = found.select(f"{fact}.*", *[F.when(holds, F.col(held)[c]).alias(c) for c in payload], F.coalesce(holds, F.lit(False)).alias(version))
    return (out.filter(version) if how == "inner" else out).drop(version)


def suggested_blocks(n_rows: int, rows: int = 5_000_000) -> int:
    """Blocks of about so many rows."""
    return max(1, math.ceil(n_rows / rows))
