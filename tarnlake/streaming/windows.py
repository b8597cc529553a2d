"""Windows, dedup and joins that are the same for batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def _windowed(df: DataFrame, window: Column, ts: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: str | None) -> DataFrame:
    out = _marked(df, ts, delay).groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: str | None = None) -> DataFrame:
    return _windowed(df, F.window(ts, size), ts, keys, aggs, delay)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: str | None = None) -> DataFrame:
    return _windowed(df, F.window(ts, size, slide), ts, keys, aggs, delay)


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: str | None = None) -> DataFrame:
    """Windows that a gap without events closes."""
    return _windowed(df, F.session_window(ts, gap), ts, keys, aggs, delay)


def running_totals(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """An aggregate without windows, for update and complete mode."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def late_rows(df: DataFrame, ts: str, delay: str, batch: Column) -> DataFrame:
    """Rows that a watermark would drop, where ``batch`` orders the micro-batches: those older than the
    latest time of all earlier batches less the delay."""
    per = df.groupBy(batch.alias("__b")).agg(F.max(ts).alias("__m"))
    from pyspark.sql import Window

    seen = per.withColumn("__mark", F.max("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))  # a row a batch
    met = df.withColumn("__b", batch).join(seen.select("__b", "__mark"), "__b")
    return met.filter(F.col(ts) < F.col("__mark") - F.expr(f"INTERVAL {delay}")).drop("__b", "__mark")


def dedup_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One row for each key; state goes when the watermark has passed."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def enrich(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """A stream, or table, with a static dimension; unmatched rows stay."""
    return df.join(dim, key, "left")


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, within: str, *, how: str = "inner", delays: tuple[str, str] = ("10 minutes", "10 minutes")) -> DataFrame:
    """rt within [lt, lt + within] for equal keys; watermarks on both sides bound the state.

    With ``leftOuter`` a left row without partner comes out, flagged, once none can come any more.
    """
    a, b = _marked(left, lt, delays[0]), _marked(right.withColumnRenamed(key, "__key"), rt, delays[1])
    cond = (F.col(key) == F.col("__key")) & (F.col(rt) >= F.col(lt)) & (F.col(rt) <= F.col(lt) + F.expr(f"INTERVAL {within}"))
    out = a.join(b, cond, how).drop("__key")
    return out.withColumn("converted", F.col(rt).isNotNull()) if how != "inner" else out
