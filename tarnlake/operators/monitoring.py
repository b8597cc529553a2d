"""Run logs, alerts, and metrics from pipeline event logs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "stage string, rows_in long, rows_out long, rows_quarantined long, seconds double, status string, run_ts timestamp"
DETAILS = "struct<flow_progress:struct<metrics:struct<num_output_rows:bigint>,data_quality:struct<dropped_records:bigint,expectations:array<struct<name:string,passed_records:bigint,failed_records:bigint>>>>>"


def log_run(spark: SparkSession, path: str, stage: str, *, rows_in: int = 0, rows_out: int = 0, rows_quarantined: int = 0, seconds: float = 0.0, status: str = "ok") -> None:
    """Append one row to the run log."""
    row = spark.range(1).select(
        F.lit(stage).alias("stage"),
        *[F.lit(int(v)).cast("long").alias(k) for k, v in (("rows_in", rows_in), ("rows_out", rows_out), ("rows_quarantined", rows_quarantined))],
        F.lit(float(seconds)).alias("seconds"),
        F.lit(status).alias("status"),
        F.current_timestamp().alias("run_ts"),
    )
    row.write.mode("append").parquet(path)


@contextmanager
def timed_stage(spark: SparkSession, path: str, stage: str) -> Iterator[dict]:
    """Log a stage with its time; the body fills in counts. A failure is logged, then raised."""
    counts: dict = {}
    began = time.monotonic()
    try:
        yield counts
    except BaseException:
        log_run(spark, path, stage, seconds=time.monotonic() - began, status="failed", **counts)
        raise
    log_run(spark, path, stage, seconds=time.monotonic() - began, **counts)


def alerts(rates: DataFrame, limit: float = 5.0, rate: str = "rate_pct") -> DataFrame:
    """Rows above the limit, with a message."""
    return rates.filter(F.col(rate) > limit).withColumn("alert", F.concat(F.lit(f"{rate} above {limit}: "), F.col(rate).cast("string")))


def volume_drop(df: DataFrame, ts: str, pct: float = 20.0) -> DataFrame:
    """Days with over ``pct`` per cent fewer rows than the day before that has any."""
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))  # a row a day
    return daily.withColumn("n_before", before).withColumn("drop_pct", F.round((1 - F.col("n") / F.col("n_before")) * 100, 4)).filter(F.col("drop_pct") > pct)


def stale(df: DataFrame, ts: str, now: Column, minutes: int) -> DataFrame:
    """The newest time and whether it lies more than so many minutes back; no rows are stale."""
    newest = df.agg(F.max(ts).alias("newest"))
    return newest.withColumn("is_stale", F.coalesce(F.col("newest") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"), F.lit(True)))


def expectation_metrics(log: DataFrame) -> DataFrame:
    """Expectations with failures, from an event log's JSON details."""
    read = F.from_json("details", DETAILS)
    each = log.filter(F.col("event_type") == "flow_progress").select("timestamp", "flow_name", F.explode(read["flow_progress"]["data_quality"]["expectations"]).alias("e"))
    return each.select("timestamp", "flow_name", "e.*").filter("failed_records > 0")


def flow_metrics(log: DataFrame) -> DataFrame:
    """Rows put out and dropped by flow and day."""
    number = lambda path: F.coalesce(F.get_json_object("details", path).try_cast("long"), F.lit(0).cast("long"))
    own = log.filter(F.col("event_type") == "flow_progress")
    return own.groupBy("flow_name", F.to_date("timestamp").alias("day")).agg(
        F.sum(number("$.flow_progress.metrics.num_output_rows")).alias("output_rows"),
        F.sum(number("$.flow_progress.data_quality.dropped_records")).alias("dropped_rows"),
    )


def slowest(log: DataFrame, now: Column, hours: int, k: int = 10, *, ts: str = "run_ts", seconds: str = "seconds") -> DataFrame:
    return log.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(hours)} HOURS")).orderBy(F.desc(seconds), ts).limit(k)
