"""What streams write to, exactly once, and what they report."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import cdc, changes
from ..sources.ingest import once_per_batch, read_or_none

TRIGGERS = {"processingTime", "availableNow", "once", "continuous"}


def trigger(writer: DataStreamWriter, kind: str | None = None, interval: str | None = None) -> DataStreamWriter:
    """The default trigger, or one by name: processingTime and continuous take an interval."""
    if kind is None:
        return writer
    if kind not in TRIGGERS:
        raise ValueError(f"no such trigger: {kind}")
    return writer.trigger(**{kind: interval if kind in ("processingTime", "continuous") else True})


def rate_stream(spark: SparkSession, rows_per_second: int = 10, partitions: int = 1) -> DataFrame:
    """A stream of (timestamp, value) that makes its own rows, to try out a query's sinks and triggers."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", partitions).load()


def stream_table(spark: SparkSession, src: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append what a Parquet table got since the last call to another one, and stop."""
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = transform(rows) if transform else rows
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


class BucketTable:
    """A table in folders by a hash of its keys, of which a batch rewrites only the buckets that it has keys of.

    The rewrite is Spark's own dynamic partition overwrite. Each bucket holds, in a row beside its own, the last
    batch that wrote it, so a batch that runs again, whole or after a crash that left some buckets
    written, leaves those as they are: nothing is merged twice, whatever the merge. Take as many buckets as make
    a bucket about a file; a number once chosen stays. One writer at a time.
    """

    BUCKET, BATCH, ROW = "__bucket", "__batch", "__row"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _stored(self) -> DataFrame | None:
        return read_or_none(self.spark, self.path)

    def read(self) -> DataFrame | None:
        """The rows; none where no batch was written."""
        stored = self._stored()
        return None if stored is None else stored.filter(F.col(self.ROW).isNotNull()).select(f"{self.ROW}.*")

    def next_batch(self) -> int:
        stored = self._stored()
        last = None if stored is None else stored.filter(F.col(self.ROW).isNull()).agg(F.max(self.BATCH)).first()[0]
        return 0 if last is None else last + 1

    def bucket(self) -> Column:
        return F.pmod(_place(self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, batch_id: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets' rows by ``how(rows, batch)``; which buckets that were.

        Both sides are the touched buckets' alone, and ``how`` keeps rows in the bucket of their keys. The first
        batch of an empty table gets no rows but the batch's columns.
        """
        placed = batch.withColumn(self.BUCKET, self.bucket())
        touched = [r[0] for r in placed.select(self.BUCKET).distinct().collect()]  # no more than there are buckets
        stored = self._stored()
        if stored is not None and touched:
            marks = stored.filter(F.col(self.ROW).isNull() & F.col(self.BUCKET).isin(touched))
            done = {r[0] for r in marks.filter(F.col(self.BATCH) >= batch_id).select(self.BUCKET).collect()}
            touched = sorted(set(touched) - done)
        if not touched:
            return []
        rows = placed.filter(F.col(self.BUCKET).isin(touched)).drop(self.BUCKET)
        if stored is None:
            old = rows.limit(0)
        else:
            old = stored.filter(F.col(self.BUCKET).isin(touched) & F.col(self.ROW).isNotNull()).select(f"{self.ROW}.*")
        new = how(old, rows)
        held = new.select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias(self.ROW), F.lit(batch_id).cast("long").alias(self.BATCH), self.bucket().alias(self.BUCKET))
        kind = held.schema[self.ROW].dataType
        marks = self.spark.createDataFrame([(batch_id, k) for k in touched], f"{self.BATCH} long, {self.BUCKET} int")
        out = held.unionByName(marks.select(F.lit(None).cast(kind).alias(self.ROW), self.BATCH, self.BUCKET))
        # a bucket is one task and one file, unless it outgrows what a task should write
        out.repartition(min(len(touched), self.buckets), self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000).partitionBy(self.BUCKET).parquet(self.path)
        return touched


def _place(keys: Sequence[str]) -> Column:
    """The hash of key columns that places a row."""
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def merge_batch(table: BucketTable, order: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge the latest row of each key into a table, once for each batch id."""
    from ..operators.relational import dedup_latest

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = dedup_latest(transform(batch) if transform else batch, table.keys, order)
        table.merge(rows, batch_id, lambda old, new: changes.merge(old, new, table.keys, check=False))

    return run


def feed_batch(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: apply a change feed's rows to a table, once for each batch id."""

    def apply(old: DataFrame, feed: DataFrame) -> DataFrame:
        cols = [c for c in feed.columns if not c.startswith("_")]
        return changes.apply_feed(old.select(*cols), feed, table.keys)

    return lambda batch, batch_id: table.merge(batch, batch_id, apply) and None


def cdc_batch(table: BucketTable, sequence_by: Sequence[str], **options) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: fold change events into the state of a table (``cdc.fold_changes``), once for each batch id.

    Truncates reach all buckets, so with them a state is one bucket, or folded by ``cdc.fold_changes`` itself.
    """
    if options.get("truncates") is not None and table.buckets > 1:
        raise ValueError("truncates reach every key: use a table of one bucket")

    def fold(old: DataFrame, events: DataFrame) -> DataFrame:
        return cdc.fold_changes(events, table.keys, sequence_by, state=old if cdc.MARK in old.columns else None, **options)

    return lambda batch, batch_id: table.merge(batch, batch_id, fold) and None


def fan_out(sinks: Mapping[str, tuple[str, str]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: write each sink's rows, given as name -> (predicate, path), once for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for predicate, path in sinks.values():
                once_per_batch(batch.filter(predicate), path, batch_id)
        finally:
            batch.unpersist()

    return run


def observed(batch: DataFrame, valid: str, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write a batch and count its rows and valid rows in the same pass."""
    from pyspark.sql import Observation

    seen = Observation()
    write(batch.observe(seen, F.count("*").alias("total"), F.count(F.when(F.expr(valid), 1)).alias("valid")))
    return {k: int(v) for k, v in seen.get.items()}


def run_to_end(df: DataFrame, *, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Take in all that is there and stop."""
    q = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return q


def progress_table(spark: SparkSession, progress: Iterable) -> DataFrame:
    """A row per batch of a query: its ids, time, rows in, rates, duration, rows and bytes of state, rows dropped late."""
    rows = []
    for p in progress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        state = p.get("stateOperators", [])
        rows.append((
            str(p.get("id", "")), str(p.get("runId", "")), p.get("name"), p.get("timestamp"), p["batchId"], p.get("numInputRows", 0), float(p.get("inputRowsPerSecond") or 0), float(p.get("processedRowsPerSecond") or 0), p.get("durationMs", {}).get("triggerExecution", 0),
            sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("memoryUsedBytes", 0) for s in state), sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
        ))
    return spark.createDataFrame(rows, "query_id string, run_id string, name string, at string, batch_id long, input_rows long, input_rate double, process_rate double, duration_ms long, state_rows long, state_bytes long, late_rows long")


class ProgressLog(StreamingQueryListener):
    """Appends each progress of every query of a session to a table, which a query's own memory of the last hundred doesn't.

    Rows are written ``every`` so many and when a query ends; ``flush`` writes what is left.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 50):
        self.spark, self.path, self.every, self.held = spark, path, every, []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.held.append(json.loads(event.progress.json))
            full = len(self.held) >= self.every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            progress_table(self.spark, rows).coalesce(1).write.mode("append").parquet(self.path)
