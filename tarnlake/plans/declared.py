"""Tables declared as functions, run in the order they are listed, with expectations measured as they are written."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import holds
from ..streaming.sinks import once_per_batch


@dataclass
class Layer:
    """Reads the tables that were made before."""

    spark: SparkSession
    root: str

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}/rows"

    def read(self, name: str) -> DataFrame:
        """The rows of a table."""
        return self.spark.read.parquet(self.folder(name)).drop("batch_id")

    def stream(self, name: str) -> DataFrame:
        """The rows that a table gets from now on, and those it has at first."""
        return self.spark.readStream.schema(self.spark.read.parquet(self.folder(name)).schema).parquet(self.folder(name)).drop("batch_id")


@dataclass
class Declared:
    """A table: how it is made, and its rules. A streaming frame takes in new rows only, any other is made anew."""

    name: str
    make: Callable[[Layer], DataFrame]
    warn: Mapping[str, str] = field(default_factory=dict)
    drop: Mapping[str, str] = field(default_factory=dict)
    fail: Mapping[str, str] = field(default_factory=dict)


def _write(layer: Layer, table: Declared, df: DataFrame, to: Callable[[DataFrame], None]) -> None:
    """One pass: count what breaks a rule, stop at what must not be, drop what may not stay, write."""
    rules = [(action, name, rule) for action in ("warn", "drop", "fail") for name, rule in getattr(table, action).items()]
    seen = Observation()
    if rules:
        df = df.observe(seen, F.count("*").alias("n"), *[F.count_if(~holds(rule)).alias(f"r{k}") for k, (_, _, rule) in enumerate(rules)])
    for _, name, rule in (r for r in rules if r[0] == "fail"):
        df = df.filter(F.when(holds(rule), True).otherwise(F.raise_error(F.lit(f"{table.name} breaks the rule {name}")).cast("boolean")))
    for rule in table.drop.values():
        df = df.filter(holds(rule))
    to(df)
    if rules:
        found = seen.get
        rows = [(table.name, action, name, found["n"] - found[f"r{k}"], found[f"r{k}"]) for k, (action, name, _) in enumerate(rules)]
        metrics = layer.spark.createDataFrame(rows, "table string, action string, name string, passed_records long, failed_records long")
        metrics.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{layer.root.rstrip('/')}/_metrics")


def run_tables(spark: SparkSession, root: str, tables: Sequence[Declared], *, full_refresh: Iterable[str] = ()) -> Layer:
    """Make the tables one after the other; those named in ``full_refresh`` from their first row on. A failure stops it."""
    layer, anew = Layer(spark, root), set(full_refresh)
    for table in tables:
        folder = layer.folder(table.name)
        if table.name in anew:
            old = spark._jvm.org.apache.hadoop.fs.Path(folder).getParent()
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        df = table.make(layer)
        if df.isStreaming:
            each = lambda batch, k, t=table, to=folder: _write(layer, t, batch, lambda rows: once_per_batch(rows, to, k))
            df.writeStream.foreachBatch(each).option("checkpointLocation", folder.removesuffix("rows") + "checkpoint").trigger(availableNow=True).start().awaitTermination()
        else:
            _write(layer, table, df, lambda rows, to=folder: rows.write.mode("overwrite").parquet(to))
    return layer
