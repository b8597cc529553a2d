"""Batch reads and writes of files and databases."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampType

Schema = str | StructType | None


def _read(spark: SparkSession, fmt: str, path: str, schema: Schema, options: Mapping) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(spark: SparkSession, path: str, schema: Schema = None, **options) -> DataFrame:
    """CSV with a header; without a schema it is inferred, which reads the files twice."""
    return _read(spark, "csv", path, schema, {"header": True, **({} if schema is not None else {"inferSchema": True}), **options})


def read_json(spark: SparkSession, path: str, schema: Schema = None, **options) -> DataFrame:
    return _read(spark, "json", path, schema, options)


def read_parquet(spark: SparkSession, path: str, schema: Schema = None, **options) -> DataFrame:
    return _read(spark, "parquet", path, schema, options)


def read_text(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, "text", path, None, options)


def sql_path(spark: SparkSession, fmt: str, path: str, where: Column | str = "true") -> DataFrame:
    """Query files in place."""
    return spark.sql(f"SELECT * FROM {fmt}.`{path}`").filter(where)


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: Sequence[str] | None = None, *, by: str | None = None, partitions: int = 8, **properties) -> DataFrame:
    """A database table; filters on the result are pushed to the database.

    It is read in a partition for each predicate, or in ranges of the column ``by``, a number, date or timestamp:
    its least and greatest value are asked first, by a query that the database answers itself, and
    rows without a value are in the first range. A column of one value, or of none, is one partition.
    """
    if predicates and by:
        raise ValueError("predicates or a column, not both")
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties))
    if by is None:
        return spark.read.jdbc(url, table, properties=dict(properties))
    whole = spark.read.jdbc(url, table, properties=dict(properties))
    if not isinstance(whole.schema[by].dataType, NumericType | DateType | TimestampType):
        raise ValueError(f"{by} has no ranges")
    low, high = whole.agg(F.min(by), F.max(by)).first()
    if low is None or low == high:
        return whole
    text = lambda x: str(math.floor(x)) if isinstance(x, int | float | Decimal) else str(x)
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=by, lowerBound=text(low), upperBound=text(high), numPartitions=partitions, **properties).load()


def with_file_lineage(df: DataFrame) -> DataFrame:
    """Where a row comes from: path, name, size and time of its file."""
    meta = F.col("_metadata")
    return df.select("*", meta["file_path"].alias("_file_path"), meta["file_name"].alias("_file_name"), meta["file_size"].alias("_file_size"), meta["file_modification_time"].alias("_file_time"))


def write(df: DataFrame, path: str, mode: str = "error", *, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    writer: DataFrameWriter = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def overwrite_partitions(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def incremental_since(src: DataFrame, tgt: DataFrame | None, ts_col: str) -> DataFrame:
    """Source rows later than the latest that has landed; all where nothing has."""
    latest = tgt.agg(F.max(ts_col)).first()[0] if tgt is not None else None
    return src if latest is None else src.filter(F.col(ts_col) > F.lit(latest).cast(src.schema[ts_col].dataType))


def landed(df: DataFrame, source: str) -> DataFrame:
    """Rows as received, with the time and the name of their source."""
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source": F.lit(source)})


def land_bronze(df: DataFrame, path: str, source: str) -> None:
    """Append to the bronze table; columns may be new, readers merge the schemas."""
    landed(df, source).write.mode("append").parquet(path)


def create_as(df: DataFrame, table: str, mode: str = "error") -> None:
    df.write.mode(mode).saveAsTable(table)


def register_view(df: DataFrame, name: str, *, everywhere: bool = False) -> None:
    """A view for this session, or for all sessions of the application."""
    (df.createOrReplaceGlobalTempView if everywhere else df.createOrReplaceTempView)(name)


def write_partitions(df: DataFrame, open_fn: Callable[[], object], write_fn: Callable[[object, Iterable], None]) -> None:
    """Write to another system with one connection for each partition."""

    def run(rows) -> None:
        target = open_fn()
        try:
            write_fn(target, rows)
        finally:
            if hasattr(target, "close"):
                target.close()

    df.foreachPartition(run)
