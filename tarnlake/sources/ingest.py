"""Incremental ingestion, schema inference and evolution, rescued data, load ledgers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import paths

RESCUED = "_rescued_data"
COPIED_FROM = "_copied_from"


class SchemaChanged(ValueError):
    """New columns in a mode that allows none."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_files(spark: SparkSession, src: str, fmt: str, schema: StructType | str, **options) -> DataFrame:
    """A stream of the files under a folder. Options: pathGlobFilter, recursiveFileLookup, maxFilesPerTrigger."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(src)


def ingest_files(spark: SparkSession, src: str, fmt: str, sink: str, checkpoint: str, schema: StructType | str, *, transform: Callable[[DataFrame], DataFrame] | None = None, **options) -> None:
    """Append what files came since the last call, once each, and stop; the checkpoint remembers them."""
    rows = stream_files(spark, src, fmt, schema, **options)
    out = transform(rows) if transform else rows
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def schema_versions(spark: SparkSession, store: str) -> list[StructType]:
    """The schemas kept under a folder, oldest first; none where nothing is kept."""
    if not _exists(spark, store):
        return []
    rows = spark.read.text(store, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()  # a small file a version
    return [StructType.fromJson(json.loads(r.value)) for r in sorted(rows, key=lambda r: r.path.split("version-")[-1])]


def keep_schema(spark: SparkSession, store: str, schema: StructType) -> None:
    """Add a version; one that is equal to the last is not added again."""
    known = schema_versions(spark, store)
    if known and known[-1] == schema:
        return
    to, fs = _hadoop(spark, f"{store.rstrip('/')}/version-{len(known):06d}.json")
    out = fs.create(to, False)  # fails where another writer was first
    try:
        out.write(bytearray(schema.json().encode()))
    finally:
        out.close()


def merged_schema(known: StructType, found: StructType) -> StructType:
    """The known columns with their types, then the new ones."""
    return StructType([*known.fields, *(f for f in found.fields if f.name not in known.names)])


def _hinted(found: StructType, hints: str | None) -> StructType:
    wanted = {f.name: f for f in StructType.fromDDL(hints).fields} if hints else {}
    return StructType([wanted.pop(f.name, f) for f in found.fields] + list(wanted.values()))


def infer_schema(spark: SparkSession, path: str, fmt: str, store: str, hints: str | None = None, sampling: float = 1.0, *, refresh: bool = False) -> StructType:
    """The last schema kept under ``store``, else one inferred from the files, with hints, and kept there.

    ``refresh`` looks at the files again and keeps a new version where they have columns that aren't known.
    """
    known = schema_versions(spark, store)
    if known and not refresh:
        return known[-1]
    found = _hinted(spark.read.format(fmt).options(header=True, inferSchema=True, samplingRatio=sampling).load(path).schema, hints)
    now = merged_schema(known[-1], found) if known else found
    keep_schema(spark, store, now)
    return now


def stream_evolving(spark: SparkSession, src: str, fmt: str, sink: str, checkpoint: str, store: str, mode: str = "addNewColumns", *, hints: str | None = None, **options) -> StructType:
    """Take in the files that came since the last call, under a schema that may grow; the schema they were written with.

    The first call keeps the schema of the files it finds. Later, where a batch's files have columns that the last
    version doesn't know: addNewColumns keeps a version with them and stops with SchemaChanged before anything of
    the batch is written, and the next call takes the batch in with it; rescue keeps them as JSON in
    _rescued_data, none drops them, failOnNewColumns stops, each time again. Each batch is a partition of the sink by its
    id, so a batch that runs again replaces itself.
    """
    known = infer_schema(spark, src, fmt, store, hints)
    reader = {"header": True, **options}
    rows = spark.readStream.format(fmt).schema(known).options(**reader).load(src).select(F.col("_metadata.file_path").alias("path"))

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.distinct().collect()]  # the files of one batch; bound it by maxFilesPerTrigger
        if not paths:
            return
        found = _hinted(spark.read.format(fmt).options(inferSchema=True, **reader).load(paths).schema, hints)
        merged = merged_schema(known, found)
        if mode == "addNewColumns" and merged != known:
            keep_schema(spark, store, merged)
            raise SchemaChanged(f"new columns: {merged.names[len(known.names):]}; the next run goes on with them")
        wide = spark.read.format(fmt).schema(merged).options(**reader).load(paths)
        once_per_batch(evolve(wide, known, mode), sink, batch_id)

    query = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "SchemaChanged" in str(e):
            raise SchemaChanged(str(e).splitlines()[0]) from e
        raise
    return known


def once_per_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch into its own part of a table: a batch that runs again, whole or in part, replaces itself."""
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def evolve(df: DataFrame, known: StructType, mode: str = "addNewColumns") -> DataFrame:
    """Bring rows to a schema. Columns that rows lack become null; of those it doesn't know:
    addNewColumns takes them in, rescue keeps them as JSON, none drops them, failOnNewColumns raises."""
    new = [c for c in df.columns if c not in known.names]
    base = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields]
    if mode == "addNewColumns":
        return df.select(*base, *new)
    if mode == "rescue":
        kept = F.when(F.coalesce(*[F.col(c).cast("string") for c in new]).isNotNull(), F.to_json(F.struct(*new))) if new else F.lit(None).cast("string")
        return df.select(*base, kept.alias(RESCUED))
    if mode == "failOnNewColumns" and new:
        raise SchemaChanged(f"new columns: {new}")
    if mode in ("none", "failOnNewColumns"):
        return df.select(*base)
    raise ValueError(f"no such mode: {mode}")


def with_rescued(df: DataFrame, json_col: str, schema: StructType | str) -> DataFrame:
    """Parse JSON; fields that the schema lacks, and values that don't fit it, are kept in _rescued_data.

    Text that isn't a JSON object is kept whole.
    """
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = F.from_json(json_col, "map<string,string>")
    typed = {f.name: F.try_variant_get(F.try_parse_json(json_col), f"$.{f.name}", f.dataType.simpleString()) for f in want.fields}
    misfit = F.map_filter(raw, lambda k, v: ~k.isin(want.names) if want.names else F.lit(True))
    for f in want.fields:
        bad = F.element_at(raw, f.name).isNotNull() & typed[f.name].isNull()
        misfit = F.map_concat(misfit, F.when(bad, F.create_map(F.lit(f.name), F.element_at(raw, f.name))).otherwise(F.create_map().cast("map<string,string>")))
    rescued = F.when(raw.isNull(), F.col(json_col)).when(F.size(misfit) > 0, F.to_json(misfit))
    return df.select("*", *[typed[n].alias(n) for n in want.names], rescued.alias(RESCUED))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, key, length, modificationTime) of the files under a path; no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", paths.listed("path").alias("key"), "length", "modificationTime")


def _loads(spark: SparkSession, folder: str) -> set[str]:
    p, fs = _hadoop(spark, f"{folder}/load=*")
    return {f.getPath().getName() for f in fs.globStatus(p) or []}


def _enter(spark: SparkSession, files: DataFrame, ledger: str, load: str) -> None:
    """Write a load's files into the ledger: a folder of its own, there whole or not at all."""
    files.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/_{load}")
    p, fs = _hadoop(spark, f"{ledger}/_{load}")
    fs.rename(p, _hadoop(spark, f"{ledger}/{load}")[0])


def copy_into(spark: SparkSession, src: str, tgt: str, fmt: str, *, schema: StructType | str | None = None, select: Sequence[Column | str] | None = None, pattern: str | None = None, force: bool = False) -> int:
    """Append the files that no earlier call loaded; how many rows that were. ``force`` loads all again.

    Files are listed first and compared with a ledger of paths beside the table (``<tgt>.ledger``), so that loaded
    ones aren't opened again. A load is a folder of the table, written out of sight and then renamed: it is there
    whole or not at all. The ledger follows; a load that a crash kept from it is entered by the next call, from the
    path that each row keeps (``_copied_from``). One caller at a time. A file that changes under its path is not
    loaded again.
    """
    tgt, ledger = tgt.rstrip("/"), f"{tgt.rstrip('/')}.ledger"
    for load in sorted(_loads(spark, tgt) - _loads(spark, ledger)):
        rows = spark.read.parquet(f"{tgt}/{load}").select(F.col(COPIED_FROM).alias("path"), paths.of_row(COPIED_FROM).alias("key")).distinct()
        _enter(spark, rows.withColumns({"length": F.lit(None).cast("long"), "modificationTime": F.lit(None).cast("timestamp")}), ledger, load)
    fresh = list_files(spark, src, pattern)
    known = read_or_none(spark, ledger)
    if known is not None and not force:
        fresh = fresh.join(known.select("key").distinct(), "key", "left_anti").select("path", "key", "length", "modificationTime")
    listed = fresh.collect()  # the new files' names
    if not listed:
        return 0
    reader = spark.read.format(fmt)
    reader = reader.schema(schema) if schema is not None else reader.options(header=True, inferSchema=True)
    rows = reader.load([r.path for r in listed]).select(*(select or ["*"]), F.col("_metadata.file_path").alias(COPIED_FROM))
    load = f"load={len(_loads(spark, tgt)):09d}"
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{tgt}/_{load}")
    done, fs = _hadoop(spark, f"{tgt}/_{load}")
    if not fs.rename(done, _hadoop(spark, f"{tgt}/{load}")[0]):
        raise OSError(f"can't move {done}")
    _enter(spark, spark.createDataFrame(listed, fresh.schema), ledger, load)
    return int(seen.get["n"])


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, none where there is nothing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
