"""File-layout jobs and plan checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import paths
from .relational import fresh_names

TARGET_BYTES = 128 << 20


def plan_partitions(n_bytes: int, target: int = TARGET_BYTES) -> int:
    return max(1, -(-n_bytes // target))


def table_detail(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Files and bytes under a path, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").load(path).select("path", "length")
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.coalesce(F.min("length"), F.lit(0)).alias("min_bytes"), F.coalesce(F.max("length"), F.lit(0)).alias("max_bytes"))


def small_files(spark: SparkSession, path: str, small: int, fmt: str = "parquet") -> DataFrame:
    """(folder, path, key, length) of files below a size, in folders with at least two of them; from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").load(path).select("path", "length")
    files = files.withColumn("key", paths.listed("path")).withColumn("folder", paths.folder(F.col("key"))).filter(F.col("length") < small)
    several = files.groupBy("folder").agg(F.count("*").alias("n_files")).filter("n_files > 1").select("folder")
    return files.join(several, "folder").select("folder", "path", "key", "length")


def compact(spark: SparkSession, path: str, target: int = TARGET_BYTES, where: str | None = None, small: int | None = None) -> int:
    """Join a Parquet table's small files, folder by folder, into files of about the target size; how many files went.

    Files of ``small`` bytes (three quarters of the target) and more stay as they are. ``where``, over the
    partition columns, chooses partitions; all others stay untouched. Each small file is dealt to a bin of its folder
    by the bytes before it. The new files are written out of sight; then a plan of what moves in and what goes
    is written, then carried out, and a run that finds a plan of one that died carries it out first, so rows are neither
    lost nor doubled. Nothing else should read or write the chosen partitions meanwhile.
    """
    path = path.rstrip("/")
    _exchange(spark, path)
    whole = spark.read.parquet(path)
    found = small_files(spark, path, small or target * 3 // 4)
    first = found.select("key").first()
    if first is None:
        return 0
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)
    below = first.key.removeprefix(base.toUri().getPath()).strip("/").split("/")[:-1] if first.key.startswith(base.toUri().getPath()) else first.key.split("/")[:-1]
    keys = [x.split("=", 1)[0] for x in below if "=" in x]
    if where is not None:
        spark.createDataFrame([], whole.select(*keys).schema).filter(where)  # raises unless the condition is on partition columns alone
        chosen = whole.filter(where).select(paths.folder(paths.of_row("_metadata.file_path")).alias("folder")).distinct()
        found = found.join(chosen, "folder", "left_semi")
    before = Window.partitionBy("folder").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bins = found.withColumn("bin", F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / target)).persist()
    try:
        names = [r.path for r in bins.select("path").collect()]  # names of small files alone
        if not names:
            return 0
        key, bin_ = fresh_names(whole.columns, "key", "bin")
        rows = spark.read.option("basePath", path).schema(whole.schema).parquet(*names).withColumn(key, paths.of_row("_metadata.file_path"))
        placed = rows.join(bins.select(F.col("key").alias(key), F.col("bin").alias(bin_)), key)
        dealt = placed.repartition(bins.select("folder", "bin").distinct().count(), *keys, bin_).select(*whole.columns)
        staged = f"{path}/_compacted-{uuid.uuid4().hex}"
        dealt.write.partitionBy(*keys).parquet(staged)
        _write_text(spark, f"{staged}/_plan", "\n".join([base.toString(), *names]))
        _exchange(spark, path)
        return len(names)
    finally:
        bins.unpersist()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _exchange(spark: SparkSession, path: str) -> None:
    """Carry out what plans of compactions say: new files in, old ones out. Doing it again changes nothing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_compacted-*")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [f.getPath() for f in fs.globStatus(at) or []]:
        plan = jvm.org.apache.hadoop.fs.Path(folder, "_plan")
        if fs.exists(plan):
            stream = fs.open(plan)
            try:
                base, *old = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            finally:
                stream.close()
            staged = fs.makeQualified(folder).toString()
            files = fs.listFiles(folder, True)
            moves = []
            while files.hasNext():
                p = files.next().getPath()
                if p.getName().endswith(".parquet"):
                    moves.append(p)
            for p in moves:
                to = jvm.org.apache.hadoop.fs.Path(base + p.toString()[len(staged) :])
                if not fs.rename(p, to) and not fs.exists(to):
                    raise OSError(f"can't move {p}")
            for name in old:
                fs.delete(jvm.org.apache.hadoop.fs.Path(name), False)
        fs.delete(folder, True)


def zorder(df: DataFrame, cols: Sequence[str], parts: int, bits: int = 10) -> DataFrame:
    """Range-partition and sort along a Z-curve over quantile ranks of numeric columns."""
    if not 2 <= len(cols) <= 4:
        raise ValueError("two to four columns")
    steps = (1 << bits) - 1
    marks = df.agg(*[F.percentile_approx(c, [k / steps for k in range(1, steps)], 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()

    def rank(i: int, c: str) -> Column:
        """Number of quantiles up to the value, by halving."""
        found = sorted(marks[f"q{i}"] or [])
        if not found:
            return F.lit(0)
        q = F.lit(found)
        halves = F.array(*[F.lit(1 << k) for k in range(bits, -1, -1)])
        return F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.coalesce(F.get(q, n + half - 1) <= F.col(c), F.lit(False)), n + half).otherwise(n))

    z = F.lit(0).cast("long")
    ranks = [rank(i, c) for i, c in enumerate(cols)]
    out = df.withColumns({f"__z{i}": r for i, r in enumerate(ranks)})
    for bit in range(bits):
        for i in range(len(cols)):
            one = F.shiftright(F.col(f"__z{i}"), bit).bitwiseAND(F.lit(1)).cast("long")
            z = z + one * F.lit(1 << (bit * len(cols) + i)).cast("long")
    return out.withColumn("__z", z).repartitionByRange(parts, "__z").sortWithinPartitions("__z").drop("__z", *[f"__z{i}" for i in range(len(cols))])


def cluster(df: DataFrame, cols: Sequence[str], parts: int) -> DataFrame:
    return df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)


def explain_facts(df: DataFrame) -> dict:
    """What the physical plan says: pushed filters, partition filters, joins, exchanges."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pick = lambda name: [x for x in re.findall(rf"{name}: \[(.*)\]", text) if x]
    return {
        "pushed_filters": pick("PushedFilters"),
        "partition_filters": pick("PartitionFilters"),
        "read_schema": re.findall(r"ReadSchema: (.*)", text),
        "joins": re.findall(r"^\(\d+\) (\w*Join\w*|CartesianProduct)", text, re.M),
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", text, re.M)),
    }


def analyze(spark: SparkSession, table: str, cols: Sequence[str]) -> None:
    """Column statistics for the optimizer."""
    names = ", ".join(f"`{c}`" for c in cols)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {names}")
