"""Helpers that the corpus operators share: the cluster's shared folder, Arrow batch bounds, word tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A word is a run of ASCII letters and digits or of any characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate on UTF-8: A-Z to a-z, and each ASCII separator to a space.
FOLD = bytes(
    32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 * (65 <= b <= 90)
    for b in range(256)
)
#: The same without touching separators.
LOWER_ASCII = bytes(b + 32 * (65 <= b <= 90) for b in range(256))


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one serves local mode alone."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tarnlake-")
        found = _local[app]
    return found.rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, by: Sequence[str] = (), codec: str | None = None, batch: int | None = None) -> DataFrame:
    """Write to the shared folder and read it back: cuts lineage, survives lost executors.

    ``by`` names columns, the last ones, to partition the folder by; ``batch`` bounds the rows of an Arrow batch, for rows that
    are large; ``codec`` is the files' compression. The write's shuffle files go at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnlake-{name}-{uuid.uuid4().hex}"
    with _setting(spark, SHUFFLE_CLEANUP, "true"), _setting(spark, BATCH_ROWS, str(batch)) if batch else contextlib.nullcontext():
        df.write.options(**({"compression": codec} if codec else {})).partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    if (open_ := _scope.get()) is not None:
        open_.append(table)
    return table


_scope: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("tables", default=None)


@contextlib.contextmanager
def cleared() -> Iterator[list[DataFrame]]:
    """Within it, tables of ``materialize`` are temporary: all but those put into the list go at its end."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _scope.set(made)
    try:
        yield kept
    finally:
        _scope.reset(outer)
        release(*(t for t in made if not any(t is k for k in kept)))


_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once all that is made of them is written itself."""
    for table in tables:
        if path := _tables.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """A column name for each stem that none of the taken ones has, in any case, so that no input column ever clashes."""
    low = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from one task to the next: the last one's alone, so that those of several operators never add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """For tasks that keep nothing themselves: a worker that ran another operator's lets go of what it kept for it."""
    _held.clear()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most this many rows, so that a worker's memory follows the batch, not the partition."""
    now = int(spark.conf.get(BATCH_ROWS, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """Lower-case words joined by single spaces; null gives an empty string."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns case-insensitively, so that results of an operator never clash with extra input columns."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def fold_words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sum_chars(df: DataFrame, columns: Sequence[str]) -> int:
    """Characters in these columns over the whole table."""
    total = sum((F.coalesce(F.length(F.col(c)).cast("long"), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]
