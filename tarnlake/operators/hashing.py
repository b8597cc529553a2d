"""A hash of a row's content, whatever its columns' types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def _holds(kind: DataType, what: tuple[type, ...]) -> bool:
    if isinstance(kind, what):
        return True
    if isinstance(kind, ArrayType):
        return _holds(kind.elementType, what)
    if isinstance(kind, MapType):
        return _holds(kind.keyType, what) or _holds(kind.valueType, what)
    return isinstance(kind, StructType) and any(_holds(f.dataType, what) for f in kind.fields)


def comparable(col: Column, kind: DataType) -> Column:
    """The value in a form that can be hashed and compared: maps as entries in the order of their keys, at any depth."""
    if isinstance(kind, VariantType):
        return F.to_json(col)
    if not _holds(kind, (MapType, VariantType)):
        return col
    if isinstance(kind, MapType):
        pair = lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(col), pair))
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: comparable(x, kind.elementType))
    fields = [comparable(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A 64-bit hash of these columns; equal rows have equal hashes, also where they hold maps."""
    return F.xxhash64(*[comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in (columns or df.columns)])
