"""One form of a file's path, whether it comes from a listing or from a row's file metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/*"


def listed(path: Column | str) -> Column:
    """From a listing: without its scheme."""
    return F.regexp_replace(path, _SCHEME, "/")


def of_row(path: Column | str) -> Column:
    """From ``_metadata.file_path``, which is encoded as a URL."""
    return listed(F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B"))))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")
