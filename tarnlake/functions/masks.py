"""Masks for personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_email(col: Column, style: str = "full") -> Column:
    """``full`` hides the local part, ``lead`` leaves its first character, both keep the domain."""
    if style == "full":
        return F.regexp_replace(col, "^[^@]*@", "***@")
    if style == "lead":
        return F.regexp_replace(col, "^([^@])[^@]*@", "$1***@")
    raise ValueError(f"no such style: {style}")


def mask_partial(col: Column, head: int = 0, tail: int = 0, fill: str = "***") -> Column:
    """Keep the first ``head`` and last ``tail`` characters; texts no longer than both are hidden whole."""
    shown = F.concat(F.substring(col, F.lit(1), F.lit(head)), F.lit(fill), F.right(col, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(col) > head + tail, shown).when(col.isNotNull(), F.lit(fill))


def redact(col: Column) -> Column:
    """Hide a value but not whether there is one."""
    return F.when(col.isNotNull(), F.lit("[REDACTED]"))
