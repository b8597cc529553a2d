"""Bronze, silver and gold as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality, relational


def medallion(bronze: DataFrame, rules: Mapping[str, Column | str], *, keys: Sequence[str], order: str) -> dict[str, DataFrame]:
    """Landed orders -> latest valid row per key and quarantine -> yearly revenue by status."""
    latest = relational.dedup_latest(bronze, keys, order)
    silver, bad = quality.split(quality.flag(latest, rules))
    gold = silver.groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("revenue"))
    return {"bronze": bronze, "silver": silver, "quarantine": bad, "gold": gold}
