"""Examples of each kind of user function, for what built-in functions can't say. Built-in ones come first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _amount_class(x: float | None) -> str:
    return "UNKNOWN" if x is None else "LOW" if x < 50_000 else "MEDIUM" if x < 150_000 else "HIGH"


classify_amount = F.udf(_amount_class, StringType(), useArrow=True)


@F.pandas_udf(StringType())
def amount_band_pandas(x: pd.Series) -> pd.Series:
    out = pd.Series("HIGH", index=x.index, dtype=object)
    out[x < 150_000] = "MEDIUM"
    out[x < 50_000] = "LOW"
    out[x.isna()] = "UNKNOWN"
    return out


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: a Python one, and one in SQL that Spark inlines."""
    spark.udf.register("classify_amount", classify_amount)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION amount_band_sql(x DOUBLE) RETURNS STRING "
        "RETURN CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x < 50000 THEN 'LOW' WHEN x < 150000 THEN 'MEDIUM' ELSE 'HIGH' END"
    )


def add_rank(df: DataFrame, key: str, order: str, out: str = "rank_in_group") -> DataFrame:
    """Rank within a group by grouped map; for small groups. top_n does the same without Python."""
    schema = StructType([*df.schema.fields, StructField(out, LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**{out: pdf[order].rank(method="first", ascending=False).astype("int64")})[schema.names]

    return df.groupBy(key).applyInPandas(run, schema)


def number_batches(df: DataFrame, out: str = "row_in_batch") -> DataFrame:
    """Number rows within each Arrow batch: unique only there."""
    schema = StructType([*df.schema.fields, StructField(out, LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: range(len(pdf))})

    return df.mapInPandas(run, schema)
