"""Masked columns, row filters, policies by column tag, access reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import redact


def masked_view(df: DataFrame, rules: Mapping[str, Sequence[str]], role: str) -> DataFrame:
    """Null the columns that the role may not see; ``rules`` names the roles that may, by column."""
    return df.select(*[F.col(c) if c not in rules or role in rules[c] else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def row_filter(df: DataFrame, col: str, allowed: Iterable) -> DataFrame:
    """Rows whose attribute is one of the allowed values."""
    return df.filter(F.col(col).isin(list(allowed)))


def row_filter_by_access(df: DataFrame, access: DataFrame, user: str, groups: Sequence[str] = (), *, user_col: str = "user_email", attribute: str = "region", admin: str = "admins") -> DataFrame:
    """Rows that an access table (user -> attribute value) opens to the user; admins see all."""
    if admin in groups:
        return df
    own = access.filter(F.col(user_col) == user).select(attribute).distinct()
    return df.join(own, attribute, "left_semi").select(*df.columns)


def tagged(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Put a tag into columns' metadata."""
    for c, tag in tags.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, "tag": tag})
    return df


def apply_policy(df: DataFrame, policy: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Mask each column by the rule for its tag."""
    policy = policy or {"pii": redact}
    return df.select(*[policy[t](F.col(f.name)).alias(f.name) if (t := f.metadata.get("tag")) in policy else F.col(f.name) for f in df.schema.fields])


def describe_columns(df: DataFrame, comments: Mapping[str, str], never_features: Sequence[str] = ()) -> DataFrame:
    """Comments as column metadata; labels are marked as never to be used as a feature."""
    for c in df.columns:
        more = ({"comment": comments[c]} if c in comments else {}) | ({"never_a_feature": True} if c in never_features else {})
        if more:
            df = df.withMetadata(c, {**df.schema[c].metadata, **more})
    return df


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comment_table(spark: SparkSession, table: str, comment: str | None = None, columns: Mapping[str, str] | None = None) -> None:
    """Comments of a table of the catalog and of its columns, as DESCRIBE shows them."""
    name = ".".join(f"`{part}`" for part in table.split("."))
    known = {c.lower() for c in spark.table(table).columns}
    missing = [c for c in columns or {} if c.lower() not in known]
    if missing:
        raise ValueError(f"{table} has no columns {missing}")
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {name} IS {_quoted(comment)}")
    for c, text in (columns or {}).items():
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{c}` COMMENT {_quoted(text)}")


def table_comments(spark: SparkSession, table: str) -> DataFrame:
    """(column, comment) of a table's columns, for a catalog report; null where there is none."""
    rows = [(c.name, c.description) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "column string, comment string")


def access_report(log: DataFrame, since: Column, *, ts: str = "ts", user: str = "user_id", action: str = "event_type", failed: Column | None = None) -> DataFrame:
    """Per user and action since a time: number, how many of them failed, the last time."""
    failures = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
    return log.filter(F.col(ts) >= since).groupBy(user, action).agg(F.count("*").alias("n"), failures.alias("failures"), F.max(ts).alias("last_seen"))
