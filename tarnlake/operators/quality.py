"""Named quality rules, expectations, quarantine and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASON = "_quality_reason"


class ExpectationFailed(ValueError):
    """A rule that must hold for all rows did not."""


def flag(df: DataFrame, rules: Mapping[str, Column | str], reason: str = REASON) -> DataFrame:
    """Name of the first rule that finds a row bad, else null. A rule that is null for a row finds nothing."""
    case = F.lit(None).cast("string")
    for name, bad in reversed(list(rules.items())):
        case = F.when(F.expr(bad) if isinstance(bad, str) else bad, F.lit(name)).otherwise(case)
    return df.withColumn(reason, case)


def _missing(keys: Sequence[str]) -> str:
    return " OR ".join(f"{k} IS NULL" for k in keys)


def flag_bars(df: DataFrame, max_abs_return: float = 0.5) -> DataFrame:
    """Price bars (symbol, timestamp, open, high, low, close, volume), rules in order of precedence.

    The return compares with the previous bar of the symbol; a previous close of zero gives none.
    """
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("timestamp"))
    with_return = df.withColumn("__return", F.try_divide(F.col("close") - before, before))
    rules = {
        "missing_key": _missing(["symbol", "timestamp"]),
        "non_positive_close": "close <= 0",
        "non_positive_open": "open <= 0",
        "negative_volume": "volume < 0",
        "high_lt_low": "high < low",
        "high_lt_open": "high < open",
        "high_lt_close": "high < close",
        "low_gt_open": "low > open",
        "low_gt_close": "low > close",
        "implausible_return": f"abs(__return) > {max_abs_return}",
    }
    return flag(with_return, rules).drop("__return")


def flag_quotes(df: DataFrame) -> DataFrame:
    return flag(
        df,
        {
            "missing_key": _missing(["symbol", "timestamp"]),
            "non_positive_bid": "bid_price <= 0",
            "non_positive_ask": "ask_price <= 0",
            "crossed_quote": "bid_price > ask_price",
            "negative_size": "bid_size < 0 OR ask_size < 0",
        },
    )


def flag_trades(df: DataFrame) -> DataFrame:
    return flag(df, {"missing_key": _missing(["symbol", "timestamp"]), "non_positive_price": "price <= 0", "non_positive_size": "size <= 0"})


def split(flagged: DataFrame, reason: str = REASON) -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason, bad rows with it)."""
    return flagged.filter(F.col(reason).isNull()).drop(reason), flagged.filter(F.col(reason).isNotNull())


def quarantine_rate(flagged: DataFrame, reason: str = REASON) -> DataFrame:
    """Rows, bad rows and their share in per cent, in one pass; 0 for no rows."""
    counted = flagged.agg(F.count("*").alias("n_rows"), F.count(reason).alias("n_bad"))
    return counted.withColumn("rate_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_bad"), F.col("n_rows")), F.lit(0.0)), 4))


def holds(rule: Column | str) -> Column:
    """Whether a rule holds; a null result doesn't."""
    return F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def expect(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Per rule: passed and failed rows. Rows stay as they are."""
    sums = [F.coalesce(F.sum((~holds(r)).cast("long")), F.lit(0)).alias(n) for n, r in rules.items()]
    if not rules:
        return df.sparkSession.createDataFrame([], "name string, passed_records long, failed_records long")
    one = df.agg(F.count("*").alias("__n"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col("__n") - F.col(n)).alias("passed_records"), F.col(n).alias("failed_records")) for n in rules]))
    return one.select(each.alias("m")).select("m.*")


def _all(rules: Mapping[str, Column | str]) -> Column:
    return reduce(lambda a, r: a & holds(r), rules.values(), F.lit(True))


def expect_all_or_drop(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Rows for which all rules hold."""
    return df.filter(_all(rules))


def expect_or_drop(df: DataFrame, name: str, rule: Column | str) -> DataFrame:
    return expect_all_or_drop(df, {name: rule})


def expect_all_or_fail(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """The rows unchanged; raises before anything is written where a rule fails."""
    failed = {r["name"]: r["failed_records"] for r in expect(df, rules).collect() if r["failed_records"]}  # a row per rule
    if failed:
        raise ExpectationFailed(f"rows that break a rule: {failed}")
    return df


def expect_or_fail(df: DataFrame, name: str, rule: Column | str) -> DataFrame:
    return expect_all_or_fail(df, {name: rule})


def quarantine(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """The complement of the rows that expect_all_or_drop keeps, with the names of the broken rules."""
    broken = F.filter(F.array(*[F.when(~holds(r), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.filter(~_all(rules)).withColumn("broken_rules", F.array_join(broken, ","))


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and whether they are as many."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return out.withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two tables of equal columns, rows missing in the second and extra in it."""
    cols = a.columns
    sides = a.select(*cols, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*cols, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    by = sides.groupBy(*cols).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    return by.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("n_extra"),
    )


def enforce(df: DataFrame, not_null: Sequence[str] = (), checks: Mapping[str, Column | str] | None = None) -> DataFrame:
    """NOT NULL and CHECK constraints before a write: raises where existing rows break one.

    As in SQL, a check that is null for a row passes.
    """
    rules: dict[str, Column | str] = {f"{c} is not null": F.col(c).isNotNull() for c in not_null}
    rules |= {n: F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(True)) for n, r in (checks or {}).items()}
    return expect_all_or_fail(df, rules)


def null_marker(col: str) -> Column:
    """NULL_<NAME> where the value is missing, else null."""
    return F.when(F.col(col).isNull(), F.lit(f"NULL_{col.upper()}"))
