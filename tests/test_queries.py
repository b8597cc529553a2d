"""Every registered query with SQL gives the rows of that SQL in another engine."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tarnlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x) + 0.0:.9g}" if isinstance(x, float) else str(x)

    cols = [[text(x) for x in df[c].astype(object)] for c in sorted(df.columns)]
    return sorted(zip(*cols, strict=True))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == [tuple(x.replace("-0", "0") if x == "-0" else x for x in r) for r in rows(want)]


def test_queries_without_sql_are_named():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"session_functions", "trained_models", "market_backtest"}


def test_session_functions(spark, sf_dir):
    got = plans.QUERIES["session_functions"](spark, sf_dir).collect()
    assert got and all(x is not None for r in got for x in r)


def test_trained_models_score_like_models(spark, sf_dir):
    """Of every symbol the last fifth, figures within their ranges, and errors near those of predicting no change."""
    got = plans.QUERIES["trained_models"](spark, sf_dir).toPandas().set_index("symbol")
    assert list(sorted(got.index)) == ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    assert got.accuracy.between(0.3, 0.9).all() and (got.mae < 3 * got.naive_mae).all() and (got.mae > 0).all()
    assert got.auc.between(0.2, 1).all() and got.auc.mean() > 0.5


def test_backtest_of_the_market_pipeline(spark, sf_dir):
    got = plans.QUERIES["market_backtest"](spark, sf_dir).toPandas()
    # symbols with fewer than ten held-out rows are skipped
    assert 3 <= len(got) <= 5 and (got.max_drawdown_pct <= 0).all() and (got.max_drawdown_pct > -100).all()
    assert got.win_rate_pct.between(0, 100).all() and (got.total_return_pct > -100).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
