"""A daily backtest of predictions: signals, returns after cost, equity curves, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import cumprod, drawdown

DAYS_PER_YEAR = 252


def _by():
    """Bars of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("timestamp")


@dataclass(frozen=True)
class Config:
    min_confidence: float = 0.55
    transaction_cost_bps: float = 5.0
    position_size_pct: float = 1.0
    initial_capital: float = 100_000.0


def signals(pred: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """Long where the predicted probability is above the bound; a first signal counts as a change."""
    out = pred.withColumn("signal", (F.col("pred_proba_up") > min_confidence).cast("int"))
    return out.withColumn("position_change", F.abs(F.col("signal") - F.coalesce(F.lag("signal").over(_by()), F.lit(0))))


def equity(pred: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Strategy and buy-and-hold returns and equity. Needs target_return_next and pred_proba_up."""
    out = signals(pred, cfg.min_confidence)
    cost = cfg.transaction_cost_bps / 10_000
    out = out.withColumn("strategy_return", F.col("signal") * F.col("target_return_next") * cfg.position_size_pct - F.col("position_change") * cost * cfg.position_size_pct)
    out = out.withColumn("buy_hold_return", F.col("target_return_next"))
    return out.withColumns({f"{x}_equity": cfg.initial_capital * cumprod(1 + F.col(f"{x}_return"), _by()) for x in ("strategy", "buy_hold")})


def performance(curves: DataFrame, which: str = "strategy") -> DataFrame:
    """Per symbol: total return, CAGR, Sharpe ratio, largest drawdown, share of winning days, in per cent.

    The total return starts from the first day's equity, so that day's own return doesn't count.
    All are 0 where the last equity isn't positive.
    """
    r, e = F.col(f"{which}_return"), F.col(f"{which}_equity")
    down = curves.withColumn("__down", drawdown(e, _by()))
    raw = down.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.min_by(e, "timestamp").alias("first"),
        F.max_by(e, "timestamp").alias("last"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min("__down").alias("down"),
        F.avg(F.when(r != 0, (r > 0).cast("double"))).alias("won"),
    )
    grown = F.col("last") / F.col("first")
    values = {
        "total_return_pct": (grown - 1) * 100,
        "cagr_pct": (F.pow(grown, F.lit(float(DAYS_PER_YEAR)) / F.col("n")) - 1) * 100,
        "sharpe": F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(float(DAYS_PER_YEAR)))).otherwise(0.0),
        "max_drawdown_pct": F.col("down") * 100,
        "win_rate_pct": F.coalesce(F.col("won"), F.lit(0.0)) * 100,
    }
    return raw.select("symbol", *[F.round(F.when(F.col("last") > 0, v).otherwise(0.0), 2).alias(k) for k, v in values.items()])


def trade_stats(curves: DataFrame, least_rows: int = 10) -> DataFrame:
    """Per symbol with enough rows: number of trades and share of days in the market."""
    by = curves.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.sum("position_change").cast("long").alias("n_trades"), F.round(F.avg("signal") * 100, 4).alias("pct_time_in_market"))
    return by.filter(F.col("n_rows") >= least_rows)
