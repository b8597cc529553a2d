"""Market features, gold tables, models and the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, features, models
from ..sources.scratch import scratch
from . import market_pipeline, query
from .data import BARS, QUOTES, TRADES, bars, quotes, table, trades

_DAY = "strftime(timestamp, '%Y-%m-%d') AS day"
_W = "PARTITION BY symbol ORDER BY timestamp"


def _out(df, *cols, places: int = 6, **other):
    """Symbol, day and rounded columns; ``other`` names columns with places of their own, None for as they are."""
    rounded = [F.round(c, places).alias(c) for c in cols] + [F.col(c) if n is None else F.round(c, n).alias(c) for c, n in other.items()]
    return df.select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), *rounded)


def _rolling(agg: str, of: str, n: int) -> str:
    w = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {w} = {n} THEN {agg}({of}) {w} END"


_RETURNS = f"{BARS}, r AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS return_1d, ln(close) - ln(lag(close) OVER ({_W})) AS log_return_1d FROM bars)"


@query(f"WITH {_RETURNS} SELECT symbol, {_DAY}, round(return_1d, 6) AS return_1d, round(log_return_1d, 6) AS log_return_1d FROM r")
def bar_returns(spark, d):
    return _out(features.returns(bars(spark, d)), "return_1d", "log_return_1d")


@query(f"WITH {BARS} SELECT symbol, {_DAY}, {', '.join(f'round({_rolling('avg', 'close', n)}, 4) AS sma_{n}' for n in (5, 10, 20))} FROM bars")
def moving_averages(spark, d):
    b = bars(spark, d)
    for n in (5, 10, 20):
        b = features.sma(b, n)
    return _out(b, "sma_5", "sma_10", "sma_20", places=4)


@query(
    f"""WITH {BARS}, m AS (SELECT *, {_rolling('avg', 'close', 20)} AS mid, {_rolling('stddev_samp', 'close', 20)} AS std FROM bars)
        SELECT symbol, {_DAY}, round(mid, 4) AS bb_mid, round(mid + 2 * std, 4) AS bb_upper, round(mid - 2 * std, 4) AS bb_lower, round((close - mid + 2 * std) / (4 * std), 6) AS bb_pct_b FROM m"""
)
def bollinger_bands(spark, d):
    return _out(features.bollinger(bars(spark, d)), "bb_mid", "bb_upper", "bb_lower", places=4, bb_pct_b=6)


@query(
    f"""WITH {_RETURNS} SELECT symbol, {_DAY}, round({_rolling('stddev_samp', 'return_1d', 10)}, 6) AS volatility_10d, round({_rolling('stddev_samp', 'return_1d', 20)}, 6) AS volatility_20d,
        round(CASE WHEN {_rolling('stddev_samp', 'volume', 20)} > 0 THEN (volume - {_rolling('avg', 'volume', 20)}) / {_rolling('stddev_samp', 'volume', 20)} END, 6) AS volume_zscore_20d FROM r"""
)
def volatility(spark, d):
    out = features.volume_z(features.volatility(features.volatility(features.returns(bars(spark, d)), 10), 20))
    return _out(out, "volatility_10d", "volatility_20d", "volume_zscore_20d")


@query(f"WITH {_RETURNS} SELECT symbol, {_DAY}, lag(close, 1) OVER ({_W}) AS close_lag_1, lag(close, 3) OVER ({_W}) AS close_lag_3, round(lag(return_1d, 2) OVER ({_W}), 6) AS return_lag_2 FROM r")
def lagged(spark, d):
    return _out(features.lags(features.returns(bars(spark, d)), {"close": "close", "return_1d": "return"}), "close_lag_1", "close_lag_3", "return_lag_2")


@query(f"WITH {BARS}, l AS (SELECT *, lead(close) OVER ({_W}) / close - 1 AS t FROM bars) SELECT symbol, {_DAY}, round(t, 6) AS target_return_next, CAST(t > 0 AS INTEGER) AS target_up_next FROM l")
def next_day_labels(spark, d):
    return _out(features.labels(bars(spark, d)), "target_return_next", target_up_next=None)


_FOLD = "list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), lambda a, v: a + {alpha} * (v - a))"


@query(
    f"""WITH {BARS}, e AS (SELECT symbol, timestamp, close, {_FOLD.format(x='close', alpha='(2.0::DOUBLE / 13)')} AS ema_12, {_FOLD.format(x='close', alpha='(2.0::DOUBLE / 27)')} AS ema_26, close - lag(close) OVER ({_W}) AS delta FROM bars),
        m AS (SELECT *, {_FOLD.format(x='(ema_12 - ema_26)', alpha='(2.0::DOUBLE / 10)')} AS macd_signal FROM e),
        g AS (SELECT *, row_number() OVER ({_W}) AS n, {_FOLD.format(x='greatest(delta, 0)', alpha='(1.0::DOUBLE / 14)')} AS up, {_FOLD.format(x='greatest(-delta, 0)', alpha='(1.0::DOUBLE / 14)')} AS down FROM e WHERE delta IS NOT NULL)
        SELECT m.symbol, strftime(m.timestamp, '%Y-%m-%d') AS day, round(m.ema_12, 4) AS ema_12, round(m.ema_26, 4) AS ema_26, round(m.ema_12 - m.ema_26, 4) AS macd, round(m.macd_signal, 4) AS macd_signal,
               round(CASE WHEN n >= 14 AND down > 0 THEN 100 * up / (up + down) END, 4) AS rsi_14
        FROM m LEFT JOIN g ON m.symbol = g.symbol AND m.timestamp = g.timestamp"""
)
def recursive_indicators(spark, d):
    return _out(features.recursive(bars(spark, d).select("symbol", "timestamp", "close")), "ema_12", "ema_26", "macd", "macd_signal", "rsi_14", places=4)


@query(
    f"""WITH {QUOTES} SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, round(avg(ask_price - bid_price), 8) AS avg_spread, round(avg(ask_price - bid_price) / avg((ask_price + bid_price) / 2), 6) AS avg_spread_pct,
        round(avg(bid_size), 4) AS avg_bid_size, round(avg(ask_size), 4) AS avg_ask_size FROM quotes GROUP BY 1, 2"""
)
def quote_daily(spark, d):
    q = features.quote_daily(quotes(spark, d))
    return q.select("symbol", F.col("date").cast("string").alias("day"), F.round("avg_spread", 8).alias("avg_spread"), F.round("avg_spread_pct", 6).alias("avg_spread_pct"), F.round("avg_bid_size", 4).alias("avg_bid_size"), F.round("avg_ask_size", 4).alias("avg_ask_size"))


@query(f"WITH {TRADES} SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS ticks, round(sum(size), 2) AS volume, round(avg(price), 8) AS mean, round(stddev_samp(price), 8) AS std FROM trades GROUP BY 1, 2")
def trade_daily(spark, d):
    t = features.trade_daily(trades(spark, d))
    return t.select("symbol", F.col("date").cast("string").alias("day"), F.col("trade_tick_count").alias("ticks"), F.round("trade_tick_volume", 2).alias("volume"), F.round("trade_avg_price", 8).alias("mean"), F.round("trade_price_stddev", 8).alias("std"))


_MAPPED = "CASE substr(symbol, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'N' ELSE 'R' END"


@query(
    f"""WITH {_RETURNS}, {QUOTES}, {TRADES}, f AS (SELECT *, {_MAPPED} AS flag, {_rolling('avg', 'close', 20)} AS sma_20, lead(close) OVER ({_W}) / close - 1 AS t FROM r),
        q AS (SELECT symbol AS flag, CAST(timestamp AS DATE) AS date, avg(ask_price - bid_price) AS avg_spread FROM quotes GROUP BY 1, 2),
        x AS (SELECT symbol AS flag, CAST(timestamp AS DATE) AS date, count(*) AS ticks FROM trades GROUP BY 1, 2)
        SELECT symbol, {_DAY}, round(return_1d, 6) AS return_1d, round(sma_20, 4) AS sma_20, round(t, 6) AS target_return_next, round(avg_spread, 4) AS avg_spread, ticks AS trade_tick_count
        FROM f LEFT JOIN q ON f.flag = q.flag AND CAST(f.timestamp AS DATE) = q.date LEFT JOIN x ON f.flag = x.flag AND CAST(f.timestamp AS DATE) = x.date"""
)
def feature_table(spark, d):
    b = bars(spark, d)
    first = F.substring("symbol", 1, 1)
    flag = F.when(first == "1", "A").when(first == "2", "N").otherwise("R")
    built = features.daily_join(features.indicators(b).withColumn("own", F.col("symbol")).withColumn("symbol", flag), quotes(spark, d), trades(spark, d)).withColumn("symbol", F.col("own"))
    return _out(built, "return_1d", "target_return_next", sma_20=4, avg_spread=4, trade_tick_count=None)


@query(f"WITH {BARS} SELECT symbol, {_DAY}, row_number() OVER ({_W}) > floor(count(*) OVER (PARTITION BY symbol) * (1 - 0.2::DOUBLE)) AS is_test FROM bars")
def time_split(spark, d):
    return features.time_split(bars(spark, d)).select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "is_test")


@query(f"WITH {BARS}, s AS (SELECT symbol, floor((row_number() OVER ({_W}) - 1) * 4 / count(*) OVER (PARTITION BY symbol)) AS slice FROM bars) SELECT symbol, fold, slice = fold AS is_test, count(*) AS n FROM s JOIN (SELECT unnest([1, 2, 3]) AS fold) ON slice <= fold GROUP BY 1, 2, 3")
def walk_forward(spark, d):
    return features.walk_forward(bars(spark, d), 3).groupBy("symbol", "fold", "is_test").agg(F.count("*").alias("n"))


def predictions(spark, d):
    """Deterministic stand-in scores from the day of the month, so that the backtest can be checked."""
    return features.labels(bars(spark, d)).filter(F.col("target_return_next").isNotNull()).withColumns({"pred_proba_up": F.dayofmonth("timestamp") / 31.0, "target_return_next": F.col("target_return_next") / 1000, "pred_return": (F.dayofmonth("timestamp") - 15) / 10_000.0})


_PRED = f"{BARS}, p AS (SELECT symbol, timestamp, t / 1000 AS t, day(timestamp) / 31.0::DOUBLE AS proba, t > 0 AS up FROM (SELECT *, lead(close) OVER ({_W}) / close - 1 AS t FROM bars) WHERE t IS NOT NULL)"
_SIGNAL = f"{_PRED}, s AS (SELECT *, CAST(proba > 0.55 AS INTEGER) AS signal, abs(CAST(proba > 0.55 AS INTEGER) - coalesce(lag(CAST(proba > 0.55 AS INTEGER)) OVER ({_W}), 0)) AS change FROM p)"
_EQUITY = f"{_SIGNAL}, c AS (SELECT *, signal * t - change * 0.0005 AS sr FROM s), q AS (SELECT *, 100000 * product(1 + sr) OVER ({_W}) AS se, 100000 * product(1 + t) OVER ({_W}) AS be FROM c)"


@query(f"WITH {_SIGNAL} SELECT symbol, {_DAY}, signal, CAST(change AS INTEGER) AS position_change FROM s")
def signals(spark, d):
    return backtest.signals(predictions(spark, d)).select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "signal", "position_change")


@query(f"WITH {_EQUITY} SELECT symbol, {_DAY}, round(sr, 8) AS strategy_return, round(se, 2) AS strategy_equity, round(be, 2) AS buy_hold_equity FROM q")
def equity_curves(spark, d):
    return _out(backtest.equity(predictions(spark, d)), "strategy_return", places=8, strategy_equity=2, buy_hold_equity=2)


@query(
    f"""WITH {_EQUITY}, m AS (SELECT *, se / max(se) OVER ({_W}) - 1 AS down FROM q),
        a AS (SELECT symbol, count(*) AS n, arg_max(se, timestamp) / arg_min(se, timestamp) AS g, avg(sr) / stddev_samp(sr) * sqrt(252) AS sharpe, min(down) AS down, avg(CASE WHEN sr <> 0 THEN CAST(sr > 0 AS INTEGER) END) AS won FROM m GROUP BY 1)
        SELECT symbol, round((g - 1) * 100, 2) AS total_return_pct, round((pow(g, 252.0 / n) - 1) * 100, 2) AS cagr_pct, round(sharpe, 2) AS sharpe, round(down * 100, 2) AS max_drawdown_pct, round(won * 100, 2) AS win_rate_pct FROM a"""
)
def performance(spark, d):
    return backtest.performance(backtest.equity(predictions(spark, d)))


@query(f"WITH {_SIGNAL} SELECT symbol, count(*) AS n_rows, CAST(sum(change) AS BIGINT) AS n_trades, round(avg(signal) * 100, 4) AS pct_time_in_market FROM s GROUP BY 1 HAVING count(*) >= 10")
def trade_stats(spark, d):
    return backtest.trade_stats(backtest.signals(predictions(spark, d)))


@query(
    f"""WITH {_PRED}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY proba) + (count(*) OVER (PARTITION BY symbol, proba) - 1) / 2.0::DOUBLE AS place FROM p)
        SELECT symbol, count(*) AS n_test, round(avg(CAST((proba > 0.5) = up AS INTEGER)), 6) AS accuracy, round(avg(abs((day(timestamp) - 15) / 10000.0::DOUBLE - t)), 8) AS mae, round(avg(abs(t)), 8) AS naive_mae,
               round((sum(place) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2.0::DOUBLE) / (count(*) FILTER (up) * count(*) FILTER (NOT up)), 6) AS auc FROM r GROUP BY 1"""
)
def model_scores(spark, d):
    s = models.score(predictions(spark, d))
    return s.select("symbol", "n_test", *[F.round(c, n).alias(c) for c, n in (("accuracy", 6), ("mae", 8), ("naive_mae", 8), ("auc", 6))])


def _symbols(spark, d):
    return [r["symbol"] for r in table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct().orderBy("symbol").collect()]  # five priorities


@query()
def trained_models(spark, d):
    """Both models of every symbol, with the default numbers of trees, over the features of all bars."""
    return models.score(models.train(features.indicators(bars(spark, d)), _symbols(spark, d)))


@query()
def market_backtest(spark, d):
    """The market pipeline from landing to backtest, over all bars, quotes and trades, with trained models."""
    m = market_pipeline.Market(spark, scratch(spark, "market"))
    return market_pipeline.run_market(m, {"bars": bars(spark, d), "quotes": quotes(spark, d), "trades": trades(spark, d)}, _symbols(spark, d))
