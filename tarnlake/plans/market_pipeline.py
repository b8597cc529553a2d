"""The market pipeline on files: landing, silver with quarantine, gold features, predictions, backtest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, changes, features, models, monitoring, quality, relational
from ..sources import files
from ..sources.ingest import read_or_none
from ..streaming.sinks import BucketTable

#: By table: its rules and its keys.
TABLES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "bars": (quality.flag_bars, ["symbol", "timestamp"]),
    "quotes": (quality.flag_quotes, ["symbol", "timestamp"]),
    "trades": (quality.flag_trades, ["symbol", "timestamp"]),
}


@dataclass
class Market:
    """Folders of the layers below one root."""

    spark: SparkSession
    root: str
    buckets: int = 8

    def path(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def silver(self, name: str) -> BucketTable:
        return BucketTable(self.spark, self.path("silver", name), TABLES[name][1], self.buckets)

    def stage(self, name: str):
        return monitoring.timed_stage(self.spark, self.path("log", "runs"), name)


def land(m: Market, sources: Mapping[str, DataFrame], ts: str = "timestamp") -> None:
    """Append what is later than the latest row of each bronze table; all of it on the first run."""
    for name, src in sources.items():
        with m.stage(f"bronze_{name}"):
            files.land_bronze(files.incremental_since(src, read_or_none(m.spark, m.path("bronze", name)), ts), m.path("bronze", name), name)


def to_silver(m: Market, names: Iterable[str] = tuple(TABLES)) -> None:
    """Latest row of each key, rules, quarantine, merge. The same bronze gives the same silver again."""
    for name in names:
        rules, keys = TABLES[name]
        with m.stage(f"silver_{name}") as counts:
            bronze = m.spark.read.option("mergeSchema", True).parquet(m.path("bronze", name))
            flagged = rules(relational.dedup_latest(bronze, keys, "_ingested_at")).persist()
            try:
                rate = quality.quarantine_rate(flagged).first()
                good, bad = quality.split(flagged)
                bad.write.mode("overwrite").parquet(m.path("quarantine", name))
                table = m.silver(name)
                # the source is unique by now
                table.merge(good.drop("_ingested_at", "_source"), table.next_batch(), lambda old, rows: changes.merge(old, rows, keys, check=False))
                counts |= {"rows_in": rate["n_rows"], "rows_out": rate["n_rows"] - rate["n_bad"], "rows_quarantined": rate["n_bad"]}
            finally:
                flagged.unpersist()


def to_gold(m: Market) -> DataFrame:
    """The feature table, partitioned by symbol."""
    with m.stage("gold_features"):
        built = features.build_features(m.silver("bars").read(), m.silver("quotes").read(), m.silver("trades").read())
        files.write(built, m.path("gold", "features"), "overwrite", partition_by=["symbol"])
    return m.spark.read.parquet(m.path("gold", "features"))


def save_predictions(m: Market, pred: DataFrame) -> None:
    """Held-out predictions replace the last ones; the metrics of each run are kept."""
    files.write(pred, m.path("gold", "predictions"), "overwrite")
    kept = m.spark.read.parquet(m.path("gold", "predictions"))
    models.score(kept).withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(m.path("gold", "model_metrics"))


def run_market(m: Market, sources: Mapping[str, DataFrame], symbols: Iterable[str], **training) -> DataFrame:
    """All stages in order; the first failure stops the run and is in the log. Returns the backtest's metrics."""
    land(m, sources)
    to_silver(m)
    built = to_gold(m)
    with m.stage("models"):
        save_predictions(m, models.train(built, symbols, **training))
    with m.stage("backtest"):
        curves = backtest.equity(m.spark.read.parquet(m.path("gold", "predictions")))
        files.write(backtest.performance(curves).join(backtest.trade_stats(curves), "symbol"), m.path("gold", "backtest"), "overwrite")
    return m.spark.read.parquet(m.path("gold", "backtest"))


def catch_up(m: Market, sources: Mapping[str, DataFrame]) -> None:
    """New rows into bronze and silver; safe to run again."""
    land(m, sources)
    to_silver(m, sources)
