"""The driver's tables and the shapes that queries derive from them: bars, quotes, trades, change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: the order priority is the symbol, the order's total the price."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").cast("timestamp").alias("timestamp")).agg(
        F.min_by(price, "o_orderkey").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


BARS = """
    bars AS (SELECT o_orderpriority AS symbol, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS timestamp, arg_min(o_totalprice, o_orderkey) AS open,
             max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
             FROM orders GROUP BY 1, 2)
"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))


TRADES = "trades AS (SELECT l_returnflag AS symbol, l_shipdate AS timestamp, l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem)"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (price * (1 - F.col("l_discount"))).alias("bid_price"),
        (price * (1 + F.col("l_tax"))).alias("ask_price"),
        F.col("l_quantity").alias("bid_size"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("ask_size"),
    )


QUOTES = """
    quotes AS (SELECT l_returnflag AS symbol, l_shipdate AS timestamp, l_extendedprice / l_quantity * (1 - l_discount) AS bid_price,
               l_extendedprice / l_quantity * (1 + l_tax) AS ask_price, l_quantity AS bid_size, l_quantity + l_linenumber AS ask_size FROM lineitem)
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: the user is the key, the event id the sequence, errors delete."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.when(F.col("event_id") % 7 != 0, F.round("value", 2)).alias("value"), F.get_json_object("props", "$.k").alias("k"))


CHANGES = """
    changes AS (SELECT user_id, event_id AS seq, event_type AS op, CASE WHEN event_id % 7 <> 0 THEN round(value, 2) END AS value,
                json_extract_string(props, '$.k') AS k FROM events)
"""


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned time, as streams need it."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
