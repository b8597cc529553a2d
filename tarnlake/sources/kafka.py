"""Kafka-shaped records: decode, encode, connection options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

META = ["topic", "partition", "offset"]


def decode_kafka(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Key as text, the JSON value's fields, topic, partition and offset; broken JSON gives null fields."""
    data = F.from_json(F.col("value").cast("string"), schema)
    parsed = df.select(F.col("key").cast("string").alias("key"), data.alias("data"), *[c for c in META if c in df.columns])
    return parsed.select("key", "data.*", *[c for c in META if c in df.columns])


def encode_kafka(df: DataFrame, key: str) -> DataFrame:
    """Binary key and the whole row as JSON."""
    return df.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*df.columns)).cast("binary").alias("value"))


def kafka_options(servers: str, *, subscribe: str | None = None, pattern: str | None = None, assign: str | None = None, starting: str = "latest", max_per_trigger: int | None = None, fail_on_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source; exactly one of the three ways to name topics."""
    ways = {"subscribe": subscribe, "subscribePattern": pattern, "assign": assign}
    named = {k: v for k, v in ways.items() if v is not None}
    if len(named) != 1:
        raise ValueError("give exactly one of subscribe, pattern and assign")
    out = {"kafka.bootstrap.servers": servers, **named, "startingOffsets": starting, "failOnDataLoss": str(fail_on_loss).lower()}
    return out | ({"maxOffsetsPerTrigger": str(max_per_trigger)} if max_per_trigger else {})


def read_kafka(spark: SparkSession, servers: str, schema: StructType | str, *, stream: bool = True, **options) -> DataFrame:
    """The decoded records of topics, as a stream or as they are now; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream if stream else spark.read
    settings = kafka_options(servers, **options)
    if not stream and settings["startingOffsets"] == "latest":
        settings["startingOffsets"] = "earliest"
    return decode_kafka(reader.format("kafka").options(**settings).load(), schema)
