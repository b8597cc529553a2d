"""Windows, stream runs over the event table, sources and layout jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cdc, changes, layout
from ..sources import files, ingest, kafka
from ..sources.scratch import scratch
from ..streaming import sinks, state, windows
from . import declared, query
from .data import CHANGES, stamped, table
from .data import changes as change_events

_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _aggs():
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}


def _text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


_HOURLY = f"SELECT {_T.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS window_start, {_T.format('time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR')} AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3"


@query(_HOURLY)
def tumbling_windows(spark, d):
    return _text(windows.tumbling(stamped(spark, d), "ts", "1 hour", ["event_type"], _aggs()))


@query(
    f"""SELECT {_T.format('s')} AS window_start, {_T.format('s + INTERVAL 1 HOUR')} AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total
        FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2, 3"""
)
def sliding_windows(spark, d):
    return _text(windows.sliding(stamped(spark, d), "ts", "1 hour", "30 minutes", ["event_type"], _aggs()))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, {_T.format('min(ts)')} AS window_start, {_T.format('max(ts) + INTERVAL 30 MINUTE')} AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    return _text(windows.sessions(stamped(spark, d), "ts", "30 minutes", ["user_id"], _aggs()))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def keyed_totals(spark, d):
    return windows.running_totals(stamped(spark, d), ["user_id"], _aggs())


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_events(spark, d):
    return windows.dedup_stream(stamped(spark, d), ["user_id", "event_type"], "ts", "10 minutes").select("user_id", "event_type")


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def enriched_events(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return windows.enrich(stamped(spark, d), dim, "user_id").select("event_id", "c_mktsegment")


@query("WITH b AS (SELECT *, event_id % 4 AS b FROM events), m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY b) SELECT event_id FROM b JOIN m USING (b) WHERE ts < mark - INTERVAL 10 MINUTE")
def late_events(spark, d):
    return windows.late_rows(stamped(spark, d), "ts", "10 MINUTES", F.col("event_id") % 4).select("event_id")


def _stream(spark, d):
    rows = table(spark, d, "events")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT * FROM ({_HOURLY}) WHERE CAST(window_end AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling(spark, d):
    """A real stream, in append mode: windows come out once the watermark has passed them."""
    to = scratch(spark, "stream-tumbling")
    sinks.run_to_end(windows.tumbling(_stream(spark, d), "ts", "1 hour", ["event_type"], _aggs(), "10 minutes"), sink=f"{to}/out", checkpoint=f"{to}/checkpoint")
    return _text(spark.read.parquet(f"{to}/out"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    to = scratch(spark, "stream-dedup")
    sinks.run_to_end(windows.dedup_stream(_stream(spark, d), ["event_id"], "ts", "10 minutes").select("event_id"), sink=f"{to}/out", checkpoint=f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/out")


@query(
    """SELECT event_id, buy_id FROM (SELECT event_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click') c
       JOIN (SELECT event_id AS buy_id, user_id, ts AS buy_ts FROM events WHERE event_type = 'purchase') b ON c.user_id = b.user_id AND buy_ts BETWEEN click_ts AND click_ts + INTERVAL 1 HOUR"""
)
def stream_join(spark, d):
    to = scratch(spark, "stream-join")
    e = _stream(spark, d)
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("click_ts"))
    buys = _stream(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"))
    joined = windows.stream_interval_join(clicks, buys, "user_id", "click_ts", "buy_ts", "1 HOUR").select("event_id", "buy_id")
    sinks.run_to_end(joined, sink=f"{to}/out", checkpoint=f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/out")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def stream_merge(spark, d):
    """foreachBatch into a table by buckets: the latest event of each user."""
    to = scratch(spark, "stream-merge")
    out = sinks.BucketTable(spark, f"{to}/table", ["user_id"], buckets=8)
    rows = _stream(spark, d).select("user_id", "event_id", "event_type", "ts")
    rows.writeStream.foreachBatch(sinks.merge_batch(out, "ts")).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.read().select("user_id", "event_id", "event_type")


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT CAST(user_id AS VARCHAR) AS key, {_T.format('min(ts)')} AS started, {_T.format('max(ts)')} AS last_seen, count(*) AS n_events FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, d):
    """Custom state: bounds and numbers of events of all ended and still active sessions."""
    to = scratch(spark, "stream-sessions")
    with state.state_store(spark):
        sinks.run_to_end(state.session_state(_stream(spark, d), "user_id", "ts", 3600), sink=f"{to}/out", checkpoint=f"{to}/checkpoint")
    out = spark.read.parquet(f"{to}/out")
    last = out.groupBy("key", "started").agg(F.max("n_events").alias("n_events"), F.max("last_seen").alias("last_seen"))
    return last.select("key", "n_events", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "last_seen")])


@query(f"WITH {CHANGES} SELECT user_id, seq, value, k FROM changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND op <> 'error'")
def stream_cdc(spark, d):
    """Change events in many batches, in no order, into a state by buckets that remembers deletes."""
    to = scratch(spark, "stream-cdc")
    change_events(spark, d).repartition(4, "seq").write.parquet(f"{to}/feed")
    rows = spark.readStream.schema(spark.read.parquet(f"{to}/feed").schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/feed")
    state = sinks.BucketTable(spark, f"{to}/state", ["user_id"], buckets=4)
    step = sinks.cdc_batch(state, ["seq"], deletes="op = 'error'")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return cdc.current_rows(state.read(), ["user_id"], ["user_id", "seq", "value", "k"])


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_enriched(spark, d):
    """A stream joined to a table."""
    to = scratch(spark, "stream-enriched")
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    sinks.run_to_end(windows.enrich(_stream(spark, d), dim, "user_id").select("event_id", "c_mktsegment"), sink=f"{to}/out", checkpoint=f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/out")


@query("SELECT user_id, count(*) AS n_events FROM events GROUP BY 1")
def stream_updates(spark, d):
    """Output mode update: each batch gives the totals that changed, which replace the earlier ones."""
    to = scratch(spark, "stream-updates")
    out = sinks.BucketTable(spark, f"{to}/table", ["user_id"], buckets=8)
    totals = windows.running_totals(_stream(spark, d), ["user_id"], {"n_events": F.count("*")})
    totals.writeStream.outputMode("update").foreachBatch(sinks.merge_batch(out, "n_events")).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.read()


@query("SELECT c_custkey, CASE WHEN c_nationkey > 9 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 0")
def stream_feed(spark, d):
    """A change feed read as a stream and applied to a table that holds the old state."""
    to = scratch(spark, "stream-feed")
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    new = old.filter("c_acctbal > 0").withColumn("c_mktsegment", F.when(F.col("c_nationkey") > 9, "X").otherwise(F.col("c_mktsegment")))
    changes.change_feed(old, new, ["c_custkey"], 1).write.parquet(f"{to}/feed")
    out = sinks.BucketTable(spark, f"{to}/table", ["c_custkey"], buckets=8)
    out.merge(old, 0, lambda _, rows: rows)
    feed = spark.readStream.schema(spark.read.parquet(f"{to}/feed").schema).parquet(f"{to}/feed")
    step = sinks.feed_batch(out)
    feed.writeStream.foreachBatch(lambda batch, k: step(batch, k + 1)).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.read().select("c_custkey", "c_mktsegment")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 20 GROUP BY 1")
def declared_tables(spark, d):
    """Declared tables in their order: a stream into bronze, rules into silver, totals into gold."""
    layer = declared.run_tables(
        spark,
        scratch(spark, "declared"),
        [
            declared.Declared("bronze", lambda _: _stream(spark, d)),
            declared.Declared("silver", lambda layer: layer.stream("bronze"), warn={"known": "user_id IS NOT NULL"}, drop={"large": "value > 20"}),
            declared.Declared("gold", lambda layer: layer.read("silver").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))),
        ],
    )
    return layer.read("gold")


# sources


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'events' AS topic FROM events")
def kafka_decode(spark, d):
    records = table(spark, d, "events").select(F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.lit("events").alias("topic"))
    return kafka.decode_kafka(records, "k string").select(F.col("key").cast("long").alias("event_id"), "k", "topic")


@query("SELECT event_id, event_type FROM events")
def kafka_round_trip(spark, d):
    sent = kafka.encode_kafka(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return kafka.decode_kafka(sent, "event_id long, event_type string").select("event_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id < 7000)")
def incremental_pull(spark, d):
    e = table(spark, d, "events")
    return files.incremental_since(e, e.filter("event_id < 7000"), "ts").select("event_id", "ts")


@query("SELECT event_id, event_type, 'events' AS _source, true AS stamped FROM events")
def landed_rows(spark, d):
    return files.landed(table(spark, d, "events"), "events").select("event_id", "event_type", "_source", F.col("_ingested_at").isNotNull().alias("stamped"))


@query("SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM events")
def file_stream_ingest(spark, d):
    """Files of a folder, each taken in once; a second run finds nothing new."""
    to = scratch(spark, "ingest")
    schema = table(spark, d, "events").schema
    for _ in range(2):
        ingest.ingest_files(spark, f"{d}/event[s].parquet", "parquet", f"{to}/out", f"{to}/checkpoint", schema)
    return spark.read.parquet(f"{to}/out").agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_events"))


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys FROM customer")
def copy_ledger(spark, d):
    to = scratch(spark, "copy")
    for _ in range(2):
        ingest.copy_into(spark, f"{d}/customer.parquet", f"{to}/t", "parquet", schema=table(spark, d, "customer").schema)  # the second call finds nothing new
    return spark.read.parquet(f"{to}/t").agg(F.count("*").alias("n_rows"), F.countDistinct("c_custkey").alias("n_keys"))


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN round(value, 2) END AS value FROM events")
def evolving_stream(spark, d):
    """JSON files, of which later ones have one more column: the stream stops, and goes on with the wider schema."""
    to = scratch(spark, "evolving")
    e = table(spark, d, "events").withColumn("value", F.round("value", 2))
    e.filter("event_id % 2 = 0").select("event_id", "event_type").write.json(f"{to}/in")
    run = lambda: ingest.stream_evolving(spark, f"{to}/in", "json", f"{to}/out", f"{to}/checkpoint", f"{to}/schema", hints="event_id long, event_type string")
    run()
    e.filter("event_id % 2 = 1").select("event_id", "event_type", "value").write.mode("append").json(f"{to}/in")
    try:
        run()
    except ingest.SchemaChanged:
        run()
    return spark.read.option("mergeSchema", True).parquet(f"{to}/out").select("event_id", "event_type", "value")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN '{\"extra\":\"x\"}' END AS _rescued_data FROM events")
def rescued_fields(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    made = e.withColumn("json", F.to_json(F.struct("k", F.when(F.col("event_id") % 3 == 0, "x").alias("extra"))))
    return ingest.with_rescued(made.select("event_id", "json"), "json", "k long").select("event_id", "k", ingest.RESCUED)


# layout


@query("SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity, true AS narrow FROM lineitem")
def zorder_rewrite(spark, d):
    """The rows after a Z-order rewrite are the rows before it, and files span less of both columns."""
    to = scratch(spark, "zorder")
    layout.zorder(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey", "l_partkey"], 8, bits=6).write.parquet(to)
    rows, span = spark.read.parquet(to), lambda c: F.max(c) - F.min(c)
    by = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(span("l_orderkey").alias("o"), span("l_partkey").alias("p")).agg(F.avg("o").alias("o"), F.avg("p").alias("p"))
    whole = rows.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"), span("l_orderkey").alias("all_o"), span("l_partkey").alias("all_p"))
    return whole.crossJoin(F.broadcast(by)).select("n_rows", "quantity", (F.col("o") / F.col("all_o") * F.col("p") / F.col("all_p") < 0.5).alias("narrow"))  # one row each


@query("SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, o_orderstatus <> 'F' AS one_file FROM orders GROUP BY 1")
def compacted(spark, d):
    """Small files of the chosen partitions become one each; the other partition keeps its files, and all keep their rows."""
    to = scratch(spark, "compact")
    layout.cluster(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"), ["o_orderdate"], 16).write.partitionBy("o_orderstatus").parquet(to)
    layout.compact(spark, to, where="o_orderstatus <> 'F'")
    rows = spark.read.parquet(to).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("_metadata.file_path").alias("n_files"))
    return rows.select("o_orderstatus", "n_rows", "total", (F.col("n_files") == 1).alias("one_file"))


@query("SELECT o_custkey % 8 AS bucket, count(*) AS n, 0 AS n_unsorted FROM orders GROUP BY 1")
def sorted_partitions(spark, d):
    """Rows by customer, sorted within each partition, which the order they are read in shows."""
    own = table(spark, d, "orders").repartition(8, "o_custkey").sortWithinPartitions("o_orderkey")
    placed = own.select("o_custkey", "o_orderkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("part").orderBy("at")
    wrong = placed.withColumn("unsorted", F.coalesce(F.lag("o_orderkey").over(w) > F.col("o_orderkey"), F.lit(False)))
    return wrong.groupBy(F.pmod("o_custkey", F.lit(8)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("unsorted").cast("int").alias("n_unsorted"))
