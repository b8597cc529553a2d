"""Quality rules, expectations and the layered pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring, quality, relational
from . import query
from .data import BARS, QUOTES, TRADES, bars, quotes, table, trades
from .medallion import medallion

_RULES = {"missing_key": "o_orderkey IS NULL OR o_custkey IS NULL", "non_positive_total": "total <= 0", "bad_status": "o_orderstatus NOT IN ('O', 'F', 'P')", "implausible_total": "total > 400000"}
_DIRTY = "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN -o_totalprice ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders"
_CASE = "CASE " + " ".join(f"WHEN {bad} THEN '{name}'" for name, bad in _RULES.items()) + " END"


def dirty_orders(spark, d):
    """Orders with known faults: by key, a missing customer, a negative total or an unknown status."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 17 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 13 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(k % 19 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderdate",
    )


@query(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, count(*) AS n_orders, round(sum(total), 2) AS revenue FROM (SELECT *, {_CASE} AS r FROM ({_DIRTY})) WHERE r IS NULL GROUP BY 1, 2")
def daily_revenue(spark, d):
    good, _ = quality.split(quality.flag(dirty_orders(spark, d), _RULES))
    return good.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus").agg(F.count("*").alias("n_orders"), F.round(F.sum("total"), 2).alias("revenue"))


@query(f"SELECT o_orderkey, {_CASE} AS _quality_reason FROM ({_DIRTY})")
def flagged_orders(spark, d):
    return quality.flag(dirty_orders(spark, d), _RULES).select("o_orderkey", quality.REASON)


@query(f"SELECT count(*) AS n_rows, count(r) AS n_bad, round(100.0 * count(r) / count(*), 4) AS rate_pct FROM (SELECT {_CASE} AS r FROM ({_DIRTY}))")
def quarantine_rate(spark, d):
    return quality.quarantine_rate(quality.flag(dirty_orders(spark, d), _RULES))


_BAR_CASE = """CASE WHEN symbol IS NULL OR timestamp IS NULL THEN 'missing_key' WHEN close <= 0 THEN 'non_positive_close' WHEN open <= 0 THEN 'non_positive_open' WHEN volume < 0 THEN 'negative_volume'
    WHEN high < low THEN 'high_lt_low' WHEN high < open THEN 'high_lt_open' WHEN high < close THEN 'high_lt_close' WHEN low > open THEN 'low_gt_open' WHEN low > close THEN 'low_gt_close'
    WHEN abs((close - before) / before) > 0.5 THEN 'implausible_return' END"""
_BAD_BARS = "SELECT symbol, timestamp, CASE WHEN day(timestamp) = 3 THEN -open ELSE open END AS open, CASE WHEN day(timestamp) = 7 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN day(timestamp) = 11 THEN -5 ELSE volume END AS volume FROM bars"


def bad_bars(spark, d):
    on = lambda k: F.dayofmonth("timestamp") == k
    return bars(spark, d).withColumns({"open": F.when(on(3), -F.col("open")).otherwise(F.col("open")), "high": F.when(on(7), F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(on(11), -5).otherwise(F.col("volume"))})


@query(f"WITH {BARS}, b AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS before FROM ({_BAD_BARS})) SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, {_BAR_CASE} AS _quality_reason FROM b")
def flagged_bars(spark, d):
    return quality.flag_bars(bad_bars(spark, d)).select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), quality.REASON)


@query(f"WITH {QUOTES} SELECT CASE WHEN bid > ask_price THEN 'crossed_quote' END AS reason, count(*) AS n FROM (SELECT *, CASE WHEN bid_size = 13 THEN ask_price * 1.01 ELSE bid_price END AS bid FROM quotes) GROUP BY 1")
def flagged_quotes(spark, d):
    q = quotes(spark, d).withColumn("bid_price", F.when(F.col("bid_size") == 13, F.col("ask_price") * 1.01).otherwise(F.col("bid_price")))
    return quality.flag_quotes(q).groupBy(F.col(quality.REASON).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {TRADES} SELECT CASE WHEN size = 20 THEN 'non_positive_price' WHEN size <= 0 THEN 'non_positive_size' END AS reason, count(*) AS n FROM trades GROUP BY 1")
def flagged_trades(spark, d):
    t = trades(spark, d).withColumn("price", F.when(F.col("size") == 20, -F.col("price")).otherwise(F.col("price")))
    return quality.flag_trades(t).groupBy(F.col(quality.REASON).alias("reason")).agg(F.count("*").alias("n"))


_EXPECT = {"positive": "total > 0", "has_customer": "o_custkey IS NOT NULL", "known_status": "o_orderstatus IN ('O', 'F', 'P')"}
_ALL = " AND ".join(f"coalesce({r}, false)" for r in _EXPECT.values())


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (coalesce({r}, false)) AS passed_records, count(*) FILTER (NOT coalesce({r}, false)) AS failed_records FROM ({_DIRTY})" for n, r in _EXPECT.items()))
def expectation_counts(spark, d):
    return quality.expect(dirty_orders(spark, d), _EXPECT)


@query(f"SELECT o_orderkey, total FROM ({_DIRTY}) WHERE {_ALL}")
def expect_all_or_drop(spark, d):
    return quality.expect_all_or_drop(dirty_orders(spark, d), _EXPECT).select("o_orderkey", "total")


@query(f"SELECT o_orderkey, concat_ws(',', {', '.join(f'''CASE WHEN NOT coalesce({r}, false) THEN '{n}' END''' for n, r in _EXPECT.items())}) AS broken_rules FROM ({_DIRTY}) WHERE NOT ({_ALL})")
def quarantined_orders(spark, d):
    return quality.quarantine(dirty_orders(spark, d), _EXPECT).select("o_orderkey", "broken_rules")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0")
def expect_or_fail_clean(spark, d):
    return quality.expect_or_fail(table(spark, d, "orders").filter("o_totalprice > 0"), "positive", "o_totalprice > 0").select("o_orderkey", "o_totalprice")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, sum(n) = count(*) AS is_unique FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def expect_unique(spark, d):
    return quality.expect_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 2)
       SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS n_missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS n_extra"""
)
def reconcile(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    b = c.filter("c_custkey % 10 <> 2").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 50 == 0, "X").otherwise(F.col("c_mktsegment")))
    return quality.reconcile(c.filter("c_custkey % 10 <> 1"), b)


@query(f"SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'NULL_O_CUSTKEY' END AS marker FROM ({_DIRTY})")
def null_marker(spark, d):
    return dirty_orders(spark, d).select("o_orderkey", quality.null_marker("o_custkey").alias("marker"))


@query("SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM orders GROUP BY 1")
def customer_summary(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))


@query(
    f"""WITH silver AS (SELECT o_orderkey, o_orderstatus, total, o_orderdate FROM (SELECT *, {_CASE} AS r FROM ({_DIRTY})) WHERE r IS NULL)
        SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, round(sum(total), 2) AS revenue FROM silver GROUP BY 1, 2"""
)
def medallion_gold(spark, d):
    return medallion(dirty_orders(spark, d), _RULES, keys=["o_orderkey"], order="o_orderdate")["gold"]


@query(f"SELECT rate_pct, 'rate_pct above 5.0: ' || rate_pct AS alert FROM (SELECT round(100.0 * count(r) / count(*), 4) AS rate_pct FROM (SELECT {_CASE} AS r FROM ({_DIRTY}))) WHERE rate_pct > 5")
def quarantine_alert(spark, d):
    return monitoring.alerts(quality.quarantine_rate(quality.flag(dirty_orders(spark, d), _RULES))).select("rate_pct", "alert")


@query("SELECT day, n, n_before, round((1 - n / n_before) * 100, 4) AS drop_pct FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, lag(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS n_before FROM events WHERE NOT (day(ts) % 5 = 0 AND event_id % 2 = 0) GROUP BY 1) WHERE (1 - n / n_before) * 100 > 20")
def volume_drop(spark, d):
    e = table(spark, d, "events").filter(~((F.dayofmonth("ts") % 5 == 0) & (F.col("event_id") % 2 == 0)))
    return monitoring.volume_drop(e, "ts", 20.0).withColumn("day", F.col("day").cast("string"))


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M') AS newest, max(ts) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 60 MINUTE AS is_stale FROM events")
def stale_events(spark, d):
    out = monitoring.stale(table(spark, d, "events"), "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 60)
    return out.withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm"))


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR ORDER BY value DESC, ts LIMIT 10")
def slowest(spark, d):
    return monitoring.slowest(table(spark, d, "events"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 48, 10, ts="ts", seconds="value").select("event_id", "value")


_LOG = "SELECT event_id, ts, 'flow' || (user_id % 5) AS flow_name, event_id % 9 AS dropped, event_id % 100 AS put FROM events"


def event_log(spark, d):
    """A pipeline event log in JSON, derived from the events."""
    e, name = table(spark, d, "events"), F.concat(F.lit("rule"), F.col("event_id") % 3)
    k = F.col("event_id")
    details = F.struct(
        F.struct(
            F.struct((k % 100).alias("num_output_rows")).alias("metrics"),
            F.struct((k % 9).alias("dropped_records"), F.array(F.struct(name.alias("name"), (k % 100).alias("passed_records"), (k % 9).alias("failed_records"))).alias("expectations")).alias("data_quality"),
        ).alias("flow_progress")
    )
    return e.select(F.col("ts").alias("timestamp"), F.concat(F.lit("flow"), F.col("user_id") % 5).alias("flow_name"), F.lit("flow_progress").alias("event_type"), F.to_json(details).alias("details"))


@query(f"SELECT flow_name, 'rule' || (event_id % 3) AS name, count(*) AS n, CAST(sum(dropped) AS BIGINT) AS failed FROM ({_LOG}) WHERE dropped > 0 GROUP BY 1, 2")
def expectation_log(spark, d):
    return monitoring.expectation_metrics(event_log(spark, d)).groupBy("flow_name", "name").agg(F.count("*").alias("n"), F.sum("failed_records").alias("failed"))


@query(f"SELECT flow_name, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(put) AS BIGINT) AS output_rows, CAST(sum(dropped) AS BIGINT) AS dropped_rows FROM ({_LOG}) GROUP BY 1, 2")
def flow_metrics(spark, d):
    return monitoring.flow_metrics(event_log(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {BARS} SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('month', timestamp) ORDER BY timestamp DESC) = 1")
def last_bar_of_month(spark, d):
    b = bars(spark, d).withColumn("month", F.date_trunc("month", "timestamp"))
    return relational.dedup_latest(b, ["symbol", "month"], "timestamp").select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "close")
