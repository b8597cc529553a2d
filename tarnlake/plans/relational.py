"""Projections, joins, aggregates, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import features, ordered, relational
from . import query
from .data import table


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 150000 AND (o_orderstatus = 'O' OR o_orderpriority LIKE '1%')")
def filter_orders(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_totalprice") > 150000) & ((F.col("o_orderstatus") == "O") | F.col("o_orderpriority").like("1%"))).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name IS NOT NULL")
def predicates_in_between(spark, d):
    c = table(spark, d, "customer")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000) & F.col("c_name").isNotNull()).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey AS id, p_brand, round(p_retailprice * 1.2, 2) AS gross FROM part")
def project_rename_drop(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id").drop("p_name", "p_type", "p_size")
    return p.withColumn("gross", F.round(F.col("p_retailprice") * 1.2, 2)).drop("p_retailprice")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band FROM orders")
def price_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", relational.band(F.col("o_totalprice"), [50000, 150000], ["low", "mid", "high"]).alias("band"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, 0) AS value, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'none') AS kind FROM events WHERE event_id % 11 <> 0")
def null_handling(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 11 != 0, 1).alias("must"))
    return e.na.fill({"value": 0.0, "kind": "none"}).na.drop(subset=["must"]).drop("must")


@query("SELECT c_custkey, CAST(try_cast(replace(c_name, 'Customer#', '') AS BIGINT) AS BIGINT) AS number, try_cast(c_mktsegment AS DOUBLE) AS nothing, CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS balance FROM customer")
def safe_casts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("")).alias("number"), F.col("c_mktsegment").alias("nothing"), F.col("c_acctbal").cast("decimal(10,2)").cast("double").alias("balance"))
    return relational.typed(c, {"number": "bigint", "nothing": "double"})


@query("SELECT c_custkey, c_nationkey AS nation, c_acctbal AS balance, c_acctbal > 0 AS positive FROM customer")
def struct_flatten(spark, d):
    nested = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).alias("s"))
    return nested.select("c_custkey", "s.*", (F.col("s.balance") > 0).alias("positive"))


@query("SELECT o_orderkey, round(o_totalprice * 1.2, 2) AS total_with_tax FROM orders WHERE o_totalprice > 0 AND o_custkey IS NOT NULL AND o_orderstatus = 'F'")
def transform_chain(spark, d):
    o = table(spark, d, "orders")
    return (
        o.transform(relational.filter_valid, "o_totalprice", ["o_orderkey", "o_custkey"])
        .filter(F.col("o_orderstatus") == "F")
        .transform(relational.add_total_with_tax, "o_totalprice", 0.2)
        .select("o_orderkey", "total_with_tax")
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def parameterised_sql(spark, d):
    text = "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice >= :least AND o_orderpriority = :priority GROUP BY 1"
    return relational.run_sql(spark, text, {"orders": table(spark, d, "orders")}, least=100000, priority="1-URGENT")


@query("WITH per AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT count(*) AS n, round(max(s), 2) AS top FROM per WHERE s > (SELECT avg(s) FROM per)")
def cte_above_average(spark, d):
    text = "WITH per AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY 1) SELECT count(*) AS n, round(max(s), 2) AS top FROM per WHERE s > (SELECT avg(s) FROM per)"
    return relational.run_sql(spark, text, {"orders": table(spark, d, "orders")})


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def sql_by_path(spark, d):
    return spark.sql(f"SELECT p_brand, count(*) AS n FROM parquet.`{d}/part.parquet` GROUP BY 1")


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def inner_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.filter("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def left_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


_SIDES = "(SELECT * FROM customer WHERE c_acctbal > 0) c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey"


def _sides(spark, d):
    """Customers and large orders: either side has rows without a partner."""
    return table(spark, d, "customer").filter("c_acctbal > 0"), table(spark, d, "orders").filter("o_totalprice > 300000")


@query(f"SELECT c_custkey, o_orderkey FROM {_SIDES.format('FULL')}")
def full_join(spark, d):
    c, o = _sides(spark, d)
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "full").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_SIDES.format('RIGHT')}")
def right_join(spark, d):
    c, o = _sides(spark, d)
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


_EXISTS = "SELECT c_custkey, c_mktsegment FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 AND o.o_totalprice > 20 * c.c_acctbal)"


@query(_EXISTS.format(customer="customer", orders="orders"))
def exists_subquery(spark, d):
    """A correlated subquery in SQL, with a condition on both sides."""
    return relational.run_sql(spark, _EXISTS, {name: table(spark, d, name) for name in ("customer", "orders")})


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_join(spark, d):
    """Spark broadcasts the dimension where its size is within the session's threshold; a test looks at the plan."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(
    """SELECT n_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
)
def star_revenue(spark, d):
    dims = [
        (table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")),
        (table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")),
        (table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")),
        (table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")),
    ]
    return relational.star_revenue(table(spark, d, "lineitem"), dims, ["n_name", "p_brand"], F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("SELECT p_brand, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS k FROM lineitem) JOIN part ON p_partkey = k GROUP BY 1")
def salted_join(spark, d):
    big = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_partkey")).alias("k"), "l_orderkey", "l_linenumber")
    small = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    # a third of the rows have one key, which the sketch finds at any size
    return relational.salted_join(big, small, "k", 16, share=0.05).groupBy("p_brand").agg(F.count("*").alias("n"))


_CLICKS = "clicks AS (SELECT event_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click'), buys AS (SELECT event_id AS buy_id, user_id, ts AS buy_ts FROM events WHERE event_type = 'purchase')"


def _clicks(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("click_ts")), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"))


@query(f"WITH {_CLICKS} SELECT event_id, buy_id FROM clicks c JOIN buys b ON c.user_id = b.user_id AND buy_ts BETWEEN click_ts AND click_ts + INTERVAL 1 HOUR")
def interval_join(spark, d):
    clicks, buys = _clicks(spark, d)
    return relational.interval_join(clicks, buys, "user_id", "click_ts", "buy_ts", "0 SECONDS", "1 HOUR").select("event_id", "buy_id")


@query(f"WITH {_CLICKS} SELECT event_id, buy_id, buy_ts IS NOT NULL AS converted FROM clicks c LEFT JOIN buys b ON c.user_id = b.user_id AND buy_ts BETWEEN click_ts AND click_ts + INTERVAL 1 HOUR")
def attribution(spark, d):
    clicks, buys = _clicks(spark, d)
    return relational.attribution(clicks, buys, "user_id", "click_ts", "buy_ts", "1 HOUR").select("event_id", "buy_id", "converted")


@query("SELECT r_name, count(*) AS n FROM nation n JOIN region r ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 6 GROUP BY 1")
def theta_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_nationkey").between(F.col("r_regionkey") * 5, F.col("r_regionkey") * 5 + 6)).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_custkey IS NULL AS missing_reference FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def check_reference(spark, d):
    dim = table(spark, d, "customer").filter("c_custkey % 10 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return relational.check_reference(table(spark, d, "orders"), dim, "o_custkey").select("o_orderkey", "missing_reference")


# aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY 1, 2")
def grouped_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most")
    )


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1, 2")
def monthly_buyers(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.countDistinct("o_custkey").alias("buyers"))


@query("SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS std FROM part GROUP BY 1")
def price_stddev(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 4).alias("std"))


@query("SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS balance, max(c_custkey) AS last_key FROM customer GROUP BY 1")
def dict_aggregate(spark, d):
    out = table(spark, d, "customer").groupBy("c_mktsegment").agg({"c_acctbal": "sum", "c_custkey": "max"})
    return out.select(F.col("c_mktsegment").alias("segment"), F.round("sum(c_acctbal)", 2).alias("balance"), F.col("max(c_custkey)").alias("last_key"))


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def conditional_having(spark, d):
    out = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"), F.count("*").alias("n"))
    return out.filter("n > 12")


@query("SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 2) AS click, round(sum(value) FILTER (event_type = 'view'), 2) AS view, round(sum(value) FILTER (event_type = 'purchase'), 2) AS purchase FROM events GROUP BY 1")
def pivot_events(spark, d):
    out = relational.pivot(table(spark, d, "events"), ["user_id"], "event_type", "value", ["click", "view", "purchase"])
    return out.select("user_id", *[F.round(c, 2).alias(c) for c in ("click", "view", "purchase")])


@query("SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR metric IN (l_discount, l_tax))")
def unpivot_rates(spark, d):
    return relational.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(count(DISTINCT n_name) AS BIGINT) AS n FROM nation GROUP BY 1")
def collect_names(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.size(F.collect_set("n_name")).cast("long").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def first_last(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("SELECT CAST(l_orderkey % 16 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_counts(spark, d):
    return relational.bucket_counts(table(spark, d, "lineitem"), "l_orderkey", 16)


@query("SELECT count(*) AS n_keys, max(n) AS max_rows, CAST(median(n) AS DOUBLE) AS median_rows, round(max(n) / median(n), 4) AS ratio FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def skew_report(spark, d):
    return relational.skew(table(spark, d, "events"), ["user_id"])


# windows


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_two_orders(spark, d):
    return relational.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, round(value - lag(value) OVER w, 4) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("delta"))


@query(
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS last_seven, round(avg(value) OVER (PARTITION BY user_id), 4) AS mean FROM events"""
)
def running_totals_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(
        "event_id",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.sum("value").over(w.rowsBetween(-6, 0)), 2).alias("last_seven"),
        F.round(F.avg("value").over(Window.partitionBy("user_id")), 4).alias("mean"),
    )


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE)) AS n_to_day FROM orders")
def running_peers(spark, d):
    return relational.running_count(table(spark, d, "orders"), ["o_orderstatus"], F.to_date("o_orderdate"), "n_to_day").select("o_orderkey", "n_to_day")


@query("SELECT y, n, CAST(sum(n) OVER (ORDER BY y) AS BIGINT) AS total FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1)")
def global_order(spark, d):
    """One task orders the years, of which there are few: aggregate before a window without partitions."""
    yearly = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return yearly.withColumn("total", F.sum("n").over(Window.orderBy("y")))


@query("SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, count(*) AS n FROM (SELECT * FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) = 1) GROUP BY 1, 2")
def latest_ties(spark, d):
    kept = relational.dedup_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ties=True)
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("l_shipdate"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1")
def latest_per_key(spark, d):
    kept = relational.dedup_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_extendedprice"])
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    """WITH r AS (SELECT user_id, event_id, 1 + (value - 50) / 10000 AS g FROM events),
       e AS (SELECT user_id, event_id, product(g) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS equity FROM r)
       SELECT event_id, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM e"""
)
def equity_drawdown(spark, d):
    """By blocks of the order, so that a user with most of the events is many tasks."""
    grown = table(spark, d, "events").select("user_id", "event_id", (1 + (F.col("value") - 50) / 10000).alias("growth"))
    out = ordered.drawdowns(grown, ["user_id"], "event_id", "growth", blocks=8)
    return out.select("event_id", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@query(
    """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS quantity, max(l_extendedprice) OVER w AS dearest, row_number() OVER w AS n
       FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)"""
)
def running_over_all(spark, d):
    """A window over all rows without partitions, at row level: one series, many tasks."""
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    rows = table(spark, d, "lineitem").select("l_orderkey", *tie)
    total = ordered.running(rows, [], "l_orderkey", {"quantity": ("sum", "l_quantity"), "dearest": ("max", "l_extendedprice"), "n": ("count", "l_orderkey")}, tie_break=tie, blocks=16)
    return total.select("l_orderkey", "l_linenumber", "quantity", "dearest", "n")


@query(
    """SELECT o_orderkey, sum(CAST(o_custkey AS BIGINT)) OVER w AS keys, min(o_totalprice) OVER w AS cheapest
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"""
)
def running_by_status(spark, d):
    """Three keys hold all rows, and each is as many tasks as there are blocks."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.col("o_custkey").cast("long").alias("o_custkey"), "o_totalprice")
    out = ordered.running(rows, ["o_orderstatus"], "o_orderdate", {"keys": ("sum", "o_custkey"), "cheapest": ("min", "o_totalprice")}, tie_break=["o_orderkey"], blocks=16)
    return out.select("o_orderkey", "keys", "cheapest")


# sorting, limits, sets


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_customers(spark, d):
    return relational.top_groups(table(spark, d, "orders"), "o_custkey", 20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(50)


@query("SELECT 'customer' AS layer, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def layer_counts(spark, d):
    return relational.layer_counts({n: table(spark, d, n) for n in ("customer", "orders", "lineitem")})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_flags(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicate_keys(spark, d):
    return table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


# scalar functions


@query(
    """SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, trim('  ' || c_name || ' ') AS t, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 3, 4) AS s,
       concat_ws('-', c_name, c_mktsegment) AS w, split_part(c_name, '#', 2) AS p, left(c_name, 2) AS a, right(c_name, 3) AS z FROM customer"""
)
def string_functions(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("u"), F.lower(n).alias("l"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.length(n).cast("long").alias("n"), F.substring(n, 3, 4).alias("s"),
        F.concat_ws("-", n, F.col("c_mktsegment")).alias("w"), F.split(n, "#")[1].alias("p"), F.left(n, F.lit(2)).alias("a"), F.right(n, F.lit(3)).alias("z"),
    )


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part")
def regex_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y/%m/%d') AS text, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d,
       CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS since, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM orders"""
)
def date_functions(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_date(F.date_format(t, "yyyy-MM-dd"), "yyyy-MM-dd").cast("string").alias("day"), F.date_format(t, "yyyy/MM/dd").alias("text"), F.year(t).cast("long").alias("y"), F.month(t).cast("long").alias("m"), F.dayofmonth(t).cast("long").alias("d"),
        F.datediff(F.to_date(t), F.lit("1992-01-01").cast("date")).cast("long").alias("since"), F.to_date(t + F.expr("INTERVAL 3 DAYS")).cast("string").alias("later"),
    )


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def time_parts(spark, d):
    return table(spark, d, "events").select("event_id", F.hour("ts").cast("long").alias("h"), F.minute("ts").cast("long").alias("mi"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query("SELECT event_id, floor(value) AS f, ceil(value) AS c, round(abs(50 - value), 4) AS a, CAST(event_id % 7 AS BIGINT) AS m, round(ln(value + 1), 6) AS l, round(sqrt(value), 6) AS s FROM events WHERE value >= 0")
def math_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").filter(v >= 0).select(
        "event_id", F.floor(v).cast("double").alias("f"), F.ceil(v).cast("double").alias("c"), F.round(F.abs(50 - v), 4).alias("a"), (F.col("event_id") % 7).alias("m"), F.round(F.log(v + 1), 6).alias("l"), F.round(F.sqrt(v), 6).alias("s")
    )


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, list_contains(embedding, embedding[1]) AS has_first, CAST(len([x for x in embedding if x > 0]) AS BIGINT) AS positives, len([x for x in embedding if x > 0.9]) > 0 AS any_large FROM embeddings")
def array_functions(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("n"), F.array_contains(e, e[0]).alias("has_first"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positives"), F.exists(e, lambda x: x > 0.9).alias("any_large")
    )


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def explode_words(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS by_path FROM events")
def json_functions(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:string>")["k"].alias("k"), F.get_json_object("props", "$.k").alias("by_path"))


@query("SELECT c_custkey, c_mktsegment <> 'BUILDING' AND c_nationkey > 9 AS changed FROM customer")
def row_hash(spark, d):
    """Rows whose content hash differs from that of the same row in a later state."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    later = c.withColumn("c_mktsegment", F.when(F.col("c_nationkey") > 9, "BUILDING").otherwise(F.col("c_mktsegment")))
    h = F.sha2(F.to_json(F.struct("c_name", "c_mktsegment", "c_nationkey")), 256).alias("h")
    met = c.select("c_custkey", h).join(later.select("c_custkey", h.alias("h_later")), "c_custkey")
    return met.select("c_custkey", (F.col("h") != F.col("h_later")).alias("changed"))


@query("SELECT event_id, CAST(json_extract_string(j, '$.a.list[1].k') AS BIGINT) AS k, json_extract_string(j, '$.a.kind') AS kind FROM (SELECT event_id, json_object('a', json_object('kind', event_type, 'list', json_array(0, json_object('k', user_id)))) AS j FROM events)")
def json_paths(spark, d):
    """Paths into nested objects and arrays."""
    inner = F.struct(F.col("event_type").alias("kind"), F.array(F.struct(F.lit(0).cast("long").alias("k")), F.struct(F.col("user_id").cast("long").alias("k"))).alias("list"))
    j = table(spark, d, "events").select("event_id", F.to_json(F.struct(inner.alias("a"))).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.a.list[1].k").cast("long").alias("k"), F.get_json_object("j", "$.a.kind").alias("kind"))


@query("SELECT event_id, 'ev' || event_type AS kind, true AS has FROM events")
def map_functions(spark, d):
    m = F.create_map(F.lit("kind"), F.concat(F.lit("ev"), F.col("event_type")), F.lit("k"), F.col("props"))
    return table(spark, d, "events").select("event_id", m.getItem("kind").alias("kind"), (F.size(F.map_keys(m)) == F.size(F.map_values(m))).alias("has"))


@query()
def session_functions(spark, d):
    return table(spark, d, "region").select("r_name", F.current_date().alias("today"), F.current_timestamp().alias("now"), F.current_user().alias("me"), F.current_catalog().alias("catalog"), F.current_schema().alias("in_schema"))


# user functions

_CLASS = "CASE WHEN o_totalprice IS NULL THEN 'UNKNOWN' WHEN o_totalprice < 50000 THEN 'LOW' WHEN o_totalprice < 150000 THEN 'MEDIUM' ELSE 'HIGH' END"


@query(f"SELECT o_orderkey, {_CLASS} AS by_python, {_CLASS} AS by_pandas, {_CLASS} AS by_sql FROM orders")
def user_functions(spark, d):
    udfs.register(spark)
    return table(spark, d, "orders").select("o_orderkey", F.expr("classify_amount(o_totalprice)").alias("by_python"), udfs.amount_band_pandas("o_totalprice").alias("by_pandas"), F.expr("amount_band_sql(o_totalprice)").alias("by_sql"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z_segment FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def zscores(spark, d):
    out = features.zscore(features.zscore(table(spark, d, "customer"), "c_acctbal", out="z"), "c_acctbal", ["c_mktsegment"], out="z_segment")
    return out.select("c_custkey", F.round("z", 6).alias("z"), F.round("z_segment", 6).alias("z_segment"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rank_in_group FROM customer")
def grouped_map_rank(spark, d):
    return udfs.add_rank(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey").select("c_custkey", "rank_in_group")


@query("SELECT s_suppkey, true AS numbered FROM supplier")
def batch_rows(spark, d):
    """The numbers depend on the batches; that each row has one doesn't."""
    out = udfs.number_batches(table(spark, d, "supplier").select("s_suppkey"))
    return out.select("s_suppkey", (F.col("row_in_batch") >= 0).alias("numbered"))
