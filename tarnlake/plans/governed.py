"""Masks, row filters, policies and access reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masks import mask_email, mask_partial, redact
from ..operators import governance
from . import query
from .data import table


def people(spark, d):
    """Customers with an address and their region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", "c_name", F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"), F.col("r_name").alias("region"), "c_acctbal")


_PEOPLE = "people AS (SELECT c_custkey, c_name, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' AS email, r_name AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_PEOPLE} SELECT c_custkey, CAST(NULL AS VARCHAR) AS email, c_acctbal FROM people")
def masked_view(spark, d):
    return governance.masked_view(people(spark, d).select("c_custkey", "email", "c_acctbal"), {"email": ["admin"], "c_acctbal": ["admin", "finance"]}, "finance")


@query(f"WITH {_PEOPLE} SELECT c_custkey, regexp_replace(email, '^[^@]*@', '***@') AS hidden, left(email, 1) || '***@' || split_part(email, '@', 2) AS led FROM people")
def mask_email_styles(spark, d):
    return people(spark, d).select("c_custkey", mask_email(F.col("email")).alias("hidden"), mask_email(F.col("email"), "lead").alias("led"))


@query("SELECT c_custkey, left(c_name, 2) || '***' AS head, '***' || right(c_name, 4) AS tail, '[REDACTED]' AS gone FROM customer")
def mask_parts(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", mask_partial(n, head=2).alias("head"), mask_partial(n, tail=4).alias("tail"), redact(n).alias("gone"))


@query(f"WITH {_PEOPLE} SELECT c_custkey, region FROM people WHERE region IN ('EUROPE', 'ASIA')")
def row_filter_access(spark, d):
    r = table(spark, d, "region")
    access = r.select(F.when(F.col("r_name").isin("EUROPE", "ASIA"), "eu@example").otherwise("us@example").alias("user_email"), F.col("r_name").alias("region"))
    return governance.row_filter_by_access(people(spark, d), access, "eu@example").select("c_custkey", "region")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING')")
def row_filter_attribute(spark, d):
    return governance.row_filter(table(spark, d, "customer"), "c_mktsegment", ["BUILDING"]).select("c_custkey", "c_mktsegment")


@query(f"WITH {_PEOPLE} SELECT c_custkey, '[REDACTED]' AS c_name, '[REDACTED]' AS email FROM people")
def tag_policy(spark, d):
    own = governance.tagged(people(spark, d).select("c_custkey", "c_name", "email"), {"c_name": "pii", "email": "pii"})
    return governance.apply_policy(own)


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 90) AS failures, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def access_report(spark, d):
    out = governance.access_report(table(spark, d, "events"), F.lit("2024-01-20").cast("timestamp_ntz"), failed=F.col("value") > 90)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
