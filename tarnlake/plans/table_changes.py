"""Updates, merges, change data capture, slowly changing dimensions, change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cdc, changes, ordered, relational
from . import query
from .data import CHANGES, table
from .data import changes as change_events


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(spark, d):
    return changes.update(_customers(spark, d), "c_acctbal < 0", {"c_mktsegment": F.lit("DEBT"), "c_acctbal": F.lit(0.0)})


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000")
def delete_rows(spark, d):
    return changes.delete(_customers(spark, d), "c_acctbal < 1000").select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def purge_old(spark, d):
    return changes.purge(table(spark, d, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey")


_SRC = "src AS (SELECT c_custkey + 700 AS c_custkey, 'NEW' AS c_mktsegment, round(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def _source(spark, d):
    c = _customers(spark, d).filter("c_custkey % 2 = 0")
    return c.select((F.col("c_custkey") + 700).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))


@query(f"WITH {_SRC} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM customer t FULL JOIN src s ON t.c_custkey = s.c_custkey")
def merge_upsert(spark, d):
    return changes.merge(_customers(spark, d), _source(spark, d), ["c_custkey"])


@query(f"WITH {_SRC} SELECT t.c_custkey, t.c_mktsegment, CASE WHEN s.c_acctbal > t.c_acctbal THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM customer t LEFT JOIN src s ON t.c_custkey = s.c_custkey")
def merge_conditional(spark, d):
    return changes.merge(_customers(spark, d), _source(spark, d), ["c_custkey"], update={"c_acctbal": "s.c_acctbal"}, update_if="s.c_acctbal > t.c_acctbal", insert=False)


@query(f"WITH {_SRC} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM customer t FULL JOIN src s ON t.c_custkey = s.c_custkey WHERE NOT coalesce(s.c_acctbal < 500, false)")
def merge_delete(spark, d):
    return changes.merge(_customers(spark, d), _source(spark, d), ["c_custkey"], delete_if="s.c_acctbal < 500").select("c_custkey", "c_acctbal")


@query(f"WITH {_SRC} SELECT c_custkey, c_mktsegment, c_acctbal FROM src")
def merge_full_sync(spark, d):
    return changes.merge(_customers(spark, d), _source(spark, d), ["c_custkey"], delete_missing=True)


@query(f"WITH {_SRC} SELECT c_custkey, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT * FROM src WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_only_merge(spark, d):
    return changes.insert_new(_customers(spark, d), _source(spark, d), ["c_custkey"])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def merge_additive(spark, d):
    e = table(spark, d, "events")
    halves = [e.filter(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count("*").alias("n")) for k in (0, 1)]
    return changes.merge(halves[0], halves[1], ["user_id"], update={"n": "t.n + s.n"})


_LAST = "SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1"


@query(f"WITH {CHANGES} SELECT user_id, seq, value, k FROM ({_LAST}) WHERE op <> 'error'")
def cdc_current(spark, d):
    return changes.apply_changes(change_events(spark, d), ["user_id"], ["seq"], deletes="op = 'error'", except_columns=["op"])


@query(f"WITH {CHANGES} SELECT user_id, k FROM ({_LAST}) WHERE op <> 'error'")
def cdc_columns(spark, d):
    return changes.apply_changes(change_events(spark, d), ["user_id"], ["seq"], deletes="op = 'error'", columns=["user_id", "k"])


@query(f"WITH {CHANGES} SELECT user_id, seq FROM ({_LAST}) WHERE op <> 'error' AND seq > (SELECT max(seq) FROM changes WHERE op = 'signup' AND user_id % 50 = 0)")
def cdc_truncate(spark, d):
    return changes.apply_changes(change_events(spark, d), ["user_id"], ["seq"], deletes="op = 'error'", truncates="op = 'signup' AND user_id % 50 = 0", columns=["user_id", "seq"])


@query(
    f"""WITH {CHANGES}, lives AS (SELECT *, CAST(sum(CASE WHEN op = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS life FROM changes),
        filled AS (SELECT *, last_value(CASE WHEN op <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, life ORDER BY seq) AS v FROM lives)
        SELECT user_id, seq, v AS value FROM filled WHERE op <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND seq = max(seq) OVER (PARTITION BY user_id)
        AND (user_id, seq) IN (SELECT user_id, max(seq) FROM changes GROUP BY 1)"""
)
def cdc_ignore_nulls(spark, d):
    return changes.apply_changes(change_events(spark, d), ["user_id"], ["seq"], deletes="op = 'error'", ignore_nulls=True, columns=["user_id", "seq", "value"])


@query(f"WITH {CHANGES} SELECT user_id, k, seq FROM changes WHERE op <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY seq DESC) = 1")
def cdc_composite_key(spark, d):
    return changes.apply_changes(change_events(spark, d).filter("op <> 'error'"), ["user_id", "k"], ["seq"], columns=["user_id", "k", "seq"])


_HISTORY = 'SELECT user_id, value, k, seq AS "__START_AT", e AS "__END_AT" FROM (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS e FROM changes) WHERE op <> \'error\''


def history(spark, d):
    return changes.scd2(change_events(spark, d), ["user_id"], "seq", deletes="op = 'error'", except_columns=["op"])


@query(f"WITH {CHANGES} {_HISTORY}")
def scd2_history(spark, d):
    return history(spark, d)


@query(
    f"""WITH {CHANGES}, m AS (SELECT *, lag(op) OVER w AS p, CASE WHEN row_number() OVER w = 1 OR op <> lag(op) OVER w THEN 1 ELSE 0 END AS fresh FROM changes WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM m),
        g AS (SELECT user_id, op, run, min(seq) AS s FROM r GROUP BY 1, 2, 3)
        SELECT user_id, op, s AS "__START_AT", lead(s) OVER (PARTITION BY user_id ORDER BY s) AS "__END_AT" FROM g"""
)
def scd2_tracked(spark, d):
    out = changes.scd2(change_events(spark, d), ["user_id"], "seq", track=["op"])
    return out.select("user_id", "op", changes.START, changes.END)


@query(f'WITH {CHANGES} SELECT user_id, "__START_AT", "__END_AT" IS NULL AS is_current FROM ({_HISTORY})')
def scd2_is_current(spark, d):
    return changes.with_is_current(history(spark, d)).select("user_id", changes.START, "is_current")


@query(f'WITH {CHANGES} SELECT user_id, count(*) AS n_versions, min("__START_AT") AS first_change, max("__START_AT") AS last_change FROM ({_HISTORY}) GROUP BY 1 HAVING count(*) >= 2')
def scd2_frequency(spark, d):
    return changes.change_frequency(history(spark, d), ["user_id"])


@query(f'WITH {CHANGES} SELECT user_id, arg_max("__END_AT", "__START_AT") AS deleted_at FROM (SELECT user_id, "__START_AT", coalesce("__END_AT", -1) AS "__END_AT" FROM ({_HISTORY})) GROUP BY 1 HAVING arg_max("__END_AT", "__START_AT") <> -1')
def scd2_deleted(spark, d):
    return changes.deleted(history(spark, d), ["user_id"])


@query(f'WITH {CHANGES} SELECT user_id, value, "__START_AT" FROM ({_HISTORY}) WHERE "__START_AT" <= 5000 AND ("__END_AT" IS NULL OR "__END_AT" > 5000)')
def scd2_as_of(spark, d):
    return relational.as_of(history(spark, d), F.lit(5000)).select("user_id", "value", changes.START)


@query(
    f"""WITH {CHANGES}, h AS (SELECT user_id, value, k, "__START_AT" AS s, "__END_AT" AS e FROM ({_HISTORY}))
        SELECT o_orderkey, h.value, h.k, h.s AS since FROM orders LEFT JOIN h ON user_id = o_custkey AND s <= o_orderkey % 10000 AND (e IS NULL OR e > o_orderkey % 10000)"""
)
def facts_as_of(spark, d):
    """Each order with the version of its customer that held at its own time."""
    facts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 10000).alias("at"))
    met = ordered.as_of_join(facts, history(spark, d), "user_id", "at", blocks=16)
    return met.select("o_orderkey", "value", "k", F.col(changes.START).alias("since"))


@query(f"WITH {CHANGES} SELECT user_id, seq, value, k FROM ({_LAST}) WHERE op <> 'error' AND seq > (SELECT max(seq) FROM changes WHERE op = 'signup' AND user_id % 50 = 0)")
def cdc_batches(spark, d):
    """The same as one pass, from two batches of which the second holds the earlier half too: deletes and truncates are remembered."""
    e, how = change_events(spark, d), {"deletes": "op = 'error'", "truncates": "op = 'signup' AND user_id % 50 = 0"}
    first = cdc.fold_changes(e.filter("seq % 3 = 0"), ["user_id"], ["seq"], **how)
    return changes.apply_changes(e.filter("seq % 3 <> 0"), ["user_id"], ["seq"], state=first, **how, columns=["user_id", "seq", "value", "k"])


@query(
    f"""WITH {CHANGES}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR op IS DISTINCT FROM lag(op) OVER w OR k IS DISTINCT FROM lag(k) OVER w THEN 1 ELSE 0 END AS fresh FROM changes WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
        g AS (SELECT * FROM m WHERE fresh = 1)
        SELECT user_id, op, k, seq AS "__START_AT", lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS "__END_AT" FROM g"""
)
def scd2_incremental(spark, d):
    e = change_events(spark, d).drop("value")
    early = changes.scd2(e.filter("seq <= 6000"), ["user_id"], "seq", track=["op", "k"])
    return changes.scd2_merge(early, e.filter("seq > 6000"), ["user_id"], "seq")


_STATES = "old AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), new AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 2)"


def _states(spark, d):
    c = _customers(spark, d)
    new = changes.update(c.filter("c_custkey % 10 <> 2"), "c_custkey % 4 = 0", {"c_mktsegment": F.lit("X")})
    return c.filter("c_custkey % 10 <> 1"), new


_FEED = """SELECT n.*, 'insert' AS _change_type FROM new n ANTI JOIN old o USING (c_custkey) UNION ALL SELECT o.*, 'delete' FROM old o ANTI JOIN new n USING (c_custkey)
    UNION ALL SELECT o.*, 'update_preimage' FROM old o JOIN new n USING (c_custkey) WHERE o.c_mktsegment <> n.c_mktsegment UNION ALL SELECT n.*, 'update_postimage' FROM old o JOIN new n USING (c_custkey) WHERE o.c_mktsegment <> n.c_mktsegment"""


@query(f"WITH {_STATES} SELECT *, CAST(2 AS BIGINT) AS _commit_version FROM ({_FEED})")
def change_feed(spark, d):
    return changes.change_feed(*_states(spark, d), ["c_custkey"], 2)


@query(f"WITH {_STATES} SELECT * FROM new")
def apply_feed(spark, d):
    old, new = _states(spark, d)
    return changes.apply_feed(old, changes.change_feed(old, new, ["c_custkey"], 2), ["c_custkey"], lo=2)


@query(f"WITH {CHANGES} SELECT user_id, seq, value FROM changes WHERE seq <= 4000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND op <> 'error'")
def state_at(spark, d):
    return changes.state_at(change_events(spark, d), ["user_id"], ["seq"], F.lit(4000), deletes="op = 'error'", columns=["user_id", "seq", "value"])


@query("SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def append_merge_schema(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return changes.append_merge_schema(s, table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_mktsegment").alias("note")))


@query("SELECT r_regionkey AS id, CAST(NULL AS DOUBLE) AS score FROM region")
def alter_columns(spark, d):
    return changes.alter(table(spark, d, "region"), add={"score": "double"}, rename={"r_regionkey": "id"}, drop=["r_name"])
