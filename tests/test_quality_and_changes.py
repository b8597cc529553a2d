"""Rules, expectations and table changes on small fixtures, and their properties."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.operators import cdc, changes, features, layout, ordered, quality, relational
from tarnlake.operators.hashing import content_hash

T = dt.datetime


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long")


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (("A", T(2024, 1, 2), 10.0, 11.0, 9.0, 10.5, 100), None),
        ((None, T(2024, 1, 2), 10.0, 11.0, 9.0, 10.5, 100), "missing_key"),
        (("A", T(2024, 1, 2), 10.0, 11.0, 9.0, -1.0, 100), "non_positive_close"),
        (("A", T(2024, 1, 2), 0.0, 11.0, 9.0, 10.5, 100), "non_positive_open"),
        (("A", T(2024, 1, 2), 10.0, 11.0, 9.0, 10.5, -5), "negative_volume"),
        (("A", T(2024, 1, 2), 10.0, 8.0, 9.0, 10.5, 100), "high_lt_low"),
        (("A", T(2024, 1, 2), 12.0, 11.0, 9.0, 10.5, 100), "high_lt_open"),
        (("A", T(2024, 1, 2), 10.0, 11.0, 9.0, 11.5, 100), "high_lt_close"),
        (("A", T(2024, 1, 2), 8.0, 11.0, 9.0, 10.5, 100), "low_gt_open"),
        (("A", T(2024, 1, 2), 10.0, 11.0, 9.0, 8.5, 100), "low_gt_close"),
        (("A", T(2024, 1, 2), 10.0, None, None, 10.5, 100), None),
    ],
)
def test_bar_rules(spark, row, reason):
    assert quality.flag_bars(bars(spark, [row])).first()[quality.REASON] == reason


def test_implausible_return_and_zero_close(spark):
    rows = [("A", T(2024, 1, d), c, c, c, c, 1) for d, c in ((1, 10.0), (2, 40.0), (3, 0.0), (4, 5.0))]
    got = {r.timestamp.day: r[quality.REASON] for r in quality.flag_bars(bars(spark, rows)).collect()}
    assert got == {1: None, 2: "implausible_return", 3: "non_positive_close", 4: None}


def test_quotes_and_trades(spark):
    q = spark.createDataFrame([("A", T(2024, 1, 1), 101.0, 100.0, 1, 1), ("A", T(2024, 1, 1), 100.0, 100.05, 1, -1), ("A", T(2024, 1, 1), 100.0, 100.05, 1, 1)], "symbol string, timestamp timestamp, bid_price double, ask_price double, bid_size long, ask_size long")
    assert [r[quality.REASON] for r in quality.flag_quotes(q).collect()] == ["crossed_quote", "negative_size", None]
    t = spark.createDataFrame([("A", T(2024, 1, 1), -5.0, 1), ("A", T(2024, 1, 1), 5.0, 0)], "symbol string, timestamp timestamp, price double, size long")
    assert [r[quality.REASON] for r in quality.flag_trades(t).collect()] == ["non_positive_price", "non_positive_size"]


def test_split_and_rate(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    flagged = quality.flag(df, {"negative": "x < 0"})
    good, bad = quality.split(flagged)
    assert good.columns == ["x"] and good.count() == 2 and bad.count() == 1
    assert quality.quarantine_rate(flagged.limit(0)).first().rate_pct == 0.0


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "a"), (None, "b")], "x int, s string")
    rules = {"positive": "x > 0", "is_a": "s = 'a'"}
    assert {r.name: r.failed_records for r in quality.expect(df, rules).collect()} == {"positive": 2, "is_a": 1}
    assert quality.expect_all_or_drop(df, rules).count() == 1
    assert {r.broken_rules for r in quality.quarantine(df, rules).collect()} == {"positive", "positive,is_a"}
    with pytest.raises(quality.ExpectationFailed):
        quality.expect_or_fail(df, "positive", "x > 0")
    assert quality.enforce(df.filter("x is not null"), ["x"], {"small": "x < 9"}).count() == 2
    with pytest.raises(quality.ExpectationFailed):
        quality.enforce(df, ["x"])


def test_latest_wins_and_ties(spark):
    df = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 105.0), ("A", 2, 104.0)], "k string, t int, close double")
    assert relational.dedup_latest(df, ["k"], "t", ["close"]).first().close == 105.0
    assert relational.dedup_latest(df, ["k"], "t", ties=True).count() == 2


CDC = "id long, name string, email string, operation string, seq long"
EVENTS = [(1, "Alice", "a@x", "INSERT", 1), (2, "Bob", "b@x", "INSERT", 2), (3, "Carol", "c@x", "INSERT", 3), (1, "Alice", "new@x", "UPDATE", 4), (2, None, None, "DELETE", 5)]


def test_scd1_and_scd2(spark):
    e = spark.createDataFrame(EVENTS, CDC)
    now = {r.id: r.email for r in changes.apply_changes(e, ["id"], ["seq"], deletes="operation = 'DELETE'", except_columns=["operation", "seq"]).collect()}
    assert now == {1: "new@x", 3: "c@x"}
    h = changes.scd2(e, ["id"], "seq", deletes="operation = 'DELETE'", except_columns=["operation"])
    got = sorted((r.id, r[changes.START], r[changes.END]) for r in h.collect() if r[changes.END] is not None)
    assert got == [(1, 1, 4), (2, 2, 5)] and changes.current(h).count() == 2
    assert {r.id for r in changes.current(h).collect()} == set(now)
    assert [r.id for r in changes.deleted(h, ["id"]).collect()] == [2]


def test_late_events_do_not_revive(spark):
    e = spark.createDataFrame(EVENTS + [(2, "Bob", "late@x", "UPDATE", 3)], CDC)
    assert changes.apply_changes(e, ["id"], ["seq"], deletes="operation = 'DELETE'").filter("id = 2").isEmpty()


def test_ignore_nulls_keeps_old_values(spark):
    e = spark.createDataFrame([(1, "a", None, "U", 1), (1, None, "m", "U", 2)], CDC)
    r = changes.apply_changes(e, ["id"], ["seq"], ignore_nulls=True).first()
    assert (r.name, r.email) == ("a", "m")


def test_scd2_versions_do_not_overlap(spark):
    e = spark.range(400).selectExpr("id % 7 AS k", "id AS seq", "id % 3 AS v")
    h = changes.scd2(e, ["k"], "seq", track=["v"])
    pairs = h.alias("a").join(h.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col(f"a.{changes.START}") < F.col(f"b.{changes.START}")))
    assert pairs.filter(F.col(f"a.{changes.END}").isNull() | (F.col(f"a.{changes.END}") > F.col(f"b.{changes.START}"))).isEmpty()


def test_merge_rules(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    s = spark.createDataFrame([(2, "x"), (3, "y"), (None, "m")], "id int, v string")
    once = changes.merge(t, s, ["id"])
    assert sorted((str(r.id), r.v) for r in once.collect()) == [("1", "a"), ("2", "x"), ("3", "y"), ("None", "m"), ("None", "n")]
    keyed = s.filter("id is not null")
    assert sorted(changes.merge(changes.merge(t, keyed, ["id"]), keyed, ["id"]).collect(), key=str) == sorted(changes.merge(t, keyed, ["id"]).collect(), key=str)
    with pytest.raises(changes.AmbiguousMerge):
        changes.merge(t, s.union(s.filter("id = 2")), ["id"])
    assert changes.merge(t, keyed, ["id"], delete_missing=True).count() == 2
    assert changes.delete(t, "v = 'a' AND id > 0").count() == 2
    # null keys of either side stay apart, and conditions hold for those of the source as well
    rows = lambda df: sorted((str(r.id), r.v) for r in df.collect())
    assert rows(changes.merge(t, s, ["id"], delete_if="s.v = 'm' OR t.v = 'b'")) == [("1", "a"), ("3", "y"), ("None", "n")]
    assert rows(changes.merge(t, s, ["id"], insert=False)) == [("1", "a"), ("2", "x"), ("None", "n")]
    assert rows(changes.merge(t, s, ["id"], delete_missing=True)) == [("2", "x"), ("3", "y"), ("None", "m")]
    assert changes.merge(t.withColumn("w", F.lit(1)), s, ["id"]).filter("w IS NULL").count() == 2
    assert not [j for j in layout.explain_facts(changes.merge(t, s, ["id"], check=False))["joins"] if "NestedLoop" in j]


def test_feed_turns_old_into_new(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    feed = changes.change_feed(old, new, ["id"], 7)
    assert sorted(r._change_type for r in feed.collect()) == ["delete", "insert", "update_postimage", "update_preimage"]
    assert sorted(changes.apply_feed(old, feed, ["id"]).collect()) == sorted(new.collect())
    assert changes.apply_feed(old, feed, ["id"], hi=6).count() == 3


def test_salted_join_equals_plain(spark):
    big = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS k", "id AS v")
    small = spark.range(60).selectExpr("id AS k", "id * 2 AS w")
    a, b = relational.salted_join(big, small, "k", 8, share=0.1), big.join(small, "k")
    assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()


def test_hot_keys_are_found_and_dealt(spark):
    big = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 1 ELSE id END AS k", "id AS v", "map('a', id) AS m")
    assert [r.k for r in relational.hot_keys(big, "k", 0.2).collect()] == [1]
    small = spark.createDataFrame([(1, "x"), (5, "y"), (None, "n")], "k long, __salt string")
    got = relational.salted_join(big, small, "k", 8, share=0.2, how="left")
    assert got.count() == 3000 and got.filter("__salt = 'x'").count() == 1000 and got.filter("__salt = 'n'").isEmpty()
    with pytest.raises(ValueError, match="share"):
        relational.hot_keys(big, "k", 1e-9)


def _cut(rng, rows):
    """Rows in a random order, in a random number of batches."""
    rows = rng.sample(rows, len(rows))
    cuts = sorted(rng.sample(range(1, len(rows)), min(rng.randrange(4), len(rows) - 1)))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ignore_nulls", [False, True])
def test_any_split_into_batches_is_one_pass(spark, seed, ignore_nulls):
    """Deletes, truncates, null keys, equal sequences and maps, in any order and any batches."""
    rng = random.Random(seed)
    schema = "k int, seq int, op string, v string, w int, m map<string,int>"
    rows = [
        (rng.choice([None, 1, 2, 3, 4]), rng.randrange(30), "TRUNCATE" if rng.random() < 0.04 else rng.choice(["UP", "UP", "UP", "DEL"]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), rng.choice([None, {"x": 1, "y": 2}]))
        for _ in range(40)
    ]
    how = {"deletes": "op = 'DEL'", "truncates": "op = 'TRUNCATE'", "ignore_nulls": ignore_nulls}
    state = None
    for batch in _cut(rng, rows):
        state = cdc.fold_changes(spark.createDataFrame(batch, schema).repartition(2), ["k"], ["seq"], state=state, **how)
        state = spark.createDataFrame(state.collect(), state.schema)
    whole = cdc.fold_changes(spark.createDataFrame(rows, schema), ["k"], ["seq"], **how)
    got, want = cdc.current_rows(state, ["k"]), cdc.current_rows(whole, ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and cdc.same_state(got, want)
    # what one pass gives is what a plain reading of the events gives
    clear = max((r[1] for r in rows if r[2] == "TRUNCATE"), default=-1)
    live = [r for r in rows if r[2] != "TRUNCATE" and r[1] > clear]
    for r in want.collect():
        own = [x for x in live if x[0] == r.k]
        top = max(x[1] for x in own)
        assert r.seq == top and any(x[1] == top and x[2] != "DEL" for x in own)
        if ignore_nulls and sum(x[1] == top for x in own) == 1:
            dead = max((x[1] for x in own if x[2] == "DEL"), default=-1)
            later = [x for x in own if x[1] > dead and x[3] is not None]
            last = max((x[1] for x in later), default=None)
            assert r.v in ({x[3] for x in later if x[1] == last} or {None})
    keys = {x[0] for x in live if x[1] == max(y[1] for y in live if y[0] == x[0]) and x[2] != "DEL"}
    sure = {k for k in keys if len({x[2] == "DEL" for x in live if x[0] == k and x[1] == max(y[1] for y in live if y[0] == k)}) == 1}
    assert sure <= {r.k for r in want.collect()} <= keys


def test_tombstones_are_forgotten_by_retention(spark):
    e = lambda *rows: spark.createDataFrame(rows, "k int, seq int, op string, v string")
    how = {"deletes": "op = 'DEL'"}
    state = cdc.fold_changes(e((1, 1, "UP", "a"), (1, 10, "DEL", None), (2, 20, "DEL", None), (3, 2, "UP", "c")), ["k"], ["seq"], **how)
    late = e((1, 5, "UP", "late"))
    assert [r.k for r in changes.apply_changes(late, ["k"], ["seq"], state=state, **how).collect()] == [3]
    kept = cdc.forget(state, F.lit(15), "seq")
    assert sorted(r.k for r in kept.collect()) == [2, 3]
    with pytest.raises(TypeError):
        changes.apply_changes(late, ["k"], ["seq"], target=late)


def test_map_columns_are_content(spark):
    df = spark.sql("SELECT 1 AS k, 1 AS seq, map('a', 1, 'b', 2) AS m, array(struct(map('x', array(1)) AS n)) AS d UNION ALL SELECT 1, 1, map('b', 2, 'a', 1), array(struct(map('x', array(1)) AS n))")
    assert df.select(content_hash(df).alias("h")).distinct().count() == 1
    assert relational.dedup_latest(df, ["k"], "seq").count() == changes.apply_changes(df, ["k"], ["seq"]).count() == 1
    assert changes.insert_new(df.limit(0), df, ["k"]).count() == 1 and changes.scd2(df, ["k"], "seq").count() == 1


def test_running_values_are_windows(spark):
    """By blocks as by one window, with null keys, places and values, and any number of blocks."""
    df = spark.range(500).selectExpr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS k", "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST((id * 37) % 101 AS INT) END AS t", "CASE WHEN id % 7 <> 0 THEN (id * 13) % 29 END AS v", "id", "1 + (id % 3 - 1) / 100 AS g", "'own' AS __block")
    values = {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "p": ("product", "g")}
    for keys in ([], ["k"]):
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("t"), "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.round(F.product("g").over(w), 9).alias("p"))
        for blocks in (1, 2, 16):
            got = ordered.running(df, keys, "t", values, tie_break=["id"], blocks=blocks).withColumn("p", F.round("p", 9))
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = ordered.numbered(df, "id", "n", blocks=8)
    assert got.filter("n <> id + 1").isEmpty()
    days = spark.range(40).selectExpr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT)) AS d", "timestamp_seconds(id * 1000) AS ts", "id")
    for order in ("d", "ts"):
        assert ordered.running(days, [], order, {"s": ("sum", "id")}, tie_break=["id"], blocks=4).agg(F.max("s")).first()[0] == 780
    with pytest.raises(ValueError, match="no such"):
        ordered.running(df, [], "t", {"x": ("median", "v")})


def test_running_values_of_one_key_are_many_tasks(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "id AS t", "1 AS v")
    got = ordered.running(df, ["k"], "t", {"s": ("sum", "v")}, blocks=16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 20_000 and got.filter("s <> t + 1").isEmpty()


def test_facts_meet_the_version_of_their_time(spark):
    rng = random.Random(4)
    versions = []
    for k in (1, 2, 3, None):
        t = 0
        for _ in range(30):
            t += rng.randrange(1, 9)
            end = t + rng.randrange(1, 9)
            versions.append((k, f"{k}-{t}", t, end))
            t = end + rng.choice([0, 0, 5])
        versions[-1] = (*versions[-1][:3], None)
    facts = [(i, rng.choice([1, 1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(400)])) for i in range(600)]
    h = spark.createDataFrame(versions, f"k int, v string, {changes.START} int, {changes.END} int")
    f = spark.createDataFrame(facts, "id int, k int, at int")
    want = {i: next((v for kk, v, s, e in versions if k is not None and at is not None and kk == k and s <= at and (e is None or at < e)), None) for i, k, at in facts}
    for blocks in (1, 3, 32):
        got = ordered.as_of_join(f, h, "k", "at", blocks=blocks)
        assert {r.id: r.v for r in got.collect()} == want and got.count() == len(facts)
        assert ordered.as_of_join(f, h, "k", "at", how="inner", blocks=blocks).count() == sum(v is not None for v in want.values())
    plan = layout.explain_facts(ordered.as_of_join(f, h, "k", "at"))
    assert not [j for j in plan["joins"] if "NestedLoop" in j or "Cartesian" in j]
    with pytest.raises(ValueError, match="both sides"):
        ordered.as_of_join(f.withColumn("v", F.lit(1)), h, "k", "at")


def test_long_blocks_raise(spark):
    bars = spark.range(5).selectExpr("'A' AS symbol", "timestamp_seconds(id * 86400) AS timestamp", "1.0 AS close", "1.0 AS open", "1.0 AS high", "1.0 AS low", "1L AS volume")
    for call in (features.recursive, features.indicators):
        with pytest.raises(ValueError, match="rows"):
            call(bars, block=8000)
    most = features.longest_block() - 600
    long = spark.range(most + 300).selectExpr("'A' AS symbol", "timestamp_seconds(id * 86400) AS timestamp", "CAST(100 + id % 7 AS DOUBLE) AS close")
    got = features.recursive(long, block=most)
    assert got.filter("macd_signal IS NULL OR isnan(macd_signal) OR isnan(ema_12)").isEmpty() and got.count() == most + 300


def test_schema_changes(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert changes.alter(df, add={"n": "double"}, rename={"v": "w"}).columns == ["id", "w", "n"]
    assert changes.append_merge_schema(df, spark.createDataFrame([(2, 3.0)], "id int, x double")).count() == 2


def test_null_keys_and_equal_sequences(spark):
    """Null keys are keys, and equal sequences are decided by content, whatever the rows' order."""
    states = [[(None, "a"), (1, "x"), (2, "y")], [(None, "b"), (1, "x"), (3, "z")], [(1, "q"), (2, "y")], [(None, None)]]
    frames = [spark.createDataFrame(x, "id int, v string") for x in states]
    for old in frames:
        for new in frames:
            got = changes.apply_feed(old, changes.change_feed(old, new, ["id"], 1), ["id"]).collect()
            assert sorted(map(str, got)) == sorted(map(str, new.collect()))
    events = [(None, 1, "a"), (None, 5, "b"), (7, 2, "c"), (7, 6, "d"), (7, 6, "e"), (8, 6, "f")]
    schema = "k int, seq int, v string"
    whole = changes.scd2(spark.createDataFrame(events, schema), ["k"], "seq", track=["v"])
    first = changes.scd2(spark.createDataFrame(events[:3:2], schema), ["k"], "seq", track=["v"])
    merged = changes.scd2_merge(first, spark.createDataFrame(events[1:2] + events[3:], schema), ["k"], "seq")
    assert sorted(map(str, merged.select(sorted(whole.columns)).collect())) == sorted(map(str, whole.select(sorted(whole.columns)).collect()))
    assert changes.current(merged).filter("k IS NULL").count() == 1
    for part in (events, events[::-1]):
        now = changes.apply_changes(spark.createDataFrame(part, schema).repartition(3), ["k"], ["seq"])
        assert sorted(map(str, now.collect())) == sorted(map(str, changes.apply_changes(spark.createDataFrame(events, schema), ["k"], ["seq"]).collect()))


def test_ties_are_sorted_in_all_partitions(spark):
    """Adaptive execution would join these few rows to one partition, as it joins many to a task for each core."""
    df = spark.range(4000).selectExpr("id % 900 AS k", "id % 7 AS t", "id")
    kept = relational.dedup_latest(df, ["k"], "t", ties=True)
    assert kept.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = {k: max(i % 7 for i in range(k, 4000, 900)) for k in range(900)}
    assert {r.id for r in kept.collect()} == {i for i in range(4000) if i % 7 == top[i % 900]}


def test_wide_changes_are_dealt_out_before_the_aggregate(spark, capsys):
    """The partial aggregate sorts rows with their places: it gets a part of a file's rows, also of one key's."""
    e = spark.range(2000).selectExpr("1 AS k", "id AS seq", "CAST(id AS STRING) AS v").coalesce(1)
    folded = cdc.fold_changes(e, ["k"], ["seq"])
    folded.explain()
    plan = capsys.readouterr().out
    dealt, partial = plan.index("REPARTITION_BY_NUM"), plan.rindex("partial_max")
    assert partial < dealt  # below it in the plan
    assert cdc.current_rows(folded, ["k"], ["v"]).first().v == "1999"
