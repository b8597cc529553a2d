"""Files, ingestion, schema modes, streams, layout, governance, monitoring and declared tables."""

from __future__ import annotations

import datetime as dt
import json
import pathlib
import shutil
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.functions import udfs
from tarnlake.functions.masks import mask_email, mask_partial
from tarnlake.operators import backtest, changes, features, governance, layout, models, monitoring
from tarnlake.plans import declared
from tarnlake.sources import files, ingest, kafka
from tarnlake.streaming import sinks, state, windows


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def test_file_formats_and_modes(spark, root):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id int, s string, x double")
    df.write.option("header", True).option("nullValue", "-").csv(f"{root}/csv")
    assert files.read_csv(spark, f"{root}/csv", nullValue="-").dtypes == [("id", "int"), ("s", "string"), ("x", "double")]
    assert files.read_csv(spark, f"{root}/csv", "id int, s string, x double", nullValue="-").exceptAll(df).isEmpty()
    df.write.json(f"{root}/json")
    assert files.read_json(spark, f"{root}/json", "id int, s string, x double").exceptAll(df).isEmpty()
    files.write(df, f"{root}/p", partition_by=["id"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write(df, f"{root}/p")
    files.write(df, f"{root}/p", "ignore")
    assert files.read_parquet(spark, f"{root}/p").count() == 2
    files.overwrite_partitions(df.filter("id = 1").withColumn("s", F.lit("new")), f"{root}/p", ["id"])
    assert {(r.id, r.s) for r in files.read_parquet(spark, f"{root}/p").collect()} == {(1, "new"), (2, None)}
    assert files.sql_path(spark, "parquet", f"{root}/p", "id = 2").count() == 1
    assert files.with_file_lineage(files.read_parquet(spark, f"{root}/p")).select("_file_name").first()[0].endswith(".parquet")
    spark.createDataFrame([("x",), ("y",)], "v string").write.text(f"{root}/t")
    assert files.read_text(spark, f"{root}/t").count() == 2


def test_incremental_and_bronze(spark, root):
    src = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 6)], "id int, ts timestamp")
    assert files.incremental_since(src, None, "ts").count() == 5
    assert files.incremental_since(src, src.filter("id <= 3"), "ts").count() == 2
    files.land_bronze(src, f"{root}/b", "here")
    files.land_bronze(src.withColumn("more", F.lit(1)), f"{root}/b", "here")
    assert spark.read.option("mergeSchema", True).parquet(f"{root}/b").filter("more is null").count() == 5


def test_tables_and_views(spark):
    df = spark.range(3)
    files.create_as(df, "tarn_made", "overwrite")
    spark.sql("INSERT INTO tarn_made VALUES (9)")
    files.register_view(df, "tarn_view")
    files.register_view(df, "tarn_global", everywhere=True)
    assert spark.table("tarn_made").count() == 4 and spark.sql("SELECT * FROM global_temp.tarn_global").count() == 3
    assert spark.catalog.tableExists("tarn_made") and not spark.sql("DESCRIBE EXTENDED tarn_made").isEmpty()
    layout.analyze(spark, "tarn_made", ["id"])
    spark.sql("DROP TABLE tarn_made")


def test_ingest_once(spark, root):
    def drop(k):
        spark.createDataFrame([(k, "a"), (k, "b")], "id int, s string").coalesce(1).write.mode("append").json(f"{root}/in")

    drop(1)
    args = (spark, f"{root}/in", "json", f"{root}/out", f"{root}/ck", "id int, s string")
    ingest.ingest_files(*args)
    ingest.ingest_files(*args, pathGlobFilter="*.json")
    assert spark.read.parquet(f"{root}/out").count() == 2
    drop(2)
    ingest.ingest_files(*args, maxFilesPerTrigger=1)
    assert spark.read.parquet(f"{root}/out").count() == 4
    assert ingest.copy_into(spark, f"{root}/in", f"{root}/copy", "json", schema="id int, s string") == 4
    assert ingest.copy_into(spark, f"{root}/in", f"{root}/copy", "json", schema="id int, s string") == 0
    assert ingest.copy_into(spark, f"{root}/in", f"{root}/copy", "json", schema="id int, s string", select=["id"], force=True) == 4
    drop(3)
    assert ingest.copy_into(spark, f"{root}/in", f"{root}/copy", "json", schema="id int, s string") == 2
    assert spark.read.parquet(f"{root}/copy").groupBy(ingest.COPIED_FROM).count().count() == 3


def test_schema_inference_and_evolution(spark, root):
    spark.createDataFrame([(1, "2024-01-01")], "id int, d string").write.json(f"{root}/j")
    first = ingest.infer_schema(spark, f"{root}/j", "json", f"{root}/schema", hints="id int, extra string")
    assert [f.name for f in first.fields] == ["d", "id", "extra"] and first["id"].dataType.simpleString() == "int"
    assert ingest.infer_schema(spark, "nowhere", "json", f"{root}/schema") == first
    known = StructType.fromDDL("id int, name string")
    new = spark.createDataFrame([(1, "x@y")], "id int, email string")
    assert ingest.evolve(new, known).columns == ["id", "name", "email"]
    assert ingest.evolve(new, known, "none").columns == ["id", "name"]
    assert json.loads(ingest.evolve(new, known, "rescue").first()._rescued_data) == {"email": "x@y"}
    with pytest.raises(ingest.SchemaChanged):
        ingest.evolve(new, known, "failOnNewColumns")
    rows = spark.createDataFrame([('{"id":1,"z":2}',), ('{"id":"q"}',), ("broken",), (None,), ('{"id":5}',)], "j string")
    got = [(r.id, r._rescued_data) for r in ingest.with_rescued(rows, "j", "id int").collect()]
    assert got == [(1, '{"z":"2"}'), (None, '{"id":"q"}'), (None, "broken"), (None, None), (5, None)]


def test_kafka_shapes(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "order_id int, customer string, amount double")
    sent = kafka.encode_kafka(df, "order_id").withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(3)})
    back = kafka.decode_kafka(sent, "order_id int, customer string, amount double").first()
    assert (back.key, back.customer, back.offset) == ("1", "a", 3)
    assert kafka.decode_kafka(sent.withColumn("value", F.lit("{").cast("binary")), "order_id int").first().order_id is None
    assert kafka.kafka_options("h:1", subscribe="t", max_per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    with pytest.raises(ValueError):
        kafka.kafka_options("h:1")


def _write_events(spark, path, rows):
    spark.createDataFrame(rows, "id int, k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def _at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_stream_resume_merge_fan_out_progress(spark, root):
    src = f"{root}/src"
    _write_events(spark, src, [(i, f"k{i % 5}", _at(i)) for i in range(100)])
    sinks.stream_table(spark, src, f"{root}/sink", f"{root}/ck")
    assert spark.read.parquet(f"{root}/sink").count() == 100
    _write_events(spark, src, [(i, f"k{i % 5}", _at(i)) for i in range(100, 110)])
    sinks.stream_table(spark, src, f"{root}/sink", f"{root}/ck")
    assert spark.read.parquet(f"{root}/sink").count() == 110

    table = sinks.BucketTable(spark, f"{root}/table", ["k"], buckets=16)
    merge = sinks.merge_batch(table, "ts")
    batch = spark.read.parquet(src)
    assert table.read() is None and table.next_batch() == 0
    merge(batch.filter("id < 50"), 0)
    merge(batch, 1)
    merge(batch, 1)
    assert table.read().count() == 5 and {r.id for r in table.read().collect()} == set(range(105, 110))
    merge(batch.filter("id < 7").withColumn("k", F.lit("new")), 2)
    merge(batch.limit(0), 3)
    assert table.read().count() == 6 and table.next_batch() == 3

    fan = sinks.fan_out({"low": ("id < 10", f"{root}/low"), "high": ("id >= 10", f"{root}/high")})
    fan(batch, 3)
    sinks.once_per_batch(batch.filter("id < 3"), f"{root}/low", 4)  # written before a crash
    fan(batch, 3)
    fan(batch, 4)
    assert spark.read.parquet(f"{root}/low").count() == 20 and spark.read.parquet(f"{root}/high").count() == 200
    assert sinks.observed(batch, "id % 2 = 0", lambda df: df.write.parquet(f"{root}/obs")) == {"total": 110, "valid": 55}

    rows = spark.readStream.schema(batch.schema).parquet(src)
    counted = windows.running_totals(rows, ["k"], {"n": F.count("*")})
    q = counted.writeStream.format("memory").queryName("tarn_counts").outputMode("complete").option("checkpointLocation", f"{root}/ck2").start()
    q.processAllAvailable()
    assert q.isActive and spark.sql("SELECT sum(n) FROM tarn_counts").first()[0] == 110
    got = sinks.progress_table(spark, q.recentProgress)
    assert got.agg(F.sum("input_rows")).first()[0] == 110 and got.agg(F.max("state_rows")).first()[0] == 5
    q.stop()
    assert not q.isActive and q.exception() is None
    with pytest.raises(ValueError):
        sinks.trigger(counted.writeStream, "sometimes")


def test_stream_outer_join_and_feed(spark, root):
    _write_events(spark, f"{root}/l", [(1, "a", _at(0)), (2, "b", _at(10)), (3, "z", _at(9000))])
    _write_events(spark, f"{root}/r", [(7, "a", _at(60)), (8, "y", _at(9000))])
    schema = "id int, k string, ts timestamp"
    left = spark.readStream.schema(schema).parquet(f"{root}/l").withColumnRenamed("ts", "lt")
    right = spark.readStream.schema(schema).parquet(f"{root}/r").selectExpr("id AS rid", "k", "ts AS rt")
    out = windows.stream_interval_join(left, right, "k", "lt", "rt", "5 MINUTES", how="leftOuter", delays=("1 minute", "1 minute"))
    sinks.run_to_end(out.select("id", "rid", "converted"), sink=f"{root}/o", checkpoint=f"{root}/ck")
    got = {(r.id, r.rid, r.converted) for r in spark.read.parquet(f"{root}/o").collect()}
    assert got == {(1, 7, True), (2, None, False)}

    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    table = sinks.BucketTable(spark, f"{root}/t", ["id"], buckets=4)
    table.merge(old, 0, lambda _, rows: rows)
    for _ in range(2):
        sinks.feed_batch(table)(changes.change_feed(old, new, ["id"], 1), 1)
    assert sorted(table.read().collect()) == sorted(new.collect())


def test_triggers_modes_and_failures(spark, root):
    """A rate source under the default and the processing-time trigger, in update mode, and queries that fail or time out."""
    rows = sinks.rate_stream(spark, rows_per_second=50).withColumn("k", F.col("value") % 3)
    counted = windows.running_totals(rows, ["k"], {"n": F.count("*")})
    for k, kind in enumerate((None, "processingTime")):
        seen = []
        q = sinks.trigger(counted.writeStream.outputMode("update").foreachBatch(lambda df, _, seen=seen: seen.append(df.count())).option("checkpointLocation", f"{root}/ck{k}"), kind, "200 milliseconds").start()
        try:
            assert not q.awaitTermination(1) and q.isActive
            for _ in range(60):
                if sum(seen):
                    break
                q.awaitTermination(0.5)
        finally:
            q.stop()
        assert 0 < max(seen) <= 3 and not q.isActive

    def fail(batch, batch_id):
        raise RuntimeError("the sink is away")

    _write_events(spark, f"{root}/in", [(1, "a", _at(0))])
    src = spark.readStream.schema("id int, k string, ts timestamp").parquet(f"{root}/in")
    bad = src.writeStream.foreachBatch(fail).option("checkpointLocation", f"{root}/ck9").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="the sink is away"):
        bad.awaitTermination()
    assert "the sink is away" in str(bad.exception())
    sinks.run_to_end(src, sink=f"{root}/out", checkpoint=f"{root}/ck9")  # the same checkpoint takes the batch again
    assert spark.read.parquet(f"{root}/out").count() == 1


def test_wrong_return_type_gives_nulls(spark):
    """A plain Python function that returns another type than it declares gives nulls, not an error; a cast in it doesn't."""
    wrong, right = F.udf(lambda x: x * 1.5, "int", useArrow=False), F.udf(lambda x: int(x * 1.5), "int", useArrow=False)
    assert [tuple(r) for r in spark.range(1, 3).select(wrong("id").alias("a"), right("id").alias("b")).collect()] == [(None, 1), (None, 3)]


def test_session_state(spark, root):
    for s, rows in enumerate([[0, 60, 120], [5000, 5010], [20000]]):
        _write_events(spark, f"{root}/{s}", [(i, "u", _at(t)) for i, t in enumerate(rows)])
        spark.read.parquet(f"{root}/{s}").coalesce(1).write.mode("append").parquet(f"{root}/all")
    rows = spark.readStream.schema("id int, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/all")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run = lambda: sinks.run_to_end(state.session_state(rows, "k", "ts", 600), sink=f"{root}/o", checkpoint=f"{root}/ck")
    with state.state_store(spark):
        run()
    ended = lambda: sorted(r.n_events for r in spark.read.parquet(f"{root}/o").filter("status = 'ENDED'").collect())
    assert ended() == [2, 3] and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    # a restart goes on with the open session of the checkpoint
    _write_events(spark, f"{root}/all", [(9, "u", _at(20100)), (9, "u", _at(20050))])
    with state.state_store(spark):
        run()
    _write_events(spark, f"{root}/all", [(9, "u", _at(90000))])
    with state.state_store(spark):
        run()
    assert ended() == [2, 3, 3]


@pytest.mark.parametrize("cuts", [[], [3], [1, 5, 6]])
def test_sessions_of_arrays(cuts):
    """Sessions from batches of a key in order are those of all events at once."""
    gap, times = 600, np.array([0, 10, 700, 1300, 2500, 2600, 9000, 9600, 20000], dtype=np.int64)
    b, e = state.cut_sessions(times, gap)
    assert [(int(times[i]), int(times[j])) for i, j in zip(b, e)] == [(0, 10), (700, 1300), (2500, 2600), (9000, 9600), (20000, 20000)]

    class Store:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return Store()

        listTimers = lambda self: iter(())
        registerTimer = lambda self, ms: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    made, got = state.Sessions("ts", gap, None), []
    made.init(Handle())
    for part in np.split(times, cuts):
        if len(part):
            frame = pd.DataFrame({"ts": pd.to_datetime(part[::-1] * 1_000_000, unit="us")})
            for out in made.handleInputRows(("u",), iter([frame]), Clock()):
                got += out[out.status == "ENDED"][["started", "last_seen", "n_events"]].to_numpy().tolist()
    got += [r[:] for out in made.handleExpiredTimer(("u",), None, None) for r in out[["started", "last_seen", "n_events"]].to_numpy().tolist()]
    assert [(int(a.timestamp()), int(z.timestamp()), n) for a, z, n in got] == [(0, 10, 2), (700, 1300, 2), (2500, 2600, 2), (9000, 9600, 2), (20000, 20000, 1)]


def test_buckets_follow_the_batch(spark, root):
    """A small batch rewrites its buckets alone, a batch that crashed half way is finished, and deletes empty a bucket."""
    table = sinks.BucketTable(spark, f"{root}/b", ["id"], buckets=32)
    rows = spark.range(3000).selectExpr("id", "0L AS n")
    add = lambda old, new: changes.merge(old, new, ["id"], update={"n": "t.n + s.n"}, check=False)
    table.merge(rows, 0, lambda old, new: new)
    files = lambda: {r.path: r.length for r in ingest.list_files(spark, f"{root}/b", "*.parquet").collect()}
    first = files()
    one = rows.filter("id = 7").withColumn("n", F.lit(5).cast("long"))
    assert len(table.merge(one, 1, add)) == 1
    second = files()
    fresh = sum(n for p, n in second.items() if p not in first)
    assert 0 < fresh < 0.1 * sum(second.values())
    assert table.merge(one, 1, add) == [] and table.read().filter("id = 7").first().n == 5
    # of batch 2 one bucket was written before a crash; the other is still to come
    two = rows.filter("id IN (7, 8)").withColumn("n", F.lit(1).cast("long"))
    table.merge(two.filter("id = 8"), 2, add)
    table.merge(two, 2, add)
    assert {r.id: r.n for r in table.read().filter("id IN (7, 8)").collect()} == {7: 6, 8: 1} and table.read().count() == 3000
    gone = sinks.BucketTable(spark, f"{root}/g", ["id"], buckets=2)
    gone.merge(rows.filter("id < 9"), 0, lambda old, new: new)
    gone.merge(rows.filter("id < 9"), 1, lambda old, new: changes.merge(old, new, ["id"], delete_if="true", check=False))
    assert gone.read().count() == 0 and gone.next_batch() == 2


def test_progress_of_every_batch(spark, root):
    """More batches than a query remembers, each in the log."""
    for i in range(120):
        spark.range(i, i + 1).coalesce(1).write.mode("append").json(f"{root}/in")
    log = sinks.ProgressLog(spark, f"{root}/log", every=40)
    spark.streams.addListener(log)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(f"{root}/in")
        q = rows.writeStream.foreachBatch(lambda df, k: df.write.format("noop").mode("overwrite").save()).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):
            log.flush()
            held = ingest.read_or_none(spark, f"{root}/log")
            if held is not None and held.filter("input_rows > 0").count() >= 120:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    got = spark.read.parquet(f"{root}/log").filter("input_rows > 0")
    assert got.count() == got.select("batch_id").distinct().count() == 120 and got.select("query_id").distinct().count() == 1
    assert len(q.recentProgress) < 125


def test_evolving_stream_in_each_mode(spark, root):
    """Files of one, two and three columns, one more a run."""
    for k, rows in enumerate(['{"a":1}', '{"a":2,"b":"x"}', '{"a":3,"b":"y","c":1.5}']):
        spark.createDataFrame([(rows,)], "value string").coalesce(1).write.text(f"{root}/f{k}")
    got = {}
    for mode in ("addNewColumns", "rescue", "none", "failOnNewColumns"):
        stops = 0
        for k in range(3):
            spark.read.text(f"{root}/f{k}").coalesce(1).write.mode("append").text(f"{root}/in-{mode}")
            for _ in range(2):
                try:
                    ingest.stream_evolving(spark, f"{root}/in-{mode}", "json", f"{root}/out-{mode}", f"{root}/ck-{mode}", f"{root}/store-{mode}", mode)
                    break
                except ingest.SchemaChanged:
                    stops += 1
        out = spark.read.option("mergeSchema", True).parquet(f"{root}/out-{mode}").drop("batch_id")
        got[mode] = stops, sorted(out.columns), sorted((str(r.asDict()) for r in out.collect()))
    assert got["addNewColumns"][:2] == (2, ["a", "b", "c"]) and len(got["addNewColumns"][2]) == 3
    assert got["rescue"][:2] == (0, ["_rescued_data", "a"]) and sum('"b":"y"' in r for r in got["rescue"][2]) == 1
    assert got["none"][:2] == (0, ["a"]) and len(got["none"][2]) == 3
    assert got["failOnNewColumns"][0] == 4 and len(got["failOnNewColumns"][2]) == 1
    assert [len(v.fields) for v in ingest.schema_versions(spark, f"{root}/store-addNewColumns")] == [1, 2, 3]
    wide = ingest.infer_schema(spark, f"{root}/f2", "json", f"{root}/store-none", refresh=True)
    assert wide.names == ["a", "b", "c"] and ingest.infer_schema(spark, "nowhere", "json", f"{root}/store-none") == wide


def test_loads_survive_crashes(spark, root):
    """Nothing is lost or doubled, whichever write was the last, and loaded files aren't opened again."""
    def drop(k):
        spark.createDataFrame([(k, "a b+c%")], "id int, s string").coalesce(1).write.mode("append").partitionBy("s").json(f"{root}/in")

    args = (spark, f"{root}/in", f"{root}/t", "json")
    load = lambda: ingest.copy_into(*args, schema="id int")
    drop(1)
    assert load() == 1
    # a crash between the rows and the ledger
    (ledger := pathlib.Path(root.removeprefix("file://")) / "t.ledger" / "load=000000000").rename(ledger.parent.parent / "away")
    assert load() == 0 and spark.read.parquet(f"{root}/t").count() == 1
    shutil.rmtree(ledger.parent.parent / "away")
    # a crash before the rows were moved into place
    drop(2)
    left = pathlib.Path(root.removeprefix("file://")) / "t" / "_load=000000001"
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    assert load() == 1 and load() == 0
    assert sorted(r.id for r in spark.read.parquet(f"{root}/t").collect()) == [1, 2]
    # a loaded file that nobody can open any more isn't missed
    for p in pathlib.Path(root.removeprefix("file://"), "in").rglob("*.json"):
        p.write_text("not json")
    assert load() == 0


def test_compaction_by_partition(spark, root):
    folder = pathlib.Path(root.removeprefix("file://")) / "c"
    rows = spark.range(4000).selectExpr("id", "concat('p ', id % 3) AS p", "concat(uuid(), uuid(), uuid()) AS pad")
    rows.filter("id < 3000").repartition(6).write.partitionBy("p").parquet(f"{root}/c")
    rows.filter("id >= 3000").repartition(1).write.mode("append").partitionBy("p").parquet(f"{root}/c")
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    limit = sorted(p.stat().st_size for p in before)[-3]
    large = {p for p in before if p.stat().st_size >= limit}
    assert len(large) == 3
    by = lambda: {r.p: (r.n, r.s) for r in spark.read.parquet(f"{root}/c").groupBy("p").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    sums = by()
    with pytest.raises(AnalysisException):
        layout.compact(spark, f"{root}/c", where="id > 3", small=limit)
    gone = layout.compact(spark, f"{root}/c", where="p <> 'p 0'", small=limit)
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    assert by() == sums and gone == len(set(before) - set(after)) > 0
    assert all(after.get(p) == t for p, t in before.items() if p in large or "0" in p.parent.name)
    assert not list(folder.glob("_compacted-*"))
    # a run that died with its plan written is carried out by the next
    assert layout.compact(spark, f"{root}/c", small=limit) > 0 and by() == sums
    assert layout.compact(spark, f"{root}/c", small=limit) == 0
    staged = folder / "_compacted-x" / "p=p 1"
    staged.mkdir(parents=True)
    old = max((p for p in folder.glob("p=p 1/*.parquet")), key=lambda p: p.stat().st_size)
    shutil.copy(old, staged / "part-new.parquet")
    (folder / "_compacted-x" / "_plan").write_text(f"file:{folder}\nfile:{old}")
    layout.compact(spark, f"{root}/c", small=1)
    assert by() == sums and not old.exists()


def test_layout(spark, root):
    df = spark.range(1000).selectExpr("id AS a", "id % 37 AS b")
    df.repartition(20).write.parquet(f"{root}/small")
    assert layout.table_detail(spark, f"{root}/small").first().n_files == 20
    assert layout.compact(spark, f"{root}/small") == 20 and spark.read.parquet(f"{root}/small").count() == 1000
    assert layout.table_detail(spark, f"{root}/small").first().n_files == 1
    z = layout.zorder(df, ["a", "b"], 4, bits=5)
    assert z.columns == ["a", "b"] and z.exceptAll(df).isEmpty() and z.rdd.getNumPartitions() == 4
    facts = layout.explain_facts(spark.read.parquet(f"{root}/small").filter("a > 5").select("a"))
    assert any("GreaterThan(a,5)" in x for x in facts["pushed_filters"]) and facts["read_schema"] == ["struct<a:bigint>"]
    assert layout.plan_partitions(50 << 30) == 400
    df.write.partitionBy("b").parquet(f"{root}/parts")
    assert layout.explain_facts(spark.read.parquet(f"{root}/parts").filter("b = 3"))["partition_filters"]


def test_governance(spark):
    df = spark.createDataFrame([(1, "joe@x.org", "EU"), (2, None, "US")], "id int, email string, region string")
    assert [r.email for r in governance.masked_view(df, {"email": ["admin"]}, "guest").collect()] == [None, None]
    assert governance.masked_view(df, {"email": ["admin"]}, "admin").first().email == "joe@x.org"
    access = spark.createDataFrame([("u", "EU"), ("u", "EU")], "user_email string, region string")
    assert governance.row_filter_by_access(df, access, "u").count() == 1
    assert governance.row_filter_by_access(df, access, "v").count() == 0
    assert governance.row_filter_by_access(df, access, "v", ["admins"]).count() == 2
    masked = governance.apply_policy(governance.tagged(df, {"email": "pii"})).collect()
    assert [r.email for r in masked] == ["[REDACTED]", None]
    described = governance.describe_columns(df, {"id": "the key"}, ["region"])
    assert described.schema["id"].metadata["comment"] == "the key" and described.schema["region"].metadata["never_a_feature"]
    row = df.select(mask_email(F.col("email")).alias("a"), mask_email(F.col("email"), "lead").alias("b"), mask_partial(F.col("email"), 2).alias("c"), mask_partial(F.lit("ab"), 1, 4).alias("d")).first()
    assert tuple(row) == ("***@x.org", "j***@x.org", "jo***", "***")


def test_comments_in_the_catalog(spark):
    spark.range(2).selectExpr("id", "'x' AS name").write.mode("overwrite").saveAsTable("tarn_commented")
    try:
        governance.comment_table(spark, "tarn_commented", "people's \\ names", {"name": "isn't \"free\""})
        assert {r.column: r.comment for r in governance.table_comments(spark, "tarn_commented").collect()} == {"id": None, "name": "isn't \"free\""}
        shown = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED tarn_commented").collect()}
        assert shown["Comment"] == "people's \\ names"
        with pytest.raises(ValueError, match="no columns"):
            governance.comment_table(spark, "tarn_commented", columns={"nobody": "x"})
    finally:
        spark.sql("DROP TABLE tarn_commented")


def test_monitoring(spark, root):
    with monitoring.timed_stage(spark, f"{root}/log", "ok") as counts:
        counts["rows_in"] = 5
    with pytest.raises(RuntimeError), monitoring.timed_stage(spark, f"{root}/log", "bad"):
        raise RuntimeError
    assert {(r.stage, r.status, r.rows_in) for r in spark.read.parquet(f"{root}/log").collect()} == {("ok", "ok", 5), ("bad", "failed", 0)}
    assert monitoring.alerts(spark.createDataFrame([(5.0,), (5.1,)], "rate_pct double")).count() == 1
    assert monitoring.stale(spark.createDataFrame([], "ts timestamp"), "ts", F.current_timestamp(), 5).first().is_stale


def _series(spark, n=80):
    rows, x = [], 100.0
    for i in range(n):
        x *= 1 + ((i * 7919) % 13 - 6) / 200
        rows.append(("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), x, x, x, x, 100 + i % 7))
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long")


def test_features_see_no_future_and_match_pandas(spark):
    bars = _series(spark)
    full = features.indicators(bars).orderBy("timestamp").toPandas()
    cut = features.indicators(bars.filter("timestamp < '2024-02-20'")).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(full.loc[: len(cut) - 1, list(features.FEATURES)], cut[list(features.FEATURES)])
    assert full.rsi_14.dropna().between(0, 100).all() and full.rsi_14.isna().sum() == 14
    assert full.sma_20.isna().sum() == 19 and pd.isna(full.target_up_next.iloc[-1])
    blocks = features.recursive(bars.select("symbol", "timestamp", "close"), block=30, warm_up=1000).orderBy("timestamp").toPandas()
    pd.testing.assert_series_equal(blocks.ema_26, full.ema_26)
    assert abs(full.target_return_next.iloc[0] - (full.close.iloc[1] / full.close.iloc[0] - 1)) < 1e-12


def test_long_series_are_blocks(spark):
    bars = _series(spark, 700)
    one, many = (features.indicators(bars, block=n).orderBy("timestamp").toPandas() for n in (2_000, 90))
    assert len(one) == len(many) == 700
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)
    close = one.close
    pd.testing.assert_series_equal(one.ema_26, close.ewm(span=26, adjust=False).mean(), check_names=False, rtol=1e-9)
    macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    pd.testing.assert_series_equal(one.macd_signal, macd.ewm(span=9, adjust=False).mean(), check_names=False, rtol=1e-6, atol=1e-9)
    up, down = (x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (close.diff().clip(lower=0), (-close.diff()).clip(lower=0)))
    pd.testing.assert_series_equal(one.rsi_14, 100 * up / (up + down), check_names=False, rtol=1e-9)


def test_models_and_backtest(spark):
    sinks.observed(spark.range(3), "id > 0", lambda df: df.count())  # a session with observations
    built = features.indicators(_series(spark, 160))
    pred = models.train(built, ["A", "missing"], trees=5, boosts=3)
    assert pred.count() > 20 and set(pred.columns) >= {"pred_proba_up", "pred_return"}
    score = models.score(pred).first()
    assert 0 <= score.accuracy <= 1 and 0 <= score.auc <= 1 and score.n_test == pred.count()
    assert backtest.performance(backtest.equity(pred)).count() == 1
    assert models.train(built, ["missing"]).count() == 0


def test_auc(spark):
    rows = [("A", 0.1, 0), ("A", 0.4, 0), ("A", 0.4, 1), ("A", 0.9, 1), ("B", 0.5, 1)]
    got = {r.symbol: r.auc for r in models.auc(spark.createDataFrame(rows, "symbol string, pred_proba_up double, target_up_next int")).collect()}
    assert got == {"A": 0.875, "B": None}


def test_udfs(spark):
    udfs.register(spark)
    df = spark.createDataFrame([(None,), (1.0,), (60_000.0,), (200_000.0,)], "x double")
    rows = df.select(udfs.classify_amount("x").alias("a"), udfs.amount_band_pandas("x").alias("b"), F.expr("amount_band_sql(x)").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(v,) * 3 for v in ("UNKNOWN", "LOW", "MEDIUM", "HIGH")]


def test_write_partitions(spark, tmp_path):
    def open_fn():
        import uuid

        return open(f"{tmp_path}/{uuid.uuid4().hex}", "w")

    files.write_partitions(spark.range(10).repartition(3), open_fn, lambda f, rows: [f.write(f"{r.id}\n") for r in rows])
    assert sum(len(p.read_text().split()) for p in tmp_path.iterdir()) == 10


def test_declared_tables(spark, root):
    _write_events(spark, f"{root}/in", [(1, "a", _at(0)), (2, "b", _at(1)), (-3, "c", _at(2))])
    src = lambda _: spark.readStream.schema("id int, k string, ts timestamp").parquet(f"{root}/in")
    tables = [
        declared.Declared("bronze", src),
        declared.Declared("silver", lambda x: x.stream("bronze"), drop={"positive": "id > 0"}, warn={"known": "k IN ('a', 'c')"}),
        declared.Declared("gold", lambda x: x.read("silver").groupBy("k").agg(F.count("*").alias("n"))),
        declared.Declared("current", lambda x: changes.apply_changes(x.read("bronze"), ["k"], ["ts"])),
        *[declared.Declared(f"gold_{k}", lambda x, k=k: x.read("silver").filter(F.col("k") == k)) for k in ("a", "b")],
    ]
    layer = declared.run_tables(spark, f"{root}/p", tables)
    assert layer.read("silver").count() == 2 and layer.read("gold").count() == 2 and layer.read("current").count() == 3
    _write_events(spark, f"{root}/in", [(4, "a", _at(9))])
    declared.run_tables(spark, f"{root}/p", tables)
    assert layer.read("silver").count() == 3 and layer.read("gold_a").count() == 2
    assert [r.id for r in layer.read("current").filter("k = 'a'").collect()] == [4]
    declared.run_tables(spark, f"{root}/p", tables[1:3], full_refresh=["silver"])
    assert layer.read("silver").count() == 3
    metrics = spark.read.parquet(f"{root}/p/_metrics").collect()
    assert {(r.name, r.action) for r in metrics} == {("positive", "drop"), ("known", "warn")} and any(r.failed_records == 1 and r.passed_records == 2 for r in metrics)
    with pytest.raises(Exception, match="breaks the rule positive"):
        declared.run_tables(spark, f"{root}/p", [declared.Declared("strict", lambda x: x.read("bronze"), fail={"positive": "id > 0"})])


def test_joins_keep_their_plans(spark, sf_dir):
    from tarnlake import plans
    from tarnlake.operators import relational

    assert layout.explain_facts(plans.QUERIES["broadcast_join"](spark, sf_dir))["joins"] == ["BroadcastHashJoin"]
    left = spark.range(200).selectExpr("id", "id % 3 AS k", "timestamp_seconds(id * 37 % 1000) AS lt").union(spark.range(1).selectExpr("-1L", "0L", "CAST(NULL AS TIMESTAMP)"))
    right = spark.range(200).selectExpr("id AS rid", "id % 3 AS k", "timestamp_seconds(id * 53 % 1000) AS rt")
    for how in ("inner", "left"):
        plain = left.alias("l").join(right.alias("r"), F.expr("l.k = r.k AND rt >= lt - INTERVAL 5 SECONDS AND rt <= lt + INTERVAL 40 SECONDS"), how).select("id", "rid")
        got = relational.interval_join(left, right, "k", "lt", "rt", "-5 SECONDS", "40 SECONDS", how).select("id", "rid")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 100
    assert relational.interval_join(left, right.drop("k"), None, "lt", "rt", "0 SECONDS", "0 SECONDS").count() == left.join(right.drop("k"), F.col("lt") == F.col("rt")).count()


def test_sessions_of_rows_ask_the_store_once():
    """A key's rows cost one read and one write of its state, and no list of timers where it had no session."""
    calls = []

    class Store:
        value = None
        get = lambda self: calls.append("get") or self.value
        exists = lambda self: calls.append("exists") or self.value is not None

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        store = Store()
        getValueState = lambda self, *_: self.store
        listTimers = lambda self: calls.append("timers") or iter(())
        registerTimer = lambda self, ms: calls.append("register")

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    made = state.RowSessions("at", 600, None)
    made.init(Handle())
    out = list(made.handleInputRows((7,), iter([{"at": t * 1_000_000} for t in (700, 0, 10, 5000)]), Clock()))
    assert [(r.key, r.status, r.n_events, r.started // 1_000_000, r.last_seen // 1_000_000) for r in out] == [("7", "ENDED", 2, 0, 10), ("7", "ENDED", 1, 700, 700), ("7", "ACTIVE", 1, 5000, 5000)]
    assert calls == ["get", "update", "register"]


def test_sessions_pass_over_events_without_a_time(spark, root):
    _write_events(spark, f"{root}/in", [(1, "u", _at(0)), (2, "u", None), (3, "u", _at(60)), (4, "w", None)])
    rows = spark.readStream.schema("id int, k string, ts timestamp").parquet(f"{root}/in")
    with state.state_store(spark):
        sinks.run_to_end(state.session_state(rows, "k", "ts", 600), sink=f"{root}/o", checkpoint=f"{root}/ck")
    got = spark.read.parquet(f"{root}/o").groupBy("key").agg({"n_events": "max"}).collect()
    assert [tuple(r) for r in got] == [("u", 2)]
