from pyspark.sql import functions as F

from tidelake.streaming import ingest, planner
from tidelake.streaming.source import TideChanges


def test_lanes(spark):
    rows = [(0, 10**6), (300 << 20, 0), (300 << 20, -5), (1, 6 * 3600), (2 << 20, 900), (2 << 20, 899), (1000, 900), (2 << 20, -1)]
    df = spark.createDataFrame(rows, "b long, a long")
    assert [r[0] for r in df.select(planner.lane(F.col("b"), F.col("a"))).collect()] == ["none", "size", "size", "slow", "age", "none", "none", "none"]


def test_decide_is_the_lane(spark):
    sizes, ages = [0, 1, 9, 10, 99, 100], [-1, 0, 4, 5, 59, 60, 61]
    df = spark.createDataFrame([(b, a) for b in sizes for a in ages], "b long, a long")
    limits = {"size": 100, "slow": 60, "age": 5, "floor": 10}
    for r in df.withColumn("lane", planner.lane(F.col("b"), F.col("a"), **limits)).collect():
        assert planner.decide(r.b, r.a, **limits) == r.lane


def test_flushes_by_size_and_by_timers(spark, tmp_path):
    import time

    schema = "g string, size long, t timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    due = planner.flushes(stream, ["g"], "size", "t", size_at=100, slow=12, age=4, floor=10)
    got = []
    q = due.writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend((r.g, r.records, r.staged_bytes, r.lane) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    rows = [("big", 60), ("big", 60), ("mid", 20), ("small", 1), ("small", None), ("empty", 0), (None, 200)]
    spark.createDataFrame(rows, "g string, size long").select("*", F.current_timestamp().alias("t")).write.mode("append").parquet(str(tmp_path / "in"))
    until = time.time() + 90
    while len(got) < 4 and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted(got, key=str) == [("big", 2, 120, "size"), ("mid", 1, 20, "age"), ("small", 2, 1, "slow"), (None, 1, 200, "size")]


def test_sink_is_idempotent_and_feed_streams(spark, lake, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("x"))
    t = lake.create_table("ns", "t", df.schema)
    write = ingest.sink(t, "q")
    for number in (0, 0, 1):
        write(df.where(f"id % 2 = {number}"), number)
    assert t.count() == 50
    spark.dataSource.register(TideChanges)
    stream = spark.readStream.format("tide_changes").option("root", lake.root).option("namespace", "ns").option("table", "t").load()
    got = []
    q = stream.writeStream.foreachBatch(lambda b, i: got.extend(r.id for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    t.append(df.where("id < 5"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == sorted([*range(50), *range(5)])


def test_classify(spark):
    from tidelake import types as ty

    fields, _ = ty.assign_ids([{"name": "a", "type": "int"}, {"name": "s", "type": "struct", "children": [{"name": "b", "type": "string"}]}], 1)
    df = spark.createDataFrame([('{"a":1,"s":{"b":"x"},"z":0}',), ('{"a":"1"}',), ("no",), (None,), ("[1]",)], "v string")
    out = ingest.classify(df, F.col("v"), fields)
    assert [(r.a, r.drop_reason) for r in out.collect()] == [(1, None), (None, "int: not an integer"), (None, "record: not JSON"), (None, "record: no value"), (None, "record: not an object")]
    assert ingest.drop_counts(out).count() == 4
    staged = spark.createDataFrame([("g", 2 << 20, 0), ("h", 10, 0)], "g string, size long, t long").withColumn("t", F.timestamp_seconds("t"))
    lanes = {r.g: r.lane for r in ingest.flush_groups(staged, ["g"], "size", "t", F.timestamp_seconds(F.lit(1000))).collect()}
    assert lanes == {"g": "age", "h": "none"}


def read_feed(spark, lake, name, tmp_path, tag):
    spark.dataSource.register(TideChanges)
    stream = spark.readStream.format("tide_changes").option("root", lake.root).option("namespace", "ns").option("table", name).load()
    got = []
    q = stream.writeStream.foreachBatch(lambda b, i: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / tag)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(got)


def test_feed_of_a_promoted_column(spark, lake, tmp_path):
    from tidelake.operators import alter as al

    t = lake.create_table("ns", "p", spark.createDataFrame([], "n int, x float").schema)
    t.append(spark.createDataFrame([(1, 0.5)], "n int, x float"))
    t.alter(al.promote_column("n", "long"), al.promote_column("x", "double"))
    t.append(spark.createDataFrame([(1 << 40, 0.25)], "n long, x double"))
    assert read_feed(spark, lake, "p", tmp_path, "c") == [(1, 0.5), (1 << 40, 0.25)]


def test_feed_refuses_deleted_rows(spark, lake, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    t = lake.create_table("ns", "d", spark.range(1).schema)
    t.append(spark.range(20))
    t.delete("id < 5")
    with pytest.raises(StreamingQueryException, match="deleted"):
        read_feed(spark, lake, "d", tmp_path, "c")


def test_files_without_field_ids_go_by_name(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import types as T

    from tidelake.streaming import source

    pq.write_table(pa.table({"B": ["x", "y"], "a": pa.array([1, 2], pa.int32())}), tmp_path / "f.parquet")
    reader = object.__new__(source._Reader)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    reader.names, reader.ids, reader.arrow = ["a", "b", "c"], {"a": 1, "b": 2, "c": 3}, source.to_arrow_schema(schema)
    (batch,) = list(reader.read(source._File(str(tmp_path / "f.parquet"))))
    assert batch.to_pydict() == {"a": [1, 2], "b": ["x", "y"], "c": [None, None]}


def test_uuid_text(spark):
    import uuid

    u = uuid.uuid4()
    rows = spark.createDataFrame([(u.bytes,), (b"short",), (None,)], "b binary").select(ingest.uuid_text(F.col("b"))).collect()
    assert [r[0] for r in rows] == [str(u), None, None]
