import datetime as dt
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.errors import AlreadyExists, CommitConflict, DdlSinceReadSnapshot, Expired, IncarnationChanged, Invalid, NotEmpty, NotFound, OffsetRegression, ReconciliationRequired, Unsupported
from tidelake.operators import alter as al
from tidelake.operators import maintenance as mt
from tidelake.operators.catalog import Catalog
from tidelake.operators.table import Table, Transaction
from tidelake.plans.sql import sql
from tidelake.streaming.replicate import Replicator, project, row_filter, window


def points(spark, rows=((1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0))):
    return spark.createDataFrame(list(rows), "id long, name string, val double").coalesce(1)


def check_invariants(lake):
    state = lake.state()
    ids = [s["snapshot_id"] for s in state["snapshots"]]
    assert ids == list(range(state["earliest"] or 1, state["head"] + 1))
    for t in state["tables"]:
        files = sorted((f for f in state["files"].values() if str(f["table_id"]) == t and not f["explicit"]), key=lambda f: f["row_id_start"])
        for a, b in zip(files, files[1:], strict=False):
            assert a["row_id_start"] + a["record_count"] <= b["row_id_start"]
    live = [x["file_id"] for x in state["dvs"].values() if x["end"] is None]
    assert len(live) == len(set(live))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_append_travel_and_pins(spark, lake):
    t = lake.create_table("ns", "p", points(spark).schema)
    t.append(points(spark))
    first, moment = lake.head, dt.datetime.now(dt.timezone.utc)
    time.sleep(0.01)
    t.append(points(spark, [(4, "d", None)]))
    assert (t.scan().count(), t.scan(first).count(), t.scan(timestamp=moment).count(), t.count()) == (4, 3, 3, 4)
    with pytest.raises(Invalid):
        t.scan(first, moment)
    with pytest.raises(Invalid):
        t.scan(99)
    with pytest.raises(Expired):
        t.scan(timestamp=dt.datetime(2000, 1, 1))
    pinned = Catalog(spark, lake.root, snapshot=first)
    assert pinned.table("ns", "p").scan().count() == 3
    with pytest.raises(Invalid):
        pinned.create_namespace("x")
    check_invariants(lake)


def test_not_null_and_unknown_columns(spark, lake):
    t = lake.create_table("ns", "p", [{"name": "id", "type": "long", "nullable": False}, {"name": "name", "type": "string", "nullable": True}])
    with pytest.raises(Invalid):
        t.append(spark.createDataFrame([(None, "x")], "id long, name string"))
    with pytest.raises(Invalid):
        t.append(points(spark))
    t.append(spark.createDataFrame([(1,)], "id long"))
    assert rows(t.scan()) == [(1, None)]


def test_partitions_with_odd_values(spark, lake):
    df = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("__HIVE_DEFAULT_PARTITION__", 4), ("x/y=z %", 5), ("é", 6)], "k string, n long")
    t = lake.create_table("ns", "p", df.schema, partition=[("k", "identity")])
    t.append(df)
    assert rows(t.scan()) == rows(df)
    assert len(t.plan()) == 6
    assert {f["values"][0] for f, _ in t.plan()} == {"a", None, "", "__HIVE_DEFAULT_PARTITION__", "x/y=z %", "é"}
    assert [len(t.plan(where=w)) for w in ("k = 'a'", "k IS NULL", "k IS NOT NULL", "k IN ('a', 'é')", "n > 4")] == [1, 1, 5, 2, 2]
    found, cut = t.partition_values(most=3)
    assert found.count() == 3 and cut
    assert t.partitions(prefix={0: ""}).count() == 1 and t.partitions(prefix={0: "X"}).count() == 1
    assert t.lookup_partition(["é"])["totals"]["records"] == 1


def test_pruning_never_loses_rows(spark, lake):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5 - 100).alias("x"), F.timestamp_micros(F.col("id") * 10_000_000_000).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("k"), F.col("id") % 11).alias("s"))
    t = lake.create_table("ns", "p", df.schema, partition=[("ts", "day"), ("g", "bucket[3]")], sort=[("x", "desc", "first")])
    t.append(df)
    total = len(t.plan())
    for where in ("x > 50", "x <= -97.5", "x = 0", "x IS NULL", "x IS NOT NULL AND g = 3", "ts >= '1970-01-02T03:00:00' AND ts < '1970-01-05T00:00:00'", "g IN (1, 2)", "s = 'k3' AND x < 0", "-10 < x AND 20 >= id", "NOT (x > 0) OR g = 1", "ts = '1970-01-03T00:00:00' AND x > 1e9"):
        assert rows(t.scan(where=where)) == rows(df.where(where)), where
        assert len(t.plan(where=where)) <= total
    assert len(t.plan(where="ts < '1970-01-05T00:00:00'")) < total and len(t.plan(where="x > 1e9")) == 0


def test_float_bounds_and_order(spark, lake):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (None, 4), (-1.0, 5), (float("inf"), 6)], "x double, n int").coalesce(1)
    t = lake.create_table("ns", "f", df.schema, sort=[("x", "asc", "first")])
    t.append(df)
    assert [r.n for r in t.scan(lineage=True).orderBy("file_row_number").collect()] == [4, 5, 2, 1, 6, 3]
    assert t.scan(where="x = 0").count() == 2
    assert t.scan(where="x > 1e300").count() == 2  # infinity, and NaN, which Spark puts last
    assert mt.is_sorted(t).head().sorted


def test_delete_update_merge(spark, lake):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    t = lake.create_table("ns", "d", df.schema)
    t.append(df.repartition(4))
    before = lake.head
    t.delete("g = 0")
    t.delete("id < 10")
    assert rows(t.scan()) == rows(df.where("g <> 0 AND id >= 10")) and t.count() == t.scan().count()
    assert rows(t.scan(before)) == rows(df)
    top = t.scan(lineage=True).agg(F.max("rowid")).head()[0]
    t.update("id >= 90", {"g": "g + 10"})
    assert t.scan(lineage=True).where("g >= 10").agg(F.min("rowid")).head()[0] > top
    t.merge(spark.createDataFrame([(50, 99), (500, 1)], "id long, g long"), ["id"], update={"g": "s.g"})
    assert rows(t.scan(where="id IN (50, 500)")) == [(50, 99), (500, 1)]
    with pytest.raises(Invalid):
        t.merge(spark.createDataFrame([(50, 1), (50, 2)], "id long, g long"), ["id"], update={"g": "s.g"})
    n = lake.head
    t.delete("id = -5")
    assert lake.head == n
    check_invariants(lake)


def test_conflicts(spark, lake):
    t = lake.create_table("ns", "c", points(spark).schema)
    t.append(points(spark))
    at = lake.head
    t.append(points(spark), read_snapshot=at)
    t.append(points(spark), read_snapshot=at)  # appends do not conflict
    t.delete("id = 1")
    with pytest.raises(CommitConflict):
        t.delete("id = 2", read_snapshot=at)
    at = lake.head
    mt.compact(t)
    t.append(points(spark), read_snapshot=at)  # nor with compaction
    t.alter(al.add_column("z", "int"))
    with pytest.raises(DdlSinceReadSnapshot):
        t.append(points(spark), read_snapshot=at)
    old = t.uuid
    t.drop()
    lake.create_table("ns", "c", points(spark).schema)
    with pytest.raises(IncarnationChanged):
        t.append(points(spark))
    with pytest.raises(IncarnationChanged):
        lake.table("ns", "c").append(points(spark), expected_uuid=old)


def test_lost_race_rebuilds(spark, lake):
    t = lake.create_table("ns", "r", points(spark).schema)
    other = Catalog(spark, lake.root).table("ns", "r")
    a, b = t.stage(points(spark)), other.stage(points(spark))
    with Transaction(lake) as one, Transaction(other.catalog) as two:
        one.add_files(t, a)
        two.add_files(other, b)
    assert t.scan(lineage=True).select("rowid").distinct().count() == 6
    check_invariants(lake)


def test_idempotency(spark, lake):
    t = lake.create_table("ns", "i", points(spark).schema)
    first = t.append(points(spark), key="k")
    assert t.append(points(spark), key="k") == first and t.count() == 3
    with pytest.raises(CommitConflict):
        lake.commit(lambda d: d.changed("table_altered", t.id), key="k", payload="other")


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")  # an empty one has a page of up to 16m
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_scan_of_many_deleted_rows(spark, lake, small_broadcasts):
    """Positions are not broadcast, however short the list of their files is."""
    df = spark.range(700_000).coalesce(2).selectExpr("id")
    t = lake.create_table("ns", "many", df.schema)
    t.append(df)
    t.delete("id % 7 <> 3")
    t.delete("id >= 699992 OR id = 3")
    left = range(10, 699_992, 7)
    assert t.scan().agg(F.count("*"), F.min("id"), F.max("id"), F.sum("id")).head() == (len(left), left[0], left[-1], sum(left))
    assert t.scan(where="id < 40", lineage=True).where("id <> rowid").isEmpty() and rows(t.scan(where="id < 40", columns=["id"])) == [(10,), (17,), (24,), (31,), (38,)]


def test_vectors_kept_by_a_task(tmp_path, monkeypatch):
    """However few vectors a task keeps, rows of several files in one batch are held against their own."""
    import numpy as np
    import pandas as pd

    from tidelake.operators import table
    from tidelake.sources import dv

    monkeypatch.setattr(table, "KEPT_VECTORS", 4)
    rng = np.random.default_rng(1)
    sets, vectors = [np.unique(rng.integers(0, n, n // 2)) for n in (9, 8, 100, 17)], []
    for k, own in enumerate(sets):
        (tmp_path / f"{k}").write_bytes(dv.puffin(dv.encode(own), len(own), "x")[0])
        vectors.append((f"{tmp_path}/{k}", len(own), (9, 8, 100, 17)[k]))
    rows = [(k, p) for k, (_, _, n) in enumerate(vectors) for p in range(n)] * 2
    rng.shuffle(rows)
    nth, pos = (pd.Series(x) for x in zip(*rows, strict=True))
    found = table._outside(vectors).func(nth, pos)
    assert found.tolist() == [p not in sets[k] for k, p in rows]


def test_changes_of_many_rows(spark, lake, small_broadcasts):
    """Transactions and the change stream take no positions to the driver either."""
    df = spark.range(700_000).coalesce(1).selectExpr("id", "0L AS g")
    t = lake.create_table("ns", "many_changes", df.schema)
    t.append(df)
    t.delete("id = 0")
    first = lake.head
    with Transaction(lake) as tx:
        tx.delete(t, "id % 7 < 4")
        assert tx.scan(t).count() == 300_000 and t.count() == 699_999
        tx.delete(t, "id % 7 = 4")
        tx.update(t, "id % 7 = 5", {"g": "g + 1"})
        assert tx.scan(t).agg(F.count("*"), F.min("id"), F.max("id")).head() == (100_000, 6, 699_999)
    assert t.count() == 200_000 and t.scan().groupBy("g").agg(F.sum(F.col("id") % 7)).orderBy("g").collect() == [(0, 600_000), (1, 500_000)]
    assert t.changes(first).deleted().agg(F.count("*"), F.min("rowid"), F.max("rowid")).head() == (599_999, 1, 699_998)
    middle = lake.head
    t.delete("id % 700 = 6")
    assert [r.rowid for r in t.changes(middle).deleted().orderBy("rowid").collect()] == list(range(6, 700_000, 700))
    check_invariants(lake)


def test_transaction_reads_its_deletes(spark, lake):
    t = lake.create_table("ns", "x", points(spark).schema)
    t.append(points(spark))
    with Transaction(lake) as tx:
        tx.delete(t, "id = 1")
        assert tx.scan(t).count() == 2 and t.scan().count() == 3
        tx.append(t, points(spark, [(9, "n", 0.0)]))
        assert tx.scan(t).count() == 2
        with pytest.raises(Unsupported):
            tx.delete(t, "id = 2")
    assert rows(t.scan(columns=["id"])) == [(2,), (3,), (9,)]


def test_overwrite_truncate_replace(spark, lake):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    t = lake.create_table("ns", "o", df.schema, partition=[("k", "identity")])
    t.append(df)
    t.overwrite(spark.createDataFrame([("a", 5)], df.schema))
    assert rows(t.scan()) == [("a", 5), ("b", 2)]
    t.alter(al.set_partition_spec([]))
    with pytest.raises(Unsupported):
        t.overwrite(spark.createDataFrame([("a", 6)], df.schema))
    t.overwrite(spark.createDataFrame([("c", 7)], df.schema), all_files=True)
    assert rows(t.scan()) == [("c", 7)]
    t.truncate()
    assert t.count() == 0 and t.scan().count() == 0
    new = lake.replace_table("ns", "o", points(spark), expected_uuid=t.uuid)
    assert new.uuid != t.uuid and new.count() == 3
    with pytest.raises(IncarnationChanged):
        lake.replace_table("ns", "o", points(spark), expected_uuid=t.uuid)


def test_schema_evolution(spark, lake):
    df = spark.createDataFrame([(1, 2, 1.5, (7, "x"), [1, 2])], "id int, n int, f float, s struct<a:int,b:string>, l array<int>")
    t = lake.create_table("ns", "e", [{**f, "nullable": True} for f in __import__("tidelake.types", fromlist=["x"]).fields_from_spark(df.schema)], sort=[("n", "asc", "last")])
    t.append(df)
    t.alter(al.promote_column("id", "long"), al.promote_column("f", "double"), al.rename_column("n", "m"), al.add_column("s.c", "string"), al.drop_column("s.a"))
    assert rows(t.scan()) == [(1, 2, 1.5, ("x", None), [1, 2])]
    assert t.column_stats(columns=["id"]).head().lower_bound == (1).to_bytes(8, "little")
    assert len(t.plan(where="id > 1")) == 0 and len(t.plan(where="m = 2")) == 1
    for op in (al.drop_column("m"), al.promote_column("m", "string"), al.add_column("l.x", "int"), al.add_column("ID", "int"), al.drop_column("s.nope"), al.promote_column("s", "int")):
        with pytest.raises((Invalid, Unsupported)):
            t.alter(op)
    head = lake.head
    t.alter(al.set_table_comment("hi"), al.set_column_comment("id", "key"), al.set_properties({"a.b": "1"}), al.rename_table("e2"))
    info = lake.table("ns", "e2").info()
    assert (info["comment"], info["properties"], info["fields"][0]["comment"]) == ("hi", {"a.b": "1"}, "key")
    assert [f["name"] for f in t.fields(head - 1)][:2] == ["id", "n"] or head
    with pytest.raises(NotFound):
        lake.table("ns", "e")


def test_prefix_field_and_shredding(spark, lake):
    df = spark.createDataFrame([(4, 1), (42, 2), (4, 3)], "k int, n int").withColumn("v", F.parse_json(F.lit("{}")))
    t = lake.create_table("ns", "pf", df.schema, partition=[("k", "identity")])
    with pytest.raises(Invalid, match="integer"):
        t.alter(al.set_object_prefix_field("v"))
    t.alter(al.set_object_prefix_field("k"))
    t.append(df)
    t.append(df)
    t.delete("n = 3")
    mt.compact(t)
    t.delete("n = 1")
    for f, x in t.plan():
        folder = f"{t.row()['location']}/k={f['values'][0]}/"
        assert f["path"].startswith(folder) and (x is None or x["path"].startswith(folder))
    assert rows(t.scan().select("k", "n")) == [(42, 2), (42, 2)]
    for bad in (None, -1):
        with pytest.raises(Invalid, match="no value of a prefix"):
            t.append(spark.createDataFrame([(bad, 9)], "k int, n int"))
    with pytest.raises(Invalid, match="identity"):
        t.alter(al.set_partition_spec([("k", "bucket[4]")]))
    with pytest.raises(Invalid):
        t.alter(al.rename_column("k", "kk"))
    n = lake.head
    t.alter(al.set_variant_shredding("v", {"a.b": "int"}))
    t.alter(al.set_variant_shredding("v", {"a.b": "int"}))  # no change, no snapshot
    assert lake.head == n + 1


def test_compaction_keeps_rows_and_ids(spark, lake):
    df = spark.range(300).select("id", (F.col("id") % 4).cast("string").alias("g"), (-F.col("id")).alias("x"))
    t = lake.create_table("ns", "k", df.schema, partition=[("g", "identity")], sort=[("x", "asc", "last")])
    for i in range(5):
        t.append(df.where(f"id % 5 = {i}"))
    t.delete("id % 10 = 0")
    before = rows(t.scan(lineage=True).select("id", "rowid", "g"))
    done = mt.compact(t)
    assert done["files_in"] == 20 and done["files_out"] == 4
    assert rows(t.scan(lineage=True).select("id", "rowid", "g")) == before
    assert mt.is_sorted(t).where("NOT sorted").count() == 0
    assert t.count() == len(before)
    t.delete("id = 7")
    t.update("id = 11", {"x": "5"})
    assert t.scan(where="id = 11").head().x == 5 and t.count() == len(before) - 1
    assert t.changes(0).appended().count() == 301
    check_invariants(lake)


def test_changes(spark, lake):
    t = lake.create_table("ns", "ch", points(spark).schema)
    t.append(points(spark))
    a = lake.head
    t.delete("id = 1")
    t.append(points(spark, [(8, "z", 0.0)]))
    c = t.changes(a)
    assert [r.id for r in c.appended().collect()] == [8] and [r.rowid for r in c.deleted().collect()] == [0]
    whole = t.changes(0).appended().count()
    assert whole == sum(t.changes(i, i + 1).appended().count() for i in range(lake.head))
    t.truncate()
    with pytest.raises(ReconciliationRequired):
        t.changes(a)
    t.append(points(spark))
    assert t.changes(lake.head - 1).appended().count() == 3


def test_offsets_and_expiry(spark, lake):
    t = lake.create_table("ns", "x", points(spark).schema)
    for _ in range(6):
        t.append(points(spark))
    t.delete("id = 2")
    mt.compact(t)
    lake.commit_offset("c", t.uuid, 3)
    with pytest.raises(OffsetRegression):
        lake.commit_offset("c", t.uuid, 2)
    with pytest.raises(Invalid):
        lake.commit_offset("c", t.uuid, 99)
    lake.set_options(retention_seconds=1)
    future = (time.time_ns() // 1000) + 10**9
    assert mt.expire(lake, now_micros=future)["earliest"] == 3  # held by the consumer
    lake.set_options(consumer_floor=False)
    done = mt.expire(lake, now_micros=future)
    assert done["earliest"] == lake.head and done["files"] and done["vectors"]
    assert mt.cleanup(lake)["kept"] == 0
    with pytest.raises(Expired):
        t.scan(3)
    with pytest.raises(Expired):
        t.changes(1)
    assert t.scan().count() == 12
    assert mt.status(lake)["queued"] == 0 and mt.runs(lake).count() >= 3
    t.drop()
    mt.expire(lake, now_micros=future)
    mt.cleanup(lake)
    assert mt.retire(lake) == 1


def test_hydration_and_uploads(spark, lake, tmp_path):
    t = lake.create_table("ns", "h", points(spark).schema)
    t.append(points(spark), deferred_stats=True)
    assert len(t.plan(where="id > 100")) == 1  # pending statistics never prune
    assert mt.hydrate(t, small=0)["provided"] == 1
    assert len(t.plan(where="id > 100")) == 0
    mt.claim_upload(lake, "u1", str(tmp_path / "f"))
    assert mt.renew_uploads(lake, ["u1", "nope"]) == 1
    assert mt.abandon_uploads(lake, now=time.time() + 10**6) == 1 and mt.cleanup(lake)["deleted"] == 1


def test_catalog_rules(spark, lake):
    with pytest.raises(AlreadyExists):
        Catalog.create(spark, lake.root)
    folder, name = lake.root.rsplit("/", 1)
    assert Catalog.catalogs(spark, folder) == [name]
    with pytest.raises(AlreadyExists):
        lake.create_namespace("ns")
    t = lake.create_table("ns", "a", points(spark).schema)
    with pytest.raises(NotEmpty):
        lake.drop_namespace("ns")
    with pytest.raises(AlreadyExists):
        lake.create_table("ns", "a", points(spark).schema)
    lake.create_view("ns", "v", "SELECT 1 AS one")
    assert lake.views("ns") == ["v"] and lake.view("ns", "v")["dialect"] == "spark"
    lake.drop_view("ns", "v")
    t.drop()
    lake.drop_namespace("ns")
    assert lake.namespaces() == [] and lake.namespaces(1) == ["ns"]
    lake.drop()


def test_prepared_creation(spark, lake):
    lake.prepare_table("op", "ns", "q", points(spark).schema, partition=[("name", "identity")])
    with pytest.raises(NotFound):
        lake.table("ns", "q")
    with pytest.raises(CommitConflict):
        lake.prepare_table("op", "ns", "other", points(spark).schema)
    t = lake.publish_table("op", points(spark))
    assert isinstance(t, Table) and t.count() == 3 and lake.publish_table("op").id == t.id
    with pytest.raises(Invalid):
        lake.abort_table("op")


def test_checkpoints_replay(spark, lake):
    for i in range(60):
        lake.set_options(retention_seconds=i + 1)
    again = Catalog(spark, lake.root)
    assert again.state() == lake.state() and lake.store.names(f"{lake.root}/checkpoints")


def test_metadata_frames(spark, lake):
    t = lake.create_table("ns", "m", points(spark).schema)
    t.append(points(spark))
    t.append(points(spark))
    assert t.files(sort="id", descending=True, limit=1).head().begin_snapshot == lake.head
    assert [r.snapshot_id for r in lake.snapshots(before=3).collect()] == [2, 1]
    with pytest.raises(Invalid):
        lake.snapshots(1, 2)
    info = lake.table_info().head()
    assert (info.files, info.records, info.deleted) == (2, 6, 0)
    stats = {r.column: r for r in t.column_stats(file_id=t.plan()[0][0]["id"]).collect()}
    assert (stats["name"].null_count, stats["id"].lower_text, stats["id"].upper_text) == (1, "1", "3")
    assert lake.usage()["live_files"] == 2 and lake.export()["head"] == lake.head


def test_doubling(spark, lake):
    from tidelake.sources.seed import double_until

    t = lake.create_table("ns", "seed", points(spark).schema)
    t.append(points(spark))
    assert double_until(t, 10) == 10 and t.scan().count() == 10


def test_sql(spark, lake):
    for text in ("CREATE TABLE ns.t (id BIGINT NOT NULL, p DECIMAL(9,2), s STRING)", "INSERT INTO ns.t VALUES (1, 2.50, 'a'), (2, 3, 'b')"):
        sql(lake, text)
    at = lake.head
    for text in ("ALTER TABLE ns.t SET PARTITIONED BY (bucket(4, id), s)", "ALTER TABLE ns.t SET SORTED BY (p DESC NULLS FIRST)", "INSERT INTO ns.t (id, s) SELECT 3, 'c'", "UPDATE ns.t SET p = 9, s = concat(s, '!') WHERE id = 2", "DELETE FROM ns.t WHERE id = 1", "CREATE VIEW ns.v AS SELECT id, s FROM ns.t WHERE p IS NOT NULL"):
        sql(lake, text)
    assert rows(sql(lake, "SELECT t.id, s FROM ns.t ORDER BY 1")) == [(2, "b!"), (3, "c")]
    assert rows(sql(lake, "SELECT * FROM ns.v")) == [(2, "b!")]
    assert sql(lake, f"SELECT count(*) FROM ns.t AT (VERSION => {at})").head()[0] == 2
    assert sql(lake, "SELECT count(*) FROM ns.t a JOIN ns.t AS b ON a.id = b.id").head()[0] == 2
    assert sql(lake, "SELECT * FROM tide_current_snapshot()").head()[0] == lake.head
    for bad in ("MERGE INTO ns.t USING x", "CREATE INDEX i ON ns.t (id)", "DELETE FROM ns.t WHERE id = 1 RETURNING id"):
        with pytest.raises(Unsupported):
            sql(lake, bad)
    with pytest.raises(Invalid):
        sql(lake, "VACUUM")


def test_replication(spark, lake):
    src = lake.create_table("ns", "s", points(spark).schema)
    dst = lake.create_table("ns", "d", points(spark).select("id", "val").schema)
    for i in range(3):
        src.append(points(spark, [(i, "keep" if i != 1 else None, float(i))]))
    r = Replicator(src, dst, "c", ("name", "keep"), most_snapshots=2)
    while r.run_once():
        pass
    assert rows(dst.scan()) == [(0, 0.0), (2, 2.0)] and lake.offset("c", src.uuid) is not None
    src.delete("id = 0")
    with pytest.raises(Unsupported):
        while r.run_once():
            pass
    with pytest.raises(Invalid):
        row_filter("x", float("nan"))
    with pytest.raises(Invalid):
        project(src.fields(), [{"name": "id", "type": "int"}])
    assert window(5, 5, 2) is None and window(9, 5, 2) == (5, 7)


@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(2, 800))
def test_bins(sizes, target):
    groups = mt.bins([(s, i) for i, s in enumerate(sizes)], target)
    used = [i for g in groups for i in g]
    assert len(used) == len(set(used)) and all(sizes[i] < target for i in used)
    for g in groups:
        assert 2 <= len(g) <= mt.MOST_FILES
        assert len(g) >= min(mt.LEAST_FILES, target // max(sizes[i] for i in g))


@given(st.integers(0, 50), st.integers(0, 50), st.none() | st.integers(0, 99), st.none() | st.integers(0, 99), st.integers(1, 50))
def test_floor(earliest, more, fresh, offset, batch):
    head = earliest + more
    floor = mt.expiry_floor(earliest, head, fresh, offset, batch)
    assert earliest <= floor <= head
    assert floor == earliest or all(x is None or floor <= x for x in (fresh, offset)) and floor <= earliest + batch
