"""Queries of the table engine and the SQL that each must agree with.

Every query writes its input into tables and reads it back through the engine,
so agreement shows the operator at work and not only Spark.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as ty
from ..functions import transforms
from ..functions.coerce import coerce_json
from ..errors import Expired, Invalid, ReconciliationRequired
from ..functions.variant import canonical_json as canonical
from ..functions.variant import get, to_variant
from ..operators import alter as al
from ..operators import maintenance
from ..operators.catalog import Catalog
from ..operators.table import Table
from ..sources.seed import double_until
from ..sources.store import local
from ..streaming import ingest, planner
from ..streaming.replicate import Replicator
from . import algebra, sql
from .workspace import catalog, filled, fresh, load, new_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def lineitem(spark: SparkSession, d: str) -> Table:
    return table(spark, d, "lineitem", lambda lake: filled(lake, load(spark, d, "lineitem"), partition=[("l_returnflag", "identity")], sort=[("l_shipdate", "asc", "last")]))


def orders(spark: SparkSession, d: str) -> Table:
    """Ordered by date over many files, so that bounds prune."""
    return table(spark, d, "orders", lambda lake: filled(lake, load(spark, d, "orders").repartitionByRange(8, "o_orderdate"), sort=[("o_orderdate", "asc", "last")]))


def events(spark: SparkSession, d: str) -> Table:
    """Two snapshots: even ids, then odd ones; partitioned by day."""
    src = load(spark, d, "events")
    return table(spark, d, "events", lambda lake: filled(lake, src.where("event_id % 2 = 0"), src.where("event_id % 2 = 1"), partition=[("ts", "day")]))


def money(c: str) -> Column:
    """A sum that does not depend on the order of addition."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


# -- scans


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem WHERE l_orderkey % 10 <> 3 AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "flagship", lambda lake: _deleted(filled(lake, load(spark, d, "lineitem"), partition=[("l_returnflag", "identity")], sort=[("l_shipdate", "asc", "last")]), "l_orderkey % 10 = 3"))
    rows = t.scan(where="l_shipdate < timestamp_ntz '2000-01-01 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_extendedprice").alias("price"))


def _deleted(t: Table, where: str) -> Table:
    t.delete(where)
    return t


def entry(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).scan(where="l_quantity < 5 AND l_returnflag = 'R'", columns=["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def partition_prune_identity(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem(spark, d)
    where = "l_returnflag IN ('A', 'N')"
    assert len(t.plan(where=where)) < len(t.plan())
    return t.scan(where=where).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00' GROUP BY 1")
def partition_prune_day(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    where = "ts >= '2024-01-05T00:00:00' AND ts < '2024-01-06T12:00:00'"
    assert len(t.plan(where=where)) < len(t.plan())
    return t.scan(where=where).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-03-01'")
def zone_map_prune(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    where = "o_orderdate >= '1998-01-01' AND o_orderdate < '1998-03-01'"
    assert len(t.plan(where=where)) < len(t.plan())
    return t.scan(where=where, columns=["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 3")
def count_star_metadata(spark: SparkSession, d: str) -> DataFrame:
    flagship(spark, d)
    t = table(spark, d, "flagship", None)
    return spark.createDataFrame([(t.count(),)], "n long")


@query("SELECT CAST(count(*) AS BIGINT) AS records, true AS ordered, true AS paged, true AS offsets FROM lineitem WHERE l_returnflag = 'A'")
def files_listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Files of one stored partition value, largest first, page by page; every row group's start is known."""
    t = lineitem(spark, d)
    whole = t.files(sort="record_count", descending=True, partition={0: "A"}).collect()
    pages = [r for k in range(len(whole)) for r in t.files(sort="record_count", descending=True, partition={0: "A"}, limit=1, offset=k).collect()]
    sizes = [r.record_count for r in whole]
    return spark.createDataFrame([(sum(sizes), sizes == sorted(sizes, reverse=True), pages == whole, all(r.split_offsets[0] >= 4 and r.split_offsets == sorted(r.split_offsets) for r in whole))], "records long, ordered boolean, paged boolean, offsets boolean")


@query("SELECT l_returnflag AS part, CAST(count(*) AS BIGINT) AS records FROM lineitem GROUP BY 1")
def files_listing_rows(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).files().groupBy(F.col("partition_values")[0].alias("part")).agg(F.sum("record_count").alias("records"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0")
def time_travel_version(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    return t.scan(_snapshots_of(t)[0], columns=["event_id", "user_id"])


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0")
def time_travel_timestamp(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    first = _snapshots_of(t)[0]
    (micros,) = (s["time"] for s in t.catalog.state()["snapshots"] if s["snapshot_id"] == first)
    moment = dt.datetime.fromtimestamp(micros // 1_000_000, dt.timezone.utc).replace(microsecond=micros % 1_000_000)
    return t.scan(timestamp=moment, columns=["event_id", "value"])


def _snapshots_of(t: Table) -> list[int]:
    return [s["snapshot_id"] for s in t.catalog.state()["snapshots"] if ["table_inserted_into", t.id] in s["changes"]]


@query("SELECT CAST(event_id % 2 AS BIGINT) AS nth, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def append_two_snapshots(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    first = _snapshots_of(t)[0]
    return t.scan(lineage=True).groupBy((F.col("snapshot_id") > first).cast("long").alias("nth")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS rowid FROM orders")
def rowid_lineage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders_by_key", lambda lake: filled(lake, load(spark, d, "orders").orderBy("o_orderkey")))
    return t.scan(lineage=True).select("o_orderkey", "rowid")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS lowest FROM orders")
def virtual_file_columns(spark: SparkSession, d: str) -> DataFrame:
    """Positions are 0 to n-1 in each file, whatever the split."""
    per_file = orders(spark, d).scan(lineage=True).groupBy("filename").agg(F.count("*").alias("n"), F.count_distinct("file_row_number").alias("d"), F.max("file_row_number").alias("m"))
    return per_file.agg(F.sum("n").alias("n"), F.min(((F.col("d") == F.col("n")) & (F.col("m") == F.col("n") - 1)).cast("long")).alias("lowest"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, label FROM embeddings")
def scan_nested_list(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings", lambda lake: filled(lake, load(spark, d, "embeddings")))
    return t.scan().select("vec_id", F.size("embedding").cast("long").alias("dims"), "label")


# -- row-level changes


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' OR value > 90)")
def delete_dv(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "events"))
    t.delete("event_type = 'error'")
    t.delete("value > 90")
    return t.scan(columns=["event_id", "event_type"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def update_dv(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "orders"))
    t.update("o_orderstatus = 'P'", {"o_orderstatus": "'PENDING'", "o_custkey": "o_custkey + 1"})
    return t.scan(columns=["o_orderkey", "o_orderstatus", "o_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MERGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 5 = 0")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    t = filled(catalog(spark, d), src)
    changed = src.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("MERGED"))
    new = src.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    t.merge(changed.union(new), ["c_custkey"], update={"c_mktsegment": "s.c_mktsegment"})
    return t.scan()


@query("SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderstatus, o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F'")
def overwrite_partition(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    t = filled(catalog(spark, d), src, partition=[("o_orderstatus", "identity")])
    t.overwrite(src.where("o_orderstatus = 'F'").withColumn("o_orderkey", F.col("o_orderkey") + 1))
    return t.scan()


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def truncate_then_append(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "customer")
    t = filled(catalog(spark, d), src)
    t.truncate()
    t.append(src.where("c_nationkey = 7"))
    return t.scan(columns=["c_custkey", "c_name"])


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, CAST(1 AS BIGINT) AS snapshots")
def multi_table_commit(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.table import Transaction

    lake = catalog(spark, d)
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    a, b = new_table(lake, c), new_table(lake, s)
    before = lake.head
    with Transaction(lake) as t:
        t.append(a, c)
        t.append(b, s)
    return spark.createDataFrame([(a.count(), b.count(), lake.head - before)], "customers long, suppliers long, snapshots long")


@query("SELECT count(*) AS n FROM customer")
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "customer")
    t = new_table(catalog(spark, d), src)
    for _ in range(2):
        t.append(src, key=f"once-{t.uuid}")
    return t.scan().agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def create_table_as_select(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return catalog(spark, d).create_table_as("lake", f"ctas_{id(joined)}", joined).scan()


@query("SELECT s_suppkey, s_name FROM supplier")
def replace_table(spark: SparkSession, d: str) -> DataFrame:
    lake = catalog(spark, d)
    name = f"replaced_{lake.head}"
    old = lake.create_table_as("lake", name, load(spark, d, "nation"))
    return lake.replace_table("lake", name, load(spark, d, "supplier").select("s_suppkey", "s_name"), expected_uuid=old.uuid).scan()


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def prepared_table_creation(spark: SparkSession, d: str) -> DataFrame:
    lake = catalog(spark, d)
    src = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    operation = f"op-{lake.head}"
    lake.prepare_table(operation, "lake", f"prepared_{lake.head}", src.schema, sort=[("s_acctbal", "desc", "last")])
    lake.publish_table(operation, src)
    return lake.publish_table(operation).scan()


# -- definitions


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation")
def add_column_null(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "supplier").select("s_suppkey"))
    t.alter(al.add_column("note", "string"))
    t.append(load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("note")))
    return t.scan()


@query("SELECT s_suppkey AS id, s_name AS title FROM supplier")
def rename_column(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "supplier").select("s_suppkey", "s_name"))
    t.alter(al.rename_column("s_suppkey", "id"), al.rename_column("s_name", "title"))
    return t.scan()


@query("SELECT s_suppkey, CAST(NULL AS BIGINT) AS s_name FROM supplier")
def drop_column_and_reuse_name(spark: SparkSession, d: str) -> DataFrame:
    """A new column of an old name is another column: the old values do not come back."""
    t = filled(catalog(spark, d), load(spark, d, "supplier").select("s_suppkey", "s_name"))
    t.alter(al.drop_column("s_name"))
    t.alter(al.add_column("s_name", "long"))
    return t.scan()


@query("SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier UNION ALL SELECT s_suppkey + 3000000000 FROM supplier")
def promote_int_long(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "supplier")
    t = filled(catalog(spark, d), src.select(F.col("s_nationkey").alias("k")))
    t.alter(al.promote_column("k", "long"))
    t.append(src.select((F.col("s_suppkey") + 3000000000).alias("k")))
    return t.scan()


@query("SELECT CAST(CAST(s_nationkey AS FLOAT) AS DOUBLE) AS x FROM supplier UNION ALL SELECT s_acctbal FROM supplier")
def promote_float_double(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "supplier")
    t = filled(catalog(spark, d), src.select(F.col("s_nationkey").cast("float").alias("x")))
    t.alter(al.promote_column("x", "double"))
    t.append(src.select(F.col("s_acctbal").alias("x")))
    return t.scan()


@query("SELECT s_suppkey, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS city FROM supplier")
def nested_add_field(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_nationkey").alias("nat")).alias("home")))
    t.alter(al.add_column("home.city", "string"), al.rename_column("home.nat", "nation"))
    return t.scan().select("s_suppkey", "home.nation", "home.city")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(2 AS BIGINT) AS specs FROM orders WHERE o_orderpriority = '1-URGENT'")
def partition_spec_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Files keep the specification they were written under, and prune by it."""
    src = load(spark, d, "orders")
    t = filled(catalog(spark, d), src.where("o_orderkey % 2 = 0"), partition=[("o_orderstatus", "identity")])
    t.alter(al.set_partition_spec([("o_orderpriority", "identity")]))
    t.append(src.where("o_orderkey % 2 = 1"))
    return t.scan(where="o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n")).withColumn("specs", F.lit(len({f["spec_id"] for f, _ in t.plan()})).cast("long"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def stored_view(spark: SparkSession, d: str) -> DataFrame:
    lake = catalog(spark, d)
    name = f"rich_{lake.head}"
    t = lake.create_table_as("lake", f"customer_{lake.head}", load(spark, d, "customer"))
    lake.create_view("lake", name, f"SELECT * FROM lake.{t.info()['name']} WHERE c_acctbal > 5000")
    return sql.sql(lake, f"SELECT c_nationkey, count(*) AS n FROM lake.{name} GROUP BY 1")


# -- partition transforms


_EVENT_PARTS = {
    "year": "CAST(year(ts) - 1970 AS INTEGER)",
    "month": "CAST((year(ts) - 1970) * 12 + month(ts) - 1 AS INTEGER)",
    "day": "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)",
    "hour": "CAST(floor(epoch(ts) / 3600) AS INTEGER)",
}


def _transform_query(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = filled(catalog(spark, d), load(spark, d, "events").select("event_id", "ts"), partition=[("ts", name)])
        files = t.files().select(F.col("partition_values")[0].cast("int").alias("part"), "record_count")
        return files.groupBy("part").agg(F.sum("record_count").alias("n"))

    run.__name__ = f"transform_{name}"
    query(f"SELECT {_EVENT_PARTS[name]} AS part, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")(run)


for _name in ("year", "month", "day", "hour"):
    _transform_query(_name)


@query("SELECT p_partkey, CAST(p_partkey - ((p_partkey % 7) + 7) % 7 AS BIGINT) AS whole, substr(p_name, 1, 5) AS head FROM part")
def transform_truncate(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "part"))
    return t.scan().select("p_partkey", transforms.apply("truncate[7]", "long", F.col("p_partkey")).alias("whole"), transforms.apply("truncate[5]", "string", F.col("p_name")).alias("head"))


def _bucket_sql(column: str, relation: str, n: int) -> str:
    """Murmur3 over eight bytes in masked integer arithmetic, one step to a CTE."""
    times = lambda x, c: f"((((({x}) >> 16) * {c} & 65535) << 16) + (({x}) & 65535) * {c} & 4294967295)"
    turned = lambda x, r: f"(((({x}) & {(1 << (32 - r)) - 1}) << {r}) | (({x}) >> {32 - r}))"
    steps, now = [f"s0 AS (SELECT *, {column} & 4294967295 AS w0, ({column} >> 32) & 4294967295 AS w1, CAST(0 AS BIGINT) AS h0 FROM {relation})"], 0

    def step(**named: str) -> None:
        nonlocal now
        steps.append(f"s{now + 1} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in named.items()) + f" FROM s{now})")
        now += 1

    for i in (0, 1):
        step(**{f"a{i}": times(f"w{i}", 3432918353)})
        step(**{f"b{i}": turned(f"a{i}", 15)})
        step(**{f"c{i}": times(f"b{i}", 461845907)})
        step(**{f"d{i}": f"xor(h{i}, c{i})"})
        step(**{f"e{i}": turned(f"d{i}", 13)})
        step(**{f"h{i + 1}": f"({times(f'e{i}', 5)} + 3864292196) & 4294967295"})
    step(f0="xor(h2, 8)")
    step(f1="xor(f0, f0 >> 16)")
    step(f2=times("f1", 2246822507))
    step(f3="xor(f2, f2 >> 13)")
    step(f4=times("f3", 3266489909))
    step(f5="xor(f4, f4 >> 16)")
    return f"WITH {', '.join(steps)} SELECT {column}, CAST((f5 & 2147483647) % {n} AS INTEGER) AS bucket FROM s{now}"


def _text_bucket_sql(key: str, column: str, relation: str, n: int) -> str:
    """Murmur3 over a text's UTF-8 bytes: whole words folded by list_reduce, then the rest and the length."""
    m = 4294967296
    turned = lambda x, r: f"({x} * {1 << r} % {m} + {x} // {1 << (32 - r)})"
    mixed = lambda x: f"list_transform(list_transform(list_transform({x}, lambda w: CAST(CAST(w AS HUGEINT) * 3432918353 % {m} AS BIGINT)), lambda w: {turned('w', 15)}), lambda w: w * 461845907 % {m})"
    byte = lambda i: f"CAST(concat('0x', substr(x, 2 * ({i}) + 1, 2)) AS BIGINT)"
    return (
        f"WITH a AS (SELECT {key}, hex(encode({column})) AS x FROM {relation}), b AS (SELECT *, length(x) // 2 AS n FROM a), "
        f"c AS (SELECT *, list_transform(range(0, n // 4), lambda i: {byte('4 * i')} + {byte('4 * i + 1')} * 256 + {byte('4 * i + 2')} * 65536 + {byte('4 * i + 3')} * 16777216) AS words, "
        f"coalesce(list_sum(list_transform(range(n // 4 * 4, n), lambda i: {byte('i')} * CAST(256 ** (i % 4) AS BIGINT))), 0)::BIGINT AS rest FROM b), "
        f"d AS (SELECT *, list_reduce(list_concat([CAST(0 AS BIGINT)], {mixed('words')}), lambda h, k: ({turned('xor(h, k)', 13)} * 5 + 3864292196) % {m}) AS h, {mixed('[rest]')}[1] AS tail FROM c), "
        f"e AS (SELECT {key}, xor(xor(h, CASE WHEN n % 4 > 0 THEN tail ELSE 0 END), n) AS h FROM d), "
        f"f AS (SELECT {key}, CAST(CAST(xor(h, h // 65536) AS HUGEINT) * 2246822507 % {m} AS BIGINT) AS h FROM e), "
        f"g AS (SELECT {key}, CAST(CAST(xor(h, h // 8192) AS HUGEINT) * 3266489909 % {m} AS BIGINT) AS h FROM f) "
        f"SELECT {key}, CAST((xor(h, h // 65536) % 2147483648) % {n} AS INTEGER) AS bucket FROM g"
    )


@query(f"SELECT bucket AS part, count(*) AS n FROM ({_bucket_sql('o_orderkey', 'orders', 16)}) GROUP BY 1")
def transform_bucket_long(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "orders").select("o_orderkey"), partition=[("o_orderkey", "bucket[16]")])
    return t.files().groupBy(F.col("partition_values")[0].cast("int").alias("part")).agg(F.sum("record_count").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_totalprice > 0) AS BIGINT) AS positive FROM orders WHERE o_custkey = 42")
def bucket_prune(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders_by_customer", lambda lake: filled(lake, load(spark, d, "orders"), partition=[("o_custkey", "bucket[8]")]))
    assert len(t.plan(where="o_custkey = 42")) == 1
    return t.scan(where="o_custkey = 42").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 0).alias("positive"))


@query(_text_bucket_sql("c_custkey", "c_name", "customer", 16))
def transform_bucket_string(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer", lambda lake: filled(lake, load(spark, d, "customer")))
    return t.scan().select("c_custkey", transforms.apply("bucket[16]", "string", F.col("c_name")).alias("bucket"))


@query("SELECT CAST(row_number() OVER (ORDER BY files DESC, value) AS BIGINT) AS place, value, files FROM (SELECT strftime(ts, '%Y-%m-%d') AS value, count(DISTINCT hour(ts) % 3) AS files FROM events GROUP BY 1) ORDER BY place LIMIT 5")
def partition_values_topk(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of a partition key and in how many files each is: one for each of up to three appends."""
    src = load(spark, d, "events").select("event_id", "ts")
    t = table(spark, d, "events_thrice", lambda lake: filled(lake, *(src.where(F.hour("ts") % 3 == k).coalesce(1) for k in range(3)), partition=[("ts", "day")]))
    found, cut = t.partition_values(most=5)
    rows = [(i + 1, transforms.display("day", "timestamp", r.value), r.files) for i, r in enumerate(found.collect())]
    assert cut == (t.files().select(F.col("partition_values")[0]).distinct().count() > 5)
    return spark.createDataFrame(rows, "place long, value string, files long")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def partition_decode(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).partitions().groupBy(F.col("decoded")[0].alias("day")).agg(F.sum("records").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS records FROM lineitem WHERE l_returnflag = 'A'")
def partition_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = lineitem(spark, d).lookup_partition(["A"])
    return spark.createDataFrame([(found["totals"]["records"],)], "records long")


# -- statistics


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(l_orderkey) AS BIGINT) AS nulls, CAST(min(l_orderkey) AS VARCHAR) AS low, CAST(max(l_orderkey) AS VARCHAR) AS high FROM lineitem")
def column_stats_file_merge(spark: SparkSession, d: str) -> DataFrame:
    stats = lineitem(spark, d).column_stats(columns=["l_orderkey"])
    number = lambda c: F.col(c).cast("long")
    return stats.agg(F.sum("value_count").alias("n"), F.sum("null_count").alias("nulls"), F.min(number("lower_text")).cast("string").alias("low"), F.max(number("upper_text")).cast("string").alias("high"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(o_orderpriority) AS low, max(o_orderpriority) AS high FROM orders")
def hydrate_deferred_stats(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "orders")
    t = new_table(catalog(spark, d), src)
    t.append(src, deferred_stats=True)
    assert t.files().where("stats_state = 'pending'").count()
    maintenance.hydrate(t, small=0)
    return t.column_stats(columns=["o_orderpriority"]).agg(F.sum("value_count").alias("n"), F.min("lower_text").alias("low"), F.max("upper_text").alias("high"))


# -- maintenance


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS rowid FROM orders QUALIFY o_orderkey % 7 <> 0")
def rowid_stable_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "orders").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey"))
    t.delete("o_orderkey % 7 = 0")
    done = maintenance.compact(t)
    assert done["files_out"] < done["files_in"]
    return t.scan(lineage=True).select("o_orderkey", "rowid")


@query("SELECT event_id, user_id, value FROM events WHERE user_id % 4 <> 0")
def compaction_unsorted(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "events").repartition(8))
    t.delete("user_id % 4 = 0")
    maintenance.compact(t)
    return t.scan(columns=["event_id", "user_id", "value"])


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS sorted FROM events")
def compaction_sorted(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "events").repartition(8), sort=[("value", "desc", "last"), ("event_id", "asc", "last")])
    maintenance.compact(t)
    return maintenance.is_sorted(t).agg(F.min("sorted").alias("sorted")).crossJoin(spark.createDataFrame([(t.count(),)], "n long")).select("n", "sorted")


@query("SELECT event_id FROM events")
def expiry_and_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """What is still visible survives the removal of everything that is not."""
    lake = fresh(spark)
    t = filled(lake, load(spark, d, "events").repartition(6))
    maintenance.compact(t)
    lake.set_options(retention_seconds=1)
    done = maintenance.expire(lake, now_micros=4_000_000_000_000_000)
    assert done["files"] and maintenance.cleanup(lake)["deleted"]
    return t.scan(columns=["event_id"])


@query("SELECT k AS earliest, greatest(k, least(k + 9, k % 5 + 4, k % 7 + 3, k + 6)) AS floor FROM (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region)")
def expiry_floor_math(spark: SparkSession, d: str) -> DataFrame:
    keys = [r.k for r in load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k")).collect()]
    return spark.createDataFrame([(k, maintenance.expiry_floor(k, k + 9, k % 5 + 4, k % 7 + 3, 6)) for k in keys], "earliest long, floor long")


@query("SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) AS groups, count(*) AS files FROM (SELECT DISTINCT CAST(ts AS DATE), event_id % 6 FROM events WHERE event_id < 100000) GROUP BY () HAVING count(*) > 0")
def compaction_bin_packing(spark: SparkSession, d: str) -> DataFrame:
    """Small files of one size each are grouped by at most 64: the files are as many as days and appends."""
    pairs = load(spark, d, "events").where("event_id < 100000").select(F.to_date("ts").alias("day"), F.expr("event_id % 6").alias("k")).distinct()
    t = table(spark, d, "pairs", lambda lake: filled(lake, pairs.repartition(1), max_rows=1))
    found = maintenance.bins([(1 << 10, f["id"]) for f, _ in t.plan()], 512 << 20)
    return spark.createDataFrame([(len(found) + (t.totals(t.catalog.head)["files"] % 64 in (1, 2, 3, 4)), t.totals(t.catalog.head)["files"])], "groups long, files long")


@query("SELECT CAST(count(*) AS BIGINT) AS partitions, CAST(sum(n) AS BIGINT) AS deleted FROM (SELECT l_returnflag, sum(CASE WHEN l_orderkey % 10 = 3 THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)")
def partition_debt(spark: SparkSession, d: str) -> DataFrame:
    flagship(spark, d)
    t = table(spark, d, "flagship", None)
    return maintenance.debt(t.catalog).where(F.col("table_id") == t.id).agg(F.count_distinct("partition_values").alias("partitions"), F.sum("deleted").alias("deleted"))


# -- changes and streams


@query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def changefeed_appends(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d)
    return t.changes(_snapshots_of(t)[0]).appended().select("event_id")


@query("SELECT o_orderkey FROM orders")
def changefeed_skips_compaction(spark: SparkSession, d: str) -> DataFrame:
    t = filled(catalog(spark, d), load(spark, d, "orders").repartition(6))
    maintenance.compact(t)
    return t.changes(0).appended().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0")
def changefeed_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Deleted row ids of a window, resolved to the rows that an older snapshot had."""
    t = filled(catalog(spark, d), load(spark, d, "orders").repartition(3))
    t.delete("o_orderkey % 5 = 0")
    before = t.catalog.head
    t.delete("o_orderkey % 11 = 0")
    gone = t.changes(before).deleted().select("rowid")
    old = t.changes(0, before).appended(lineage=True).select("o_orderkey", "rowid")
    return old.join(gone, "rowid").select("o_orderkey")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def replication_filter(spark: SparkSession, d: str) -> DataFrame:
    src = events(spark, d)
    target = new_table(catalog(spark, d), load(spark, d, "events").select("event_id", "user_id", "value"))
    replicator = Replicator(src, target, f"copy-{target.id}", ("event_type", "click"), most_snapshots=3)
    while replicator.run_once():
        pass
    return target.scan()


@query("SELECT event_id, user_id FROM events WHERE value >= 10")
def streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A file stream into a table, batch by batch; replayed batches add nothing."""
    src = load(spark, d, "events")
    t = new_table(catalog(spark, d), src.select("event_id", "user_id"))
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    write = ingest.sink(t, f"ingest-{t.id}", lambda b: b.where("value >= 10").select("event_id", "user_id"))

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    q = stream.writeStream.foreachBatch(twice).trigger(availableNow=True).option("checkpointLocation", f"{t.catalog.root}/checkpoint-{t.id}").start()
    q.awaitTermination()
    return t.scan()


@query("SELECT event_id, value FROM events")
def streaming_changefeed(spark: SparkSession, d: str) -> DataFrame:
    """The changefeed as a stream into another table."""
    from ..streaming.source import TideChanges

    src = events(spark, d)
    target = new_table(catalog(spark, d), load(spark, d, "events").select("event_id", "value"))
    spark.dataSource.register(TideChanges)
    stream = spark.readStream.format("tide_changes").option("root", src.catalog.root).option("namespace", "lake").option("table", src.info()["name"]).load()
    write = ingest.sink(target, f"feed-{target.id}", lambda b: b.select("event_id", "value"))
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{src.catalog.root}/feed-{target.id}").start()
    q.processAllAvailable()
    q.stop()
    return target.scan()


@query("SELECT event_type, count(*) AS records, CASE WHEN sum(octet_length(encode(props))) >= 2000000 THEN 'size' WHEN sum(octet_length(encode(props))) >= 1000 THEN 'age' ELSE 'none' END AS lane FROM events GROUP BY 1")
def flush_planner_lanes(spark: SparkSession, d: str) -> DataFrame:
    staged = events(spark, d).scan().withColumn("size", F.octet_length("props"))
    found = staged.groupBy("event_type").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))
    return found.select("event_type", "records", planner.lane(F.col("bytes"), F.lit(1000), size=2_000_000, floor=1000).alias("lane"))


@query("SELECT user_id, count(*) AS records, CAST(sum(octet_length(encode(props))) AS BIGINT) AS staged_bytes, CASE WHEN sum(octet_length(encode(props))) >= 600 THEN 'size' ELSE 'slow' END AS lane FROM events GROUP BY 1")
def flush_planner_stateful(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a stream, held as state until one is due by its bytes or its age."""
    src = load(spark, d, "events")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("size", F.octet_length("props"))
    due = planner.flushes(stream, ["user_id"], "size", "ts", size_at=600).drop("first_staged")
    t = new_table(catalog(spark, d), due)
    q = due.writeStream.outputMode("append").foreachBatch(ingest.sink(t, f"flushes-{t.id}")).trigger(once=True).option("checkpointLocation", f"{t.catalog.root}/flushes-{t.id}").start()
    q.awaitTermination()
    return t.scan()


# -- values


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS drop_reason FROM events")
def json_coerce_events(spark: SparkSession, d: str) -> DataFrame:
    fields, _ = ty.assign_ids([{"name": "k", "type": "int"}], 1)
    rows = events(spark, d).scan().withColumn("r", coerce_json(F.col("props"), fields))
    return rows.select("event_id", "r.k", "r.drop_reason")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_extract_props(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "events").select("event_id", to_variant(F.col("props")).alias("v"))
    t = table(spark, d, "variants", lambda lake: filled(lake, src))
    return t.scan().select("event_id", get(F.col("v"), "$.k", "long").alias("k"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events")
def event_date_derive(spark: SparkSession, d: str) -> DataFrame:
    return ingest.derive_event_columns(events(spark, d).scan()).select("event_id", F.col("event_date").cast("string"))


# -- catalog and SQL


@query("SELECT 'lineitem' AS source, CAST(count(*) AS BIGINT) AS live FROM lineitem")
def table_info_totals(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem(spark, d)
    return t.catalog.table_info().where(F.col("table_id") == t.id).select(F.lit("lineitem").alias("source"), (F.col("records") - F.col("deleted")).alias("live"))


@query("SELECT count(*) + 2 AS snapshots, CAST(1 AS BIGINT) AS dense FROM region")
def snapshot_listing(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for the namespace, one for the table, one for each append; ids have no gaps."""
    lake = fresh(spark)
    src = load(spark, d, "region")
    filled(lake, *(src.where(F.col("r_regionkey") == r.r_regionkey) for r in src.select("r_regionkey").collect()))
    ids = lake.snapshots().select("snapshot_id")
    return ids.agg(F.count("*").alias("snapshots"), (F.max("snapshot_id") == F.count("*")).cast("long").alias("dense"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def sql_front_end(spark: SparkSession, d: str) -> DataFrame:
    lake = fresh(spark)
    load(spark, d, "supplier").createOrReplaceTempView("raw_supplier")
    for text in (
        "CREATE TABLE lake.s (s_suppkey BIGINT NOT NULL, s_nationkey INT, s_acctbal DOUBLE)",
        "INSERT INTO lake.s SELECT s_suppkey, s_nationkey, s_acctbal FROM raw_supplier",
        "ALTER TABLE lake.s ADD COLUMN note STRING",
        "UPDATE lake.s SET note = 'odd' WHERE s_suppkey % 2 = 1",
        "DELETE FROM lake.s WHERE note = 'odd'",
        "CALL tide_compact('lake.s')",
    ):
        sql.sql(lake, text)
    return sql.sql(lake, "SELECT s_nationkey, count(*) AS n FROM lake.s GROUP BY 1")


@query("SELECT count(*) AS then_n, (SELECT count(*) FROM region) AS now_n FROM nation")
def sql_at_version(spark: SparkSession, d: str) -> DataFrame:
    lake = fresh(spark)
    t = filled(lake, load(spark, d, "nation").select(F.col("n_nationkey").alias("k")))
    at, name = lake.head, t.info()["name"]
    t.overwrite(load(spark, d, "region").select(F.col("r_regionkey").alias("k")), all_files=True)
    return sql.sql(lake, f"SELECT (SELECT count(*) FROM lake.{name} AT (VERSION => {at})) AS then_n, (SELECT count(*) FROM lake.{name}) AS now_n")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey) AS BIGINT) AS place, o_orderkey FROM orders")
def sort_spec_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one sorted file stand in the order of the sort specification, ties by row id."""
    t = filled(catalog(spark, d), load(spark, d, "orders").orderBy("o_orderkey").coalesce(1), sort=[("o_orderstatus", "desc", "first"), ("o_totalprice", "asc", "last"), ("o_orderkey", "asc", "last")])
    return t.scan(lineage=True).select((F.col("file_row_number") + 1).alias("place"), "o_orderkey")


@query("SELECT CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST, k) AS BIGINT) AS place, k FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 5 = 2 THEN CAST(0.0 AS DOUBLE) WHEN o_orderkey % 5 = 3 THEN CAST(-0.0000001 AS DOUBLE) ELSE o_totalprice END AS x FROM orders)")
def sort_spec_odd_values(spark: SparkSession, d: str) -> DataFrame:
    """Nulls stand where the specification says, NaN above all numbers."""
    x = F.expr("CASE o_orderkey % 5 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN double('NaN') WHEN 2 THEN 0.0D WHEN 3 THEN -0.0000001D ELSE o_totalprice END")
    t = filled(catalog(spark, d), load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), x.alias("x")).coalesce(1), sort=[("x", "desc", "first"), ("k", "asc", "last")])
    return t.scan(lineage=True).select((F.col("file_row_number") + 1).alias("place"), "k")


# -- listings, pins, definitions and queues


@query("SELECT event_id FROM events WHERE event_id % 2 = 0")
def pinned_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog opened at a snapshot reads as of it and refuses to be changed."""
    t = events(spark, d)
    pinned = Catalog(spark, t.catalog.root, snapshot=_snapshots_of(t)[0])
    try:
        pinned.create_namespace("never")
        raise AssertionError("a pinned catalog was changed")
    except Invalid:
        return pinned.table("lake", t.info()["name"]).scan(columns=["event_id"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS records FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-0%' GROUP BY 1")
def partition_prefix(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).partitions(prefix={0: "2024-01-0"}).select(F.col("decoded")[0].alias("day"), "records")


@query("SELECT CAST(row_number() OVER (ORDER BY records DESC, day) AS BIGINT) AS place, day, records FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS records FROM events GROUP BY 1) ORDER BY place LIMIT 4")
def partition_listing_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).partitions(sort="records", limit=4).collect()
    return spark.createDataFrame([(i + 1, r.decoded[0], r.records) for i, r in enumerate(rows)], "place long, day string, records long")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)")
def seed_doubling(spark: SparkSession, d: str) -> DataFrame:
    src = load(spark, d, "orders").select("o_orderkey")
    t = filled(catalog(spark, d), src.repartition(4))
    double_until(t, 2 * t.count() - 3)
    double_until(t, t.count() + 3)
    return t.scan().agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("d"))


@query("SELECT 'renamed' AS title, 'of suppliers' AS remark, 'x' AS setting, count(*) AS n FROM supplier")
def alter_name_comment_properties(spark: SparkSession, d: str) -> DataFrame:
    t = filled(fresh(spark), load(spark, d, "supplier"))
    t.alter(al.rename_table("renamed"), al.set_table_comment("of suppliers"), al.set_properties({"mode": "x"}), al.set_column_comment("s_name", "its name"))
    now = t.catalog.table("lake", "renamed")
    return now.scan().agg(F.count("*").alias("n")).select(F.lit(now.info()["name"]).alias("title"), F.lit(now.info()["comment"]).alias("remark"), F.lit(now.info()["properties"]["mode"]).alias("setting"), "n")


@query("SELECT count(*) AS n, true AS sorted FROM orders")
def alter_sort_order(spark: SparkSession, d: str) -> DataFrame:
    """Files written after the change, and compacted ones, stand in the new order."""
    src = load(spark, d, "orders")
    t = filled(catalog(spark, d), src.where("o_orderkey % 2 = 0").repartition(3))
    t.alter(al.set_sort_order([("o_totalprice", "desc", "last")]))
    t.append(src.where("o_orderkey % 2 = 1").repartition(3))
    maintenance.compact(t)
    return maintenance.is_sorted(t).agg(F.min("sorted").alias("sorted")).select(F.lit(t.count()).cast("long").alias("n"), "sorted")


@query("SELECT c_nationkey, c_nationkey AS folder, count(*) AS n FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1")
def object_prefix_field(spark: SparkSession, d: str) -> DataFrame:
    """All files lie in their value's folder, compacted ones too; files whose statistics do not prove one value are refused."""
    src = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    t = new_table(catalog(spark, d), src, partition=[("c_nationkey", "identity")])
    t.alter(al.set_object_prefix_field("c_nationkey"))
    t.append(src.where("c_custkey % 2 = 0"))
    t.append(src.where("c_custkey % 2 = 1"))
    maintenance.compact(t)
    t.delete("c_custkey % 9 = 0")
    try:
        t.append(src.limit(5), deferred_stats=True)
        raise AssertionError("a file without statistics was accepted")
    except Invalid:
        pass
    of = F.regexp_extract("filename", r"/c_nationkey=(\d+)/[^/]+$", 1)
    return t.scan(lineage=True).select("c_nationkey", of.cast(src.schema["c_nationkey"].dataType).alias("folder")).groupBy("c_nationkey", "folder").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS kept, CAST(1 AS BIGINT) AS queued, CAST(1 AS BIGINT) AS committed FROM region")
def upload_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims protect files that are being written; what is given up is queued for removal."""
    lake = fresh(spark)
    t = filled(lake, load(spark, d, "region"))
    maintenance.claim_upload(lake, "a", f"{lake.root}/data/a.parquet")
    maintenance.claim_upload(lake, "b", f"{lake.root}/data/b.parquet")
    again = maintenance.renew_uploads(lake, ["a", "b", "never"])
    given_up = maintenance.abandon_uploads(lake, ["b"])
    assert again == 2 and given_up == 1
    state = lake.state()
    return spark.createDataFrame([(t.count(), len(state["removals"]), sum(u["state"] == "claimed" for u in state["uploads"].values()))], "kept long, queued long, committed long")


@query("SELECT count(*) AS n, true AS barrier, true AS floor FROM nation")
def changefeed_guards(spark: SparkSession, d: str) -> DataFrame:
    """Windows across a truncation or below the floor are refused instead of read with a gap."""
    lake = fresh(spark)
    t = filled(lake, load(spark, d, "region").select(F.col("r_regionkey").alias("k")))
    before = lake.head
    t.truncate()
    after = lake.head
    t.append(load(spark, d, "nation").select(F.col("n_nationkey").alias("k")))
    refused = {}
    try:
        t.changes(before - 1)
    except ReconciliationRequired:
        refused["barrier"] = True
    rows = t.changes(after).appended().agg(F.count("*").alias("n")).head()
    lake.set_options(retention_seconds=1)
    maintenance.expire(lake, now_micros=4_000_000_000_000_000)
    try:
        t.changes(0)
    except Expired:
        refused["floor"] = True
    return spark.createDataFrame([(rows.n, refused.get("barrier", False), refused.get("floor", False))], "n long, barrier boolean, floor boolean")


@query("SELECT CAST(1 AS BIGINT) AS tables, count(*) AS n, CAST(1 AS BIGINT) AS forgotten FROM region")
def drop_and_retire(spark: SparkSession, d: str) -> DataFrame:
    """A dropped table is read back until the floor passes it; then nothing of it is left."""
    lake = fresh(spark)
    t, other = filled(lake, load(spark, d, "nation")), filled(lake, load(spark, d, "region"))
    sql.sql(lake, f"DROP TABLE lake.{t.info()['name']}")
    lake.set_options(retention_seconds=1)
    maintenance.expire(lake, now_micros=4_000_000_000_000_000)
    forgotten = maintenance.retire(lake)
    return spark.createDataFrame([(len(lake.tables("lake")), other.count(), forgotten)], "tables long, n long, forgotten long")


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS parts FROM lineitem")
def catalog_export(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem(spark, d)
    files = [f for f in t.catalog.export()["files"].values() if f["table_id"] == t.id and f["end"] is None]
    return spark.createDataFrame([(sum(f["record_count"] for f in files), len({tuple(f["values"]) for f in files}))], "records long, parts long")


@query("SELECT 'zstd' AS codec, count(*) AS n FROM customer")
def compaction_codec(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow.parquet as pq

    t = filled(catalog(spark, d), load(spark, d, "customer").repartition(6))
    maintenance.compact(t)
    found = {pq.read_metadata(local(f["path"])).row_group(0).column(0).compression.lower() for f, _ in t.plan()}
    return spark.createDataFrame([(",".join(sorted(found)), t.count())], "codec string, n long")


@query("SELECT CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nans, CAST(sum(CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM orders")
def nan_counts(spark: SparkSession, d: str) -> DataFrame:
    x = F.expr("CASE o_orderkey % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN NULL ELSE o_totalprice END")
    t = filled(catalog(spark, d), load(spark, d, "orders").select("o_orderkey", x.alias("x")).repartition(3))
    maintenance.count_nans(t)
    return t.column_stats(columns=["x"]).agg(F.sum("nan_count").alias("nans"), F.sum("null_count").alias("nulls"))


@query("SELECT event_id, json(props) AS text FROM events")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).scan().select("event_id", canonical(F.col("props")).alias("text"))


@query("SELECT drop_reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'x' WHEN event_id % 4 = 1 THEN 'y' END AS drop_reason FROM events) WHERE drop_reason IS NOT NULL GROUP BY 1")
def json_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Records that do not fit are counted by reason and fail no batch."""
    fields, _ = ty.assign_ids([{"name": "k", "type": "int"}], 1)
    value = F.expr("CASE event_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"k\": \"no number\"}' ELSE props END")
    rows = ingest.classify(events(spark, d).scan().select("event_id", value.alias("value")), F.col("value"), fields)
    first, second = (r.drop_reason for r in rows.where("event_id % 4 < 2").groupBy((F.col("event_id") % 4).alias("m")).agg(F.min("drop_reason").alias("drop_reason")).orderBy("m").collect())
    named = F.when(F.col("drop_reason") == first, "x").when(F.col("drop_reason") == second, "y").otherwise(F.col("drop_reason"))
    return ingest.drop_counts(rows).select(named.alias("drop_reason"), F.col("count").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS part FROM events")
def staging_keys(spark: SparkSession, d: str) -> DataFrame:
    """Records that a log delivers twice are staged once, by their place in the log."""
    src = load(spark, d, "events").select("event_id", "ts", F.lit("events").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    return ingest.keyed(src.union(src.where("event_id % 2 = 0")), [F.to_date("ts")]).select("event_id", F.col("staging_key.group").alias("part"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def month_routing(spark: SparkSession, d: str) -> DataFrame:
    """Each month's events go to a table of their own, once though the batch comes twice."""
    lake, src = fresh(spark), load(spark, d, "events").select("event_id", "ts")
    tables: dict[str, Table] = {}

    def of(month: str) -> Table:
        if month not in tables:
            tables[month] = new_table(lake, src, name=f"events_{month.replace('-', '_')}")
        return tables[month]

    write = ingest.by_month(of, "routed")
    for _ in range(2):
        write(src, 0)
    out = [t.scan().select(F.lit(m).alias("month")) for m, t in tables.items()]
    return functools.reduce(DataFrame.union, out).groupBy("month").agg(F.count("*").alias("n"))


algebra.register(query, lineitem, orders, events)
