"""Relational algebra over tables: joins, aggregates, windows, set operations and event-time windows are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming import windows
from .workspace import catalog, filled, load, new_table, table


def _small(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name, lambda lake: filled(lake, load(spark, d, name))).scan()


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, joined by cells of `width` instead of as a nested loop.

    An interval has a row for each cell that it touches, so `width` should be
    about an interval's length; skewed cells are split by Spark as in any join.
    """
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = intervals.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(cells))
    met = points.withColumn("__cell", F.floor(F.col(point) / width)).join(spread, "__cell")
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def register(query, lineitem, orders, events) -> None:
    """Add the queries to a registry."""

    def exact_sum(c: Column) -> Column:
        return F.sum(c.cast("decimal(18,2)")).cast("double")

    exact = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"

    @query(f"SELECT n_name, count(*) AS n, {exact('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
    def join_inner_chain(spark: SparkSession, d: str) -> DataFrame:
        o, c, n = orders(spark, d).scan(), _small(spark, d, "customer"), _small(spark, d, "nation")
        return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), exact_sum(F.col("o_totalprice")).alias("total"))

    @query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
    def join_left_outer(spark: SparkSession, d: str) -> DataFrame:
        c, o = _small(spark, d, "customer"), orders(spark, d).scan(where="o_orderstatus = 'F'")
        return c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))

    @query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
    def join_left_semi(spark: SparkSession, d: str) -> DataFrame:
        c, o = _small(spark, d, "customer"), orders(spark, d).scan(where="o_totalprice > 400000")
        return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")

    @query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    def join_left_anti(spark: SparkSession, d: str) -> DataFrame:
        c, o = _small(spark, d, "customer"), orders(spark, d).scan()
        return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")

    @query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey FROM customer) FULL JOIN (SELECT s_suppkey FROM supplier) ON c_custkey = s_suppkey + 50")
    def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
        c, s = _small(spark, d, "customer"), _small(spark, d, "supplier")
        return c.join(s, c.c_custkey == s.s_suppkey + 50, "full").select("c_custkey", "s_suppkey")

    @query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > n_nationkey * 300 GROUP BY 1")
    def join_theta(spark: SparkSession, d: str) -> DataFrame:
        c, n = _small(spark, d, "customer"), _small(spark, d, "nation")
        return c.join(n, (c.c_nationkey == n.n_nationkey) & (c.c_acctbal > n.n_nationkey * 300)).groupBy("n_name").agg(F.count("*").alias("n"))

    @query("SELECT e.event_id, p.event_id AS prior_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
    def join_as_of(spark: SparkSession, d: str) -> DataFrame:
        """The user's last view at or before each click, by one window instead of a range join."""
        rows = events(spark, d).scan(where="event_type IN ('click', 'view')", columns=["event_id", "user_id", "ts", "event_type"])
        view = F.when(F.col("event_type") == "view", F.col("event_id"))
        w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("prior_id", F.last(view, ignorenulls=True).over(w)).where("event_type = 'click'").select("event_id", "prior_id")

    @query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {exact('l_quantity')} AS qty, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_ship FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2")
    def agg_group_by(spark: SparkSession, d: str) -> DataFrame:
        rows = lineitem(spark, d).scan(where="l_shipdate <= '2001-09-02T00:00:00'")
        return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact_sum(F.col("l_quantity")).alias("qty"), F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first_ship"))

    @query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
    def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
        return lineitem(spark, d).scan().rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))

    @query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
    def agg_cube(spark: SparkSession, d: str) -> DataFrame:
        return orders(spark, d).scan().cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))

    @query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
    def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
        return orders(spark, d).scan().select("o_orderstatus", "o_orderpriority").distinct()

    @query("SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, true AS close FROM lineitem")
    def agg_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
        """The exact number, and whether the sketch is within 5 % of it."""
        found = lineitem(spark, d).scan().agg(F.count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.01).alias("near"))
        return found.select("parts", (F.abs(F.col("near") - F.col("parts")) <= 0.05 * F.col("parts")).alias("close"))

    @query("SELECT l_returnflag, l_linestatus, l_shipmode, count(*) AS n FROM (SELECT *, l_linenumber % 3 AS l_shipmode FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_shipmode), ())")
    def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
        rows = lineitem(spark, d).scan().withColumn("l_shipmode", F.col("l_linenumber") % 3)
        f, s, m = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_shipmode")
        return rows.groupingSets([[f], [s, m], []], f, s, m).agg(F.count("*").alias("n"))

    @query("SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY first_key) AS BIGINT) AS place FROM (SELECT o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY 1)")
    def agg_first_occurrence_order(spark: SparkSession, d: str) -> DataFrame:
        """Groups in the order in which their first rows come."""
        groups = orders(spark, d).scan().groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
        return groups.select("o_orderpriority", F.row_number().over(Window.orderBy("first_key")).cast("long").alias("place"))  # one row a group

    for hint in ("broadcast", "merge", "shuffle_hash"):

        def hinted(spark: SparkSession, d: str, hint: str = hint) -> DataFrame:
            o, c = orders(spark, d).scan(), _small(spark, d, "customer")
            return o.join(c.hint(hint), o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))

        hinted.__name__ = f"join_hint_{hint}"
        query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(hinted)

    @query("SELECT o_orderkey, k AS band FROM orders JOIN (SELECT n_nationkey AS k, n_nationkey * 20000.0 AS low, n_nationkey * 20000.0 + 30000.0 AS high FROM nation) ON o_totalprice >= low AND o_totalprice < high")
    def join_range(spark: SparkSession, d: str) -> DataFrame:
        """Points in overlapping intervals, met by the cells that both fall in."""
        n = _small(spark, d, "nation").select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 20000.0).alias("low"), (F.col("n_nationkey") * 20000.0 + 30000.0).alias("high"))
        return range_join(orders(spark, d).scan(), n, "o_totalprice", "low", "high", 10000.0).select("o_orderkey", "band")

    @query("SELECT c_custkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS second, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS richest, count(*) OVER (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal) AS BIGINT) RANGE BETWEEN 1000 PRECEDING AND 500 FOLLOWING) AS peers FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
    def window_distribution(spark: SparkSession, d: str) -> DataFrame:
        w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        near = Window.partitionBy("c_nationkey").orderBy(F.floor("c_acctbal")).rangeBetween(-1000, 500)
        return _small(spark, d, "customer").select("c_custkey", F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"), F.nth_value("c_custkey", 2).over(w).alias("second"), F.last("c_custkey").over(whole).alias("richest"), F.count("*").over(near).alias("peers"))

    @query("SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
    def window_ranking(spark: SparkSession, d: str) -> DataFrame:
        w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
        full = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
        return _small(spark, d, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.row_number().over(full).alias("rn"), F.ntile(4).over(full).cast("long").alias("quarter"))

    @query("SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id) OVER w AS after_id, first_value(event_id) OVER w AS first_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
    def window_analytic(spark: SparkSession, d: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return events(spark, d).scan().select("event_id", F.lag("event_id").over(w).alias("before_id"), F.lead("event_id").over(w).alias("after_id"), F.first("event_id").over(w).alias("first_id"), F.count("*").over(w.rowsBetween(-2, 0)).alias("recent"))

    @query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    def topk(spark: SparkSession, d: str) -> DataFrame:
        return orders(spark, d).scan().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")

    @query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
    def limit_offset(spark: SparkSession, d: str) -> DataFrame:
        return orders(spark, d).scan().orderBy("o_orderkey").offset(10).limit(20).select("o_orderkey")

    keys = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"

    def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        return _small(spark, d, "customer").select(F.col("c_custkey").alias("k")), orders(spark, d).scan(where="o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))

    @query(f"{keys[0]} UNION ALL {keys[1]}")
    def set_union_all(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return a.unionByName(b)

    @query(f"{keys[0]} UNION {keys[1]}")
    def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return a.union(b).distinct()

    @query(f"{keys[0]} INTERSECT {keys[1]}")
    def set_intersect(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return a.intersect(b)

    @query(f"{keys[0]} EXCEPT {keys[1]}")
    def set_except(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return a.subtract(b)

    @query(f"{keys[1]} EXCEPT ALL {keys[0]}")
    def set_except_all(spark: SparkSession, d: str) -> DataFrame:
        a, b = two(spark, d)
        return b.exceptAll(a)

    @query(f"({keys[1]}) INTERSECT ALL ({keys[1]} AND o_custkey % 2 = 0)")
    def set_intersect_all(spark: SparkSession, d: str) -> DataFrame:
        _, b = two(spark, d)
        return b.intersectAll(b.where("k % 2 = 0"))

    @query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity BETWEEN 10 AND 12 OR l_discount IS NULL) AND l_linestatus <> 'F' AND l_returnflag IN ('A', 'R') AND l_tax IS NOT NULL")
    def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
        return lineitem(spark, d).scan(where="(l_quantity BETWEEN 10 AND 12 OR l_discount IS NULL) AND l_linestatus <> 'F' AND l_returnflag IN ('A', 'R') AND l_tax IS NOT NULL", columns=["l_orderkey", "l_linenumber"])

    @query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
    def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
        out = windows.tumbling(events(spark, d).scan().withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
        return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")

    @query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, nth")
    def window_session(spark: SparkSession, d: str) -> DataFrame:
        out = windows.sessions(events(spark, d).scan().withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"], [F.count("*").alias("n")])
        return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")

    @query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
    def stream_window_tumbling(spark: SparkSession, d: str) -> DataFrame:
        """The same aggregation as a stream with a watermark, over all files at once."""
        src = load(spark, d, "events")
        stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
        out = windows.tumbling(stream, "ts", "1 day", ["event_type"], [F.count("*").alias("n")]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
        t = new_table(catalog(spark, d), out)

        def replace(batch: DataFrame, number: int) -> None:
            t.overwrite(batch, all_files=True)  # complete mode: each batch is the whole answer

        q = out.writeStream.outputMode("complete").foreachBatch(replace).trigger(availableNow=True).option("checkpointLocation", f"{t.catalog.root}/windows-{t.id}").start()
        q.awaitTermination()
        return t.scan()
