"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors of a label are one node.  Nodes are hashed in several tables: a
pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform), then the nearest corner of the cross-polytope; further probes are
the next nearest corners.  Two nodes meet in a table if one's own bucket is
among the other's probes, and every pair that meets is verified by its cosine
in double precision.  A pair is counted only where it meets first, so links are
counted once.

Buckets over `BLOCK` rows are verified block against block in separate tasks,
all pairs of blocks, so no bucket is capped.  A task returns counts and a
spanning forest of its links, never the pairs.

Two vectors at cosine 0.98 in 64 dimensions meet in one of these tables with a
chance of about 0.986, and in one of four with 1 - 4e-8.  Where labels are so
large that a bucket would get more than about `BUCKET` rows, corners of several
rotations make one bucket and tables are added.

Defined cases: a null, empty or zero vector, or one with a null or non-finite
component or a null label, links with nothing; vectors of different length do
not link; repeated rows are linked copies; null ids are results of their own
row and never name a component unless all its ids are null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch, textkit

THRESHOLD = 0.98
TABLES, PROBES = 4, 3
BUCKET, BLOCK = 256, 512


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """Bucket numbers of unit vectors: the own bucket first, then probes that change one function's corner."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    corners = []
    for f in range(functions):
        signs = np.random.Generator(np.random.PCG64([table, f])).choice([-1.0, 1.0], (3, size))
        turned = padded
        for s in signs:
            turned = _hadamard(turned * s)
        order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : min(probes, size)]
        corners.append(2 * order + (np.take_along_axis(turned, order, 1) < 0))
    base = 2 * size
    own = sum(c[:, 0].astype(np.int64) * base**f for f, c in enumerate(corners))
    others = [own + (c[:, q] - c[:, 0]) * base**f for f, c in enumerate(corners) for q in range(1, c.shape[1])]
    return np.stack([own, *others], axis=1)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coder(tables: int, functions: int, probes: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = unit_rows(part.column(1), dim)
                found = np.concatenate([codes(x, t, functions, probes) for t in range(tables)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    return code


def _meet_here(code_a, code_b, table: int, bucket: int, tables: int) -> np.ndarray:
    """Whether the pairs' first meeting is in this bucket; a is the smaller node of each pair."""
    a, b = (c.reshape(len(c), tables, -1) for c in (code_a, code_b))
    a_in_b = (a[:, : table + 1, :1] == b[:, : table + 1]).any(2)
    b_in_a = (b[:, : table + 1, :1] == a[:, : table + 1]).any(2)
    earlier = (a_in_b[:, :table] | b_in_a[:, :table]).any(1)
    where = np.where(a_in_b[:, table], a[:, table, 0], b[:, table, 0])
    return ~earlier & (a_in_b[:, table] | b_in_a[:, table]) & (where == bucket)


def _verifier(tables: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows: label, dim, table, bucket, x, y | block, node, copies, vector, codes."""
        for group in textkit.groups(batches, 6):
            dim, table, bucket, x, y = (group.column(i)[0].as_py() for i in range(1, 6))
            if len(group) < 2:
                continue
            block, node, copies = (group.column(i).to_numpy() for i in (6, 7, 8))
            unit = unit_rows(group.column(9), dim)
            code = group.column(10).combine_chunks().flatten().to_numpy().reshape(len(group), -1)
            own = code.reshape(len(group), tables, -1)[:, table, 0] == bucket
            found_a, found_b = [], []
            owners = np.flatnonzero(own)
            for k in range(0, len(owners), 256):
                rows = owners[k : k + 256]
                i, j = np.nonzero(unit[rows] @ unit.T >= threshold)
                i = rows[i]
                keep = (node[i] != node[j]) & ~(own[j] & (node[i] > node[j]))
                if x != y:
                    keep &= block[i] != block[j]
                if not keep.any():
                    continue
                i, j = i[keep], j[keep]
                low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                here = _meet_here(code[low], code[high], table, bucket, tables)
                found_a.append(low[here])
                found_b.append(high[here])
            a, b = np.concatenate([np.zeros(0, int), *found_a]), np.concatenate([np.zeros(0, int), *found_b])
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            root = textkit.forest(len(node), a, b)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    return verify


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, functions: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A node is named by the 64-bit hash of label and vector.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(valid, F.xxhash64("label", "v")))
    nodes = rows.where("node is not null").groupBy("label", "v", "node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = scratch.save(nodes, "vec-nodes")
    if functions is None:
        largest = nodes.groupBy("label").count().agg(F.max("count")).head()[0] or 1
        dim = nodes.agg(F.max(F.size("v"))).head()[0] or 1
        base = 2 << max(1, (dim - 1).bit_length())
        functions = max(1, math.ceil(math.log(largest / BUCKET, base))) if largest > BUCKET else 1
        tables = tables * (1 if functions == 1 else 2 * functions)
    per_table = 1 + functions * (probes - 1)
    kind = nodes.schema["v"].dataType.simpleString()
    coded = nodes.select("node", "v", F.size("v").alias("dim"), "label", "copies").mapInArrow(textkit.task(_coder(tables, functions, probes)), f"node long, v {kind}, dim int, label {nodes.schema['label'].dataType.simpleString()}, copies long, codes array<long>")
    coded = scratch.save(coded, "vec-codes")
    spread = coded.select("node", "label", "dim", F.posexplode("codes").alias("pos", "bucket")).select("node", "label", "dim", F.floor(F.col("pos") / per_table).cast("int").alias("table"), "bucket")
    sizes = scratch.save(spread.groupBy("label", "dim", "table", "bucket").count().where("count > 1"), "vec-buckets")
    met = spread.join(sizes, ["label", "dim", "table", "bucket"])
    blocks = F.ceil(F.col("count") / BLOCK)
    met = met.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("node", "label", "dim", "table", "bucket", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    unit = ["label", "dim", "table", "bucket", "x", "y"]
    full = met.join(coded.select("node", "copies", "v", "codes"), "node").select(*unit, "block", "node", "copies", "v", "codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = scratch.save(full.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(textkit.task(_verifier(tables, threshold)), "a long, b long, links long"), "vec-links")
    scratch.drop(coded, sizes)
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = components.connected_components(links.select("a", "b"))
    named = nodes.select("node", "first", "copies").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = scratch.save(named.join(counts, "node", "left").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vec-facts")
    facts = scratch.save(facts.join(scratch.save(names, "vec-names"), "component").select("node", "n_links", "component_id"), "vec-results")
    out = rows.select("vec_id", "node").join(facts, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"))
