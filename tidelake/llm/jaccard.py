"""N-gram Jaccard join by chosen paths.

Documents with equal shingle sets are one node.  A node's set is embedded as a
tuple of minwise tokens.  Each run splits all nodes by one sampled token of
their own: sets share it with a chance of their Jaccard similarity.  A bucket
that stays larger than `LIMIT` is split again, on `BRANCHES` further tokens, so
dissimilar sets part while similar ones go on together in some branch; this
goes on until a bucket is small, or dense: a split that leaves `DENSE` of a
bucket together shows that its sets share most tokens, so that no token parts
them.  These leaf buckets are compared by brute force, block against block in
separate tasks: no bucket is capped and none is gathered in one task.  Runs are
repeated until a pair at the threshold is found with at least `RECALL`.

A bucket is compared twice.  First on the embedded tuples, which shows the nodes
that may have a partner there; then the shingle sets of these nodes alone are
brought together and compared exactly.  A pair is counted in one bucket only,
the first of those that both nodes are in.  Tasks return link counts and
spanning forests, never pairs.

With similarity 0.8 a run without splits finds a pair with a chance of 0.8.  A
split with two branches keeps a pair that its deeper levels keep with a chance
of p with 1 - (1 - 0.8 p)^2, which never falls below 0.93, so a run of any depth
finds it with at least 0.75: six runs with 0.9999 to 0.9997.  The tuples pass
it with 1 - 1e-5.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower
case; a shingle is five words in a row, or all words of a shorter text.

Defined cases: a null text is empty, and a text without words links with
nothing; very long texts are shingled whole, blocks hold fewer of them; equal
texts are linked copies, whatever their ids; repeated rows are linked copies;
the class is named by the least id, and of rows with that id by the least hash
of a text; null ids get results too and name a class only if all its ids are
null; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch, textkit

SHINGLE, THRESHOLD = 5, 0.8
#: Minwise tokens of a set.
TUPLE = 64
RECALL = 0.9999
LIMIT, BRANCHES = 1024, 2
#: A split that leaves this part of a bucket together shows it as dense.
DENSE = 0.5
#: Nodes, and their shingles, of a block, which a task compares with another block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18

_ODD = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 63, TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, in order and with repeats, and each text's first one's index."""
    words, firsts = textkit.words(column, textkit.LETTER_WORD)
    n = len(words)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed[: n - k if n > k else 0] += words[k:] * _PLACE[k]
    counts = np.diff(firsts)
    full = np.maximum(counts - size + 1, 0)
    whole = (counts > 0) & (counts < size)
    each = full + whole
    starts = np.append(0, np.cumsum(each))
    at = np.repeat(firsts[:-1] - starts[:-1], each) + np.arange(starts[-1])
    out = mixed[at]
    for i in np.flatnonzero(whole).tolist():  # the words of the next text must not count
        out[starts[i]] = (words[firsts[i] : firsts[i + 1]] * _PLACE[: counts[i]]).sum(dtype=np.uint64) + np.uint64(counts[i])
    return textkit.mix(out), starts


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, h, text -> doc_id, h, node, size, tuple; node is null for an empty set."""
    for whole in batches:
        for a, b in textkit.slices(whole.column(2)):
            part = whole.slice(a, b - a)
            found, starts = shingles(part.column(2))
            sizes = np.zeros(len(part), np.int32)
            node = np.zeros(len(part), np.uint64)
            for i in range(len(part)):
                if starts[i + 1] > starts[i]:
                    distinct = np.unique(found[starts[i] : starts[i + 1]])
                    sizes[i] = len(distinct)
                    node[i] = textkit.mix(distinct * _ODD[0] ^ (distinct >> np.uint64(29))).sum(dtype=np.uint64)
            node = textkit.mix(node + sizes.astype(np.uint64))
            filled = np.flatnonzero(sizes)
            low = np.zeros((len(part), TUPLE), np.int32)
            if len(filled):
                for k in range(TUPLE):
                    low[filled, k] = (np.minimum.reduceat(found * _ODD[k], starts[filled]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * TUPLE, pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node.view(np.int64), mask=sizes == 0), pa.array(sizes), lists], ["doc_id", "h", "node", "size", "tuple"])


class _Leaves:
    """The leaf buckets of each of many nodes."""

    def __init__(self, lists: pa.Array):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.n = lists.value_lengths().to_numpy()
        self.buckets = np.zeros((len(lists), int(self.n.max(initial=1))), np.int64)
        self.buckets[np.arange(self.buckets.shape[1]) < self.n[:, None]] = lists.flatten().to_numpy()

    def first_met(self, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether pairs of nodes share no bucket of a lower number than the one given for each."""
        out = np.ones(len(i), bool)
        for p in range(self.buckets.shape[1]):
            own = self.buckets[i, p]
            lower = (p < self.n[i]) & (own < bucket)
            for q in range(self.buckets.shape[1]) if lower.any() else ():
                out &= ~(lower & (q < self.n[j]) & (own == self.buckets[j, q]))
        return out


#: Groups up to this size have their pairs listed together; larger ones are compared one by one.
_SMALL = 8


def _close_pairs(tuples: np.ndarray, starts: np.ndarray, least: float, crossing: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose tuples are equal in enough places; in crossing groups, of different blocks."""
    sizes = np.diff(starts)
    found_i, found_j = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= _SMALL)]).tolist():
        at = starts[:-1][sizes == size]
        for p in range(size):
            for q in range(p + 1, size):
                i, j = at + p, at + q
                for k in range(0, len(i), 50_000):
                    near = (tuples[i[k : k + 50_000]] == tuples[j[k : k + 50_000]]).sum(1) >= least
                    found_i.append(i[k : k + 50_000][near])
                    found_j.append(j[k : k + 50_000][near])
    for g in np.flatnonzero(sizes > _SMALL).tolist():
        rows = np.arange(starts[g], starts[g + 1])
        left = rows[block[rows] == block[rows[0]]] if crossing[rows[0]] else rows
        right = rows[block[rows] != block[rows[0]]] if crossing[rows[0]] else rows
        equal = np.zeros((len(left), len(right)), np.uint8)
        for k in range(TUPLE):
            equal += tuples[left, k][:, None] == tuples[right, k][None, :]
        i, j = np.nonzero(equal >= least)
        i, j = left[i], right[j]
        found_i.append(i if crossing[rows[0]] else i[i < j])
        found_j.append(j if crossing[rows[0]] else j[i < j])
    none = np.zeros(0, np.int64)
    i, j = np.concatenate([none, *found_i]), np.concatenate([none, *found_j])
    apart = ~crossing[i] | (block[i] != block[j])
    return i[apart], j[apart]


def _candidates(threshold: float):
    #: Equal places of two tuples that a pair at the threshold has but for about one time in 100,000.
    least = threshold * TUPLE - 4.6 * math.sqrt(threshold * (1 - threshold) * TUPLE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows: bucket, x, y | block, node, size, tuple, leaves -> the first five, of rows with a candidate counted here."""
        for table, starts in textkit.runs(batches, 3):
            bucket, x, y, block, size = (table.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            tuples = table.column(6).combine_chunks().flatten().to_numpy().reshape(len(table), TUPLE)
            i, j = _close_pairs(tuples, starts, least, x != y, block)
            keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[keep], j[keep]
            if len(i):
                first = _Leaves(table.column(7)).first_met(i, j, bucket[i])
                some = np.union1d(i[first], j[first])
                yield from table.select([0, 1, 2, 3, 4]).take(pa.array(some)).to_batches()

    return compare


def intersections(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets, given as (row, token) pairs without repeats."""
    distinct, number, df = np.unique(tokens, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    rows, number = rows[order], number[order]
    begin = np.append(0, np.cumsum(df))
    few = (df >= 2) & (df <= 8)
    for k in np.unique(df[few]).tolist():  # rare tokens: their pairs of rows
        at = begin[:-1][df == k]
        own = rows[at[:, None] + np.arange(k)[None, :]]
        for p in range(k):
            for q in range(p + 1, k):
                np.add.at(out, (own[:, p], own[:, q]), 1)
                np.add.at(out, (own[:, q], own[:, p]), 1)
    common = np.flatnonzero(df > 8)
    for a in range(0, len(common), 2048):  # the others: products of 0/1 matrices
        some = common[a : a + 2048]
        place = np.full(len(distinct), -1)
        place[some] = np.arange(len(some))
        here = place[number] >= 0
        dense = np.zeros((n, len(some)), np.float32)
        dense[rows[here], place[number[here]]] = 1
        out += dense @ dense.T
    return out


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of node, text -> node, its distinct shingles."""
    for whole in batches:
        for a, b in textkit.slices(whole.column(1)):
            found, starts = shingles(whole.column(1).slice(a, b - a))
            sets = [np.unique(found[i:j]).view(np.int64) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows: bucket, x, y | block, node, copies, leaves, shingles -> a, b, links."""
        for table, starts in textkit.runs(batches, 3, 500):
            bucket, x, y, block, node, copies = (table.column(i).to_numpy() for i in range(6))
            leaves = _Leaves(table.column(6))
            lists = table.column(7).combine_chunks()
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            found_i, found_j = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                tokens, own = flat[ends[a] - size[a] : ends[b - 1]], size[a:b]
                common = intersections(np.repeat(np.arange(b - a), own), tokens, b - a)
                linked = np.triu(common >= threshold * (own[:, None] + own[None, :] - common) - 1e-6, 1)
                if x[a] != y[a]:
                    linked &= block[a:b, None] != block[None, a:b]
                i, j = np.nonzero(linked)
                found_i.append(a + i)
                found_j.append(a + j)
            none = np.zeros(0, np.int64)
            i, j = np.concatenate([none, *found_i]), np.concatenate([none, *found_j])
            first = leaves.first_met(i, j, bucket[i])
            i, j = i[first], j[first]
            if len(i):
                links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                root = textkit.forest(len(node), i, j)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(np.rint(links[some]).astype(np.int64))], ["a", "b", "links"])

    return verify


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in units (x, y) of their bucket: one for each pair of its blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node")


def _buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(node, bucket, blocks): the leaf buckets of all runs that have partners in them, and the blocks each is cut into."""
    first = nodes.select("node", "size", F.posexplode(F.slice("tuple", 1, runs)).alias("run", "token"))
    rows = scratch.save(first.select("node", "size", "run", F.xxhash64("run", "token").alias("bucket")), "join-rows")
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).alias("blocks")
    done, used = None, [rows]
    for depth in itertools.count():
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("size").alias("weight"), F.min("run").alias("run"))
        sizes = scratch.save(sizes.where("count > 1"), "join-buckets")
        used.append(sizes)
        # Each split halves a bucket at least, so the tokens last for any number of nodes.
        ended = (depth + 1) * BRANCHES > TUPLE - runs or sizes.where(F.col("count") > LIMIT).isEmpty()
        ready = rows.join(sizes.where(F.lit(ended) | (F.col("count") <= LIMIT)).select("bucket", blocks), "bucket").select("node", "bucket", "blocks")
        done = ready if done is None else done.union(ready)
        if ended:
            leaves = scratch.save(done, "join-leaves")
            scratch.drop(*used)
            return leaves
        large = rows.drop("run").join(sizes.where(F.col("count") > LIMIT).select("bucket", "run", "count", blocks), "bucket")
        branch = F.explode(F.array(*map(F.lit, range(BRANCHES)))).alias("branch")
        split = large.join(nodes.select("node", "tuple"), "node").select("node", "size", "run", "tuple", F.col("bucket").alias("parent"), "count", "blocks", branch)
        place = (runs + F.pmod(F.col("run") * 9 + depth * BRANCHES + F.col("branch"), F.lit(TUPLE - runs))).cast("int")
        split = scratch.save(split.select("node", "size", "run", "parent", "count", "blocks", F.xxhash64("parent", "branch", F.get("tuple", place)).alias("bucket")), "join-split")
        parts = split.groupBy("parent", "count", "bucket").agg(F.count("*").alias("n")).groupBy("parent", "count").agg(F.max("n").alias("most"))
        dense = scratch.save(parts.where(F.col("most") >= DENSE * F.col("count")).select("parent"), "join-dense")
        used += [split, dense]
        compared = split.join(dense, "parent", "left_semi").select("node", F.col("parent").alias("bucket"), "blocks").distinct()
        done = done.union(compared)
        rows = split.join(dense, "parent", "left_anti").select("node", "size", "run", "bucket")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h (its text's hash), n_links, first (doc_id and h of its class's first document)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = min(TUPLE // 2, math.ceil(math.log(1 - recall) / math.log(1 - threshold) - 1e-9))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sets = scratch.save(scratch.spread(rows).mapInArrow(textkit.task(_embed), f"doc_id {kind}, h long, node long, size int, tuple array<int>"), "join-sets")
    nodes = sets.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h")).alias("any_first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("id_first"), F.first("size").alias("size"), F.first("tuple").alias("tuple"))
    nodes = scratch.save(nodes.withColumn("first", F.coalesce("id_first", "any_first")).drop("id_first", "any_first"), "join-nodes")

    met = _buckets(nodes, runs)
    leaves = met.groupBy("node").agg(F.collect_list("bucket").alias("leaves"))  # a few for each run
    known = scratch.save(nodes.select("node", "size", "copies", "tuple", F.col("first.doc_id").alias("id"), F.col("first.h").alias("text_hash")).join(leaves, "node"), "join-known")
    unit = ["bucket", "x", "y"]
    units = _dealt(met).join(known.select("node", "size", "tuple", "leaves"), "node").select(*unit, "block", "node", "size", "tuple", "leaves")
    hits = units.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(textkit.task(_candidates(threshold)), "bucket long, x long, y long, block long, node long")
    hits = scratch.save(hits, "join-hits")

    wanted = known.join(hits.select("node").distinct(), "node").select("node", "id", "text_hash")
    texts = wanted.join(rows, wanted.id.eqNullSafe(rows.doc_id) & (wanted.text_hash == rows.h)).select("node", "text").dropDuplicates(["node"])
    sets_of = scratch.save(texts.mapInArrow(textkit.task(_shingle_sets), "node long, shingles array<long>"), "join-shingles")
    full = hits.join(known.select("node", "copies", "leaves"), "node").join(sets_of, "node").select(*unit, "block", "node", "copies", "leaves", "shingles")
    links = full.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(textkit.task(_verifier(threshold)), "a long, b long, links long")
    links = scratch.save(links, "join-links")
    scratch.drop(met, known, hits, sets_of)

    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components.connected_components(links.select("a", "b"))
    named = nodes.select("node", "first", "copies").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.save(named.join(counts, "node", "left").select("node", "component", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-named")
    scratch.drop(nodes, links)
    with_id = F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first")))
    names = scratch.save(named.groupBy("component").agg(F.coalesce(with_id, F.min("first")).alias("first")), "join-names")
    facts = scratch.save(named.drop("first").join(names, "component").select("node", "n_links", "first"), "join-facts")
    scratch.drop(named, names)
    own = F.struct("doc_id", "h")
    out = sets.select("doc_id", "h", "node").join(facts, "node", "left")
    return out.select("doc_id", "h", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", own).alias("first"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id that links reach), n_links (other documents linked directly), kept."""
    found = classes(docs, threshold, recall, id_col, text_col)
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, but one of each class; texts without words all stay."""
    found = scratch.save(classes(docs, threshold, id_col=id_col, text_col=text_col), "join-classes")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    dropped = found.where(~kept).select("doc_id", "h").distinct()
    # Rows that are there several times are all the first of their class: one stays.
    again = scratch.save(found.where(kept & (F.col("n_links") > 0)).groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "join-repeats")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h"))
    out = rows.join(dropped, same, "left_anti")
    if not again.isEmpty():
        once = out.join(again, same, "left_semi").dropDuplicates(["id", "hash"])
        out = out.join(again, same, "left_anti").union(once)
    return out.select("row.*")
