"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words.  Whole copies of a source come
first; what is left of its target is taken from the documents whose hash lies
under the source's threshold.  The threshold is found from histograms of words
by source and hash bucket: each round refines only the bucket in which the
budget runs out, so documents are never sorted, and a larger budget always takes
a superset of what a smaller one takes.

Everything is a table: the sources with their ranks, targets and thresholds, and
the histograms, of 2**BITS buckets a source in each round.  The driver gets a
few sums, whatever the number of sources.

Defined cases: a null text has size 0; very long texts are counted whole; null
sources form one source, last in order; rows of one source with the same doc_id
and text have the same hash and are taken together, and where such a hash alone
crosses the budget the nearer side is taken; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

#: Hash bits read by each round of refinement, and rounds until the hash is used up.
BITS = 10
ROUNDS = 6
#: A document is taken this often at most.
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - BITS * ROUNDS)


def _sources(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Per source: name, its words n, and its weight by its rank in order of code points, null last."""
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = F.col("name").asc_nulls_last()
    sums = sized.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("n"))
    ranged = scratch.save(sums.repartitionByRange(parts, in_order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row a range
    before = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    first = F.broadcast(spark.createDataFrame(before, "part int, first long"))
    rank = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(in_order)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    return scratch.save(ranged.join(first, "part").select("name", "n", weight.alias("weight")), "mix-sources")


def targets(sources: DataFrame, cap: float = MOST_COPIES) -> DataFrame:
    """Sources (n, weight, ...) with a target: all words shared by weight.

    No source gets over `cap` times its words; the excess is shared by weight
    among the others.  A source is full where `unit` times its weight is above
    its cap, so each round finds `unit` from two sums.
    """
    total = sources.agg(F.sum("n").cast("double")).head()[0] or 0.0
    most, unit, full = cap * F.col("n").cast("double"), 0.0, -1
    while True:
        is_full = F.lit(full >= 0) & (F.lit(unit) * F.col("weight") > most)
        r = sources.agg(F.sum(is_full.cast("long")).alias("full"), F.sum(F.when(is_full, most)).alias("given"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).head()
        if r.full is None or r.full == full or not r.open:
            return sources.withColumn("target", F.when(is_full, most).otherwise(F.lit(unit) * F.col("weight")))
        unit, full = (total - (r.given or 0.0)) / r.open, r.full


def _refined(plan: DataFrame, sized: DataFrame, low: int) -> DataFrame:
    """Thresholds after a look at the hash bits down to `low` of the documents in each open source's bucket."""
    limits = plan.where("open").select("name", "prefix", "left")
    inside = sized.join(limits, sized.source.eqNullSafe(limits.name) & (F.shiftrightunsigned("h", low + BITS) == limits.prefix))
    bucket = F.shiftrightunsigned("h", low).alias("bucket")
    counts = inside.groupBy("name", "left", bucket).agg(F.sum("size").alias("words"), (F.min("h") == F.max("h")).alias("one"))
    upto = counts.withColumn("upto", F.sum("words").over(Window.partitionBy("name").orderBy("bucket")))  # 2**BITS rows a source
    crossing = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "words", "one"))).alias("at")
    found = upto.groupBy(F.col("name").alias("of")).agg(crossing, F.max("bucket").alias("last"))
    rest = F.col("left") - (F.col("at.upto") - F.col("at.words"))
    # Where one hash crosses the budget there is nothing finer to choose: the nearer side.
    nearer = F.col("at.one") & (F.col("at.words") - rest < rest)
    below = F.when(F.col("at").isNull(), F.col("last") + 1).otherwise(F.col("at.bucket") + nearer.cast("long"))
    seen = F.col("last").isNotNull()
    return plan.join(found, plan.name.eqNullSafe(found.of) & plan.open, "left").select(
        "name",
        "source_size",
        "target",
        "copies",
        F.when(seen & F.col("at").isNotNull(), rest).otherwise(F.col("left")).alias("left"),
        F.when(seen, F.coalesce("at.bucket", "prefix")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(seen, F.shiftleft(below, low)).otherwise(F.col("below")).alias("below"),
        (F.col("open") & F.coalesce(~F.col("at.one"), F.lit(False))).alias("open"),
    )


def _plan(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Per source: its words, target, whole copies, and the hash below which a document gets one copy more."""
    sources = _sources(sized, weights)
    copies = F.when(F.col("n") > 0, F.least(F.lit(MOST_COPIES), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int")
    left = F.when(F.col("copies") < MOST_COPIES, F.col("target") - F.col("copies") * F.col("n")).otherwise(0.0)
    plan = targets(sources).withColumn("copies", copies).withColumn("left", left)
    zero = F.lit(0).cast("long")
    plan = scratch.save(plan.select("name", F.col("n").alias("source_size"), "target", "copies", "left", zero.alias("prefix"), zero.alias("below"), (F.col("left") > 0).alias("open")), "mix-plan")
    for low in range(BITS * (ROUNDS - 1), -1, -BITS):
        if plan.where("open").isEmpty():
            break
        before, plan = plan, scratch.save(_refined(plan, sized, low), "mix-plan")
        scratch.drop(before)
    return plan.select("name", "source_size", "target", "copies", "below")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Spark broadcasts the plan where it is small; else the join splits a hot source's partition."""
    copies = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(plan, rows.source.eqNullSafe(plan.name)).withColumn("copies", copies)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size and target (of its source), taken (words, repeats counted).

    `weights` go to the sources by code point, null last, and repeat.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = _with_copies(sized, _plan(sized, weights))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.  Texts are not shuffled."""
    plan = _plan(_sized(docs, id_col, text_col, source_col), weights)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), _hash(id_col, text_col).alias("h"))
    copied = _with_copies(rows, plan).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
