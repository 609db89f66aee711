"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks chunk boundaries; normalised chunking
uses a strict mask before the normal size and a loose one after it, between a
least and a largest size.  Boundaries follow the content, so an insertion only
changes the chunks around it.  A fingerprint is the set of chunk digests with
chunk lengths; the likeness of A to B is the part of A's chunk bytes whose
digests are in B's set (containment).

``compare_next`` needs each document's neighbour in id order without a global
sort in one task: ids are cut into ranges, texts are dealt to ranges once, and
the first document of a range is also sent, as a closing row, to the range
that is read before it.

Defined cases: a null text is empty; an empty text has the fingerprint ''; its
likeness is 1 to an equal fingerprint and 0 to others; very long texts are
chunked whole; ids that are no integers are refused where neighbours are
compared; null ids come last, equal ids, repeated rows too, are ordered by text;
the only document is its own neighbour; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import textkit

#: Chunk sizes in bytes: least, normal, largest (fits in one byte).
LEAST, NORMAL, LARGEST = 16, 64, 240
#: Boundary masks: one in 256 places before the normal size, one in 16 after it.
STRICT, LOOSE = np.uint32(0xFF000000), np.uint32(0xF0000000)
_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> list[int]:
    """End of each chunk of a text's bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[data]
    for width in (1, 2, 4, 8, 16):  # each step doubles the window
        older = gear[:-width] << np.uint32(width)
        gear[width:] += older
    loose = np.flatnonzero((gear & LOOSE) == 0)
    strict = loose[(gear[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    strict.append(n)
    loose.append(n)
    while n - at > LEAST:
        cut = strict[bisect_left(strict, at + LEAST)]
        if cut >= at + NORMAL:
            cut = loose[bisect_left(loose, at + NORMAL - 1)]
        at = min(cut + 1, at + LARGEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


@dataclass
class Chunks:
    """Distinct chunks of a text, ascending by their 64-bit digests, and their lengths."""

    digests: np.ndarray
    lengths: np.ndarray


def chunk_set(text: str) -> Chunks:
    raw = text.encode()
    data = memoryview(raw)
    start, found = 0, {}
    for end in chunk_ends(np.frombuffer(raw, np.uint8)):
        found[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    digests = np.fromiter(found, np.uint64, len(found))
    order = np.argsort(digests)
    return Chunks(digests[order], np.fromiter(found.values(), np.uint8, len(found))[order])


def fingerprint(chunks: Chunks) -> str:
    """Eighteen hex digits a chunk: its digest, its length."""
    out = np.empty((len(chunks.digests), 9), np.uint8)
    out[:, :8] = chunks.digests.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = chunks.lengths
    return out.tobytes().hex()


def parse(stored: str) -> Chunks:
    raw = np.frombuffer(bytes.fromhex(stored), np.uint8).reshape(-1, 9)
    return Chunks(np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64), raw[:, 8].copy())


def likeness(a: Chunks, b: Chunks) -> float:
    """Part of a's chunk bytes that b has too."""
    if not len(a.digests):
        return 1.0 if not len(b.digests) else 0.0
    _, common, _ = np.intersect1d(a.digests, b.digests, assume_unique=True, return_indices=True)
    return float(a.lengths[common].sum(dtype=np.int64) / a.lengths.sum(dtype=np.int64))


def likeness_of(a: str, b: str) -> float:
    """The likeness of two stored fingerprints."""
    return likeness(parse(a), parse(b))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(chunk_set(t or "")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(textkit.task(_fingerprints), f"doc_id {kind}, fingerprint string")


_LOWEST = -(1 << 63)


def _dealer(cuts: np.ndarray, closing: dict[int, int]):
    """Adds a row's range; a range's first document also closes the range read before it."""
    tops = np.array(sorted(closing), np.int64)
    owners = np.array([closing[k] for k in tops.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(_LOWEST).to_numpy(zero_copy_only=False)
            parts = np.searchsorted(cuts, keys, "right").astype(np.int32)
            at = np.minimum(np.searchsorted(tops, keys), len(tops) - 1)
            twice = np.flatnonzero(tops[at] == keys)
            rows = np.concatenate([np.arange(len(keys)), twice])
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([parts, owners[at[twice]]])), pa.array(np.arange(len(rows)) >= len(keys)), out.column(0), out.column(1)],
                ["part", "closes", "doc_id", "text"],
            )

    return deal


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of range, then documents, then closing rows; each meets the next one."""
    before = None  # range, id, text, chunks
    for batch in batches:
        out = []
        for part, closes, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if closes and (before is None or before[0] != part):
                continue  # the range is done: a further copy of its closing row
            chunks = chunk_set(text)
            if before is not None:
                _, own_id, own, own_chunks = before
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_chunks = chunk_set(edited)
                out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own_chunks), fingerprint(edited_chunks), likeness(own_chunks, edited_chunks), likeness(own_chunks, chunks)))
            before = None if closes else (part, doc_id, text, chunks)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, its fingerprint and that of its edited text, and how near it is to that and to the next document.

    The next document is the one before it in id order (after the lowest id, the
    highest).  The edited text has the last floor(n/2) code points replaced by
    the next document's first as many.  Ids are integers.  The driver gets a few
    numbers for each range of ids, of which there are four times the number of
    shuffle partitions.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers, by which documents are put in order")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).head()[0]
    cuts = np.array(sorted(set(found or [])), np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).fill_null(_LOWEST).to_numpy(zero_copy_only=False)
            where = np.searchsorted(cuts, keys, "right")
            high = np.full(len(cuts) + 1, _LOWEST, np.int64)
            np.maximum.at(high, where, keys)
            for p in np.unique(where).tolist():
                best[p] = max(best.get(p, _LOWEST), int(high[p]))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["part", "top"])

    highest = {r.part: r.top for r in rows.select("doc_id").mapInArrow(textkit.task(tops), "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect()}
    if not highest:
        return spark.createDataFrame([], _OUT_DDL)
    order = sorted(highest)
    closing = {highest[p]: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    dealt = rows.mapInArrow(textkit.task(_dealer(cuts, closing)), "part int, closes boolean, doc_id long, text string")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "closes", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(textkit.task(_compare), _OUT_DDL)
