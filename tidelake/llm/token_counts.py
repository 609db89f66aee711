"""Token counts through a digest cache.

Counts live in a Parquet table keyed by the content's digest and the
tokenizer's version digest.  Documents are joined to it by digest; only
distinct texts without an entry are encoded, once each, and appended.

Texts are content-normalised to UTF-8 with null as the empty text; nothing else
may be normalised, since any other change could alter the count.  Texts that the
cache lacks are moved once, to the task that owns their digest, and copies
inside one input task are dropped before that.

Defined cases: null text counts as empty (0 tokens); very long texts are encoded
whole; repeated rows each get a result row (counts have no ties to break); an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit

SCHEMA = "digest binary, version string, n_tokens long"

def _units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units that a piece tokenizer encodes independently: a space or line end with the run of other bytes behind it.

    Also each text's first unit and whether the text is plain: no run of
    spaces, leading space or visible-space character, where units would interact.
    """
    n = len(offsets) - 1
    space = buf == 32
    heads = space | (buf == 10)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    odd = np.zeros(len(buf), bool)
    odd[1:] = space[1:] & space[:-1]
    odd[1:] |= space[1:] & (buf[:-1] == 10)
    odd |= buf == 0xE2  # the visible space U+2581 starts with this byte
    odd[firsts] |= heads[firsts]
    heads[firsts] = True
    starts = np.flatnonzero(heads)
    ends = np.append(starts[1:], len(buf))
    bad = np.searchsorted(np.flatnonzero(odd), offsets)
    plain = bad[1:] == bad[:-1]
    return starts, ends, np.searchsorted(starts, offsets), plain if n else np.zeros(0, bool)


class PieceCounter:
    """Counts of a sentencepiece model, exactly those of encoding whole texts.

    No piece of the vocabularies served has a space mark behind another
    character, so merges never cross the start of a word and a text's count is
    the sum over its words; a worker then encodes each distinct word once.  The
    constructor checks this, and texts or models where it fails are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i)]
        probe = self.model.encode(["a", "a\na", "a a", " a", "a  a "], out_type=str)
        self.by_word = (
            not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
            and probe == [["▁a"], ["▁a", "<0x0A>", "a"], ["▁a", "▁a"], probe[3], probe[4]]
            and "".join(probe[3]) == "▁▁a"
            and "".join(probe[4]) == "▁a▁▁a▁"
        )
        self.forget()

    def forget(self) -> None:
        """Start anew, as a task does: what is kept of words is bounded by `textkit.KEPT_BYTES` and lives no longer."""
        self.index, self.counts = textkit.KeyIndex(), textkit.Growing(np.int64)

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for a, b in textkit.slices(column):
            part = column.slice(a, b - a)
            buf, offsets = textkit.text_buffers(part)
            if not len(buf):
                continue
            starts, ends, firsts, plain = _units(buf, offsets)
            whole = np.flatnonzero(~plain) if self.by_word else np.flatnonzero(np.diff(offsets))
            if self.by_word:
                sums = np.append(0, np.cumsum(self._unit_counts(buf, offsets, starts, ends)))
                out[a:b] = sums[firsts[1:]] - sums[firsts[:-1]]
            if len(whole):
                out[a + whole] = [len(x) for x in self.model.encode([part[int(i)].as_py() for i in whole], num_threads=1)]
        return out

    def _unit_counts(self, buf, offsets, starts, ends) -> np.ndarray:
        hashes = textkit.span_hashes(buf, starts, ends, textkit.EXACT)
        # A text's first word is encoded as one behind a space: the model puts a space mark before it.
        leading = np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])
        hashes[leading] = textkit.mix(hashes[leading] ^ np.uint64(0x5BD1E995))
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = self.index.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            if 24 * self.index.n > textkit.KEPT_BYTES:
                self.forget()
                new = np.arange(len(distinct))
            first = set(leading.tolist())
            raw, texts, less = buf.tobytes(), [], []
            for i in where[new].tolist():
                unit = raw[starts[i] : ends[i]]
                if i in first:
                    texts.append(unit)
                    less.append(0)
                elif unit[:1] == b" ":  # the model's own space mark stands for the space
                    texts.append(unit[1:])
                    less.append(0 if len(unit) > 1 else -1)
                else:  # behind a line end: the space mark before it is not in the text
                    texts.append(unit)
                    less.append(1)
            self.counts.append(np.array([len(x) for x in self.model.encode([t.decode() for t in texts], num_threads=1)], np.int64) - np.array(less, np.int64))
            at[new] = self.index.add(distinct[new])
        return self.counts.rows[at][inverse]


class JsonCounter:
    """Counts of a tokenizers JSON file; texts are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, column: pa.Array) -> np.ndarray:
        return np.array([len(self.model.encode(t or "", add_special_tokens=False)) for t in column.to_pylist()], np.int64)

    def forget(self) -> None:
        """Nothing is kept."""


@functools.lru_cache(1)
def counter(path: str) -> PieceCounter | JsonCounter:
    """The vocabulary is read once by a worker; counts of words are forgotten when a task ends."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def version_of(path: str) -> str:
    """Digest of a tokenizer's file and of the rule by which its tokens are counted."""
    return hashlib.sha256(b"plain ids, no added tokens;" + Path(path).read_bytes()).hexdigest()


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a digest not seen before in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by digest, copies next to each other."""
        last, count = None, counter(path)
        count.forget()
        for batch in batches:
            keep = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d != last:
                    keep.append(i)
                    last = d
            if keep:
                batch = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(keep)), pa.array(count(batch.column(1)))], ["digest", "version", "n_tokens"])
        count.forget()

    return textkit.task(encode)


class TokenCountCache:
    """A table of counts at `path`, a folder that all executors and later runs share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def fill(self, docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
        """Append counts for the texts that have none under this tokenizer; return its part of the table."""
        version = version_of(tokenizer)
        own = self.read().where(F.col("version") == version)
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(digest(text).alias("digest"), text.alias("text"))
        if not own.isEmpty():  # digests meet the cache; only texts that it lacks move, and none do where few enough are missing
            missing = scratch.save(texts.select("digest").distinct().join(own.select("digest"), "digest", "left_anti"), "token-counts-missing")
            texts = texts.join(missing, "digest", "left_semi")
        missing = texts.mapInArrow(textkit.task(_distinct_texts), "digest binary, text string")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = missing.repartition(parts, "digest").sortWithinPartitions("digest")
        rows.mapInArrow(_encoder(tokenizer, version), SCHEMA).write.mode("append").parquet(self.path)
        return self.read().where(F.col("version") == version).select("digest", "n_tokens")


def digest(text):
    return F.unhex(F.sha2(text, 256))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    `tokenizer` is a vocabulary file that every executor has at the same place;
    `cache` a folder for the counts, by default a new one that starts empty.
    """
    spark = docs.sparkSession
    counts = TokenCountCache(spark, cache or scratch.new_path(spark, "token-counts")).fill(docs, tokenizer, text_col)
    # Two runs that append at the same time may both store a digest; their counts agree.
    # Saved, so that the join below can split the partition of a digest with many copies.
    counts = scratch.save(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts-read")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest(text).alias("digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
