"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Documents are tokenised and cut into pieces of `capacity` tokens.  The planner
sees only how many pieces there are of each length: best-fit decreasing runs
over those counts and yields slots, runs of equal places for one length.  Each
piece then takes the slot of its rank among the pieces of its length.

The rank needs no window over a whole length: pieces are dealt into hash
buckets, so many that none holds more than about 256 pieces or a hundred
thousandth of all, and a bucket's first rank is a prefix sum of counts.

Defined cases: null and empty texts are documents of the closing token alone;
very long texts are cut into pieces of the whole capacity; repeated rows are
packed each on their own; pieces of equal length, id, number and content may
take each other's slots, all others have one order; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, textkit

CAPACITY = 2048
#: Pieces ranked together, and the number of rank buckets beyond the lengths themselves.
BUCKET_ROWS, BUCKETS = 256, 100_000

_TAIL = re.compile(r"[!-&(-/:-@\[-`{-~]+$")


class WordEncoder:
    """Ids of a tokenizers JSON file whose tokens never span white space; each distinct word is encoded once.

    White space only separates tokens in such a vocabulary, so a text's ids are
    those of its space- and line-separated words in turn.  Behind the letters of
    a word, ASCII punctuation other than the apostrophe always starts new
    tokens, so word and tail are encoded apart.  Words that may hold a special
    token's text are encoded as they stand, and vocabularies that are not of
    this kind encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._splits_words(spec)
        self.last = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.forget()

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        """Whether white space is dropped, case is lowered and runs of other characters than letters and digits are split off."""
        parts = lambda x, inner: [] if x is None else x.get(inner, [x])
        lowered = any(n["type"] == "Lowercase" for n in parts(spec.get("normalizer"), "normalizers"))
        patterns = [p["pattern"].get("Regex", "") for p in parts(spec.get("pre_tokenizer"), "pretokenizers") if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
        runs = any(p.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for p in patterns)
        return lowered and runs and all("<|" in t["content"] and " " not in t["content"] for t in spec["added_tokens"])

    def forget(self) -> None:
        """Start anew, as a task does: what is kept of words is bounded by `textkit.KEPT_BYTES` and lives no longer."""
        self.index = textkit.KeyIndex()
        self.begin, self.length = textkit.Growing(np.int64), textkit.Growing(np.int64)
        self.ids = textkit.Growing(np.uint32)
        self.parts: dict[str, bytes] = {}
        self.parts_bytes = 0

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's first id's index (n+1 values)."""
        if not self.by_word:
            ids = [np.array(self.model.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))
        buf, offsets = textkit.text_buffers(column)
        starts, ends, firsts = textkit.word_spans(buf, offsets, _BY_SPACE)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, where, inverse = np.unique(textkit.span_hashes(buf, starts, ends, textkit.EXACT), return_index=True, return_inverse=True)
        at = self._learn(buf, starts, ends, distinct, where)[inverse]
        lengths = self.length.rows[at]
        sums = np.append(0, np.cumsum(lengths))
        ids = self.ids.rows[np.repeat(self.begin.rows[at] - sums[:-1], lengths) + np.arange(sums[-1])]
        return ids, sums[firsts]

    def _learn(self, buf, starts, ends, distinct, where) -> np.ndarray:
        """Places of the distinct words, after encoding those not met before."""
        places = self.index.find(distinct)
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if 32 * self.index.n + 4 * self.ids.n > textkit.KEPT_BYTES:
            self.forget()
            new = np.arange(len(distinct))
        raw = buf.tobytes()
        spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)
        got = self._encode([raw[i:j].decode() for i, j in spans])
        lengths = np.array([len(x) // 4 for x in got], np.int64)
        self.begin.append(self.ids.n + np.cumsum(lengths) - lengths)
        self.length.append(lengths)
        self.ids.append(np.frombuffer(b"".join(got), "<u4"))
        places[new] = self.index.add(distinct[new])
        return places

    def _encode(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word."""
        if self.parts_bytes > textkit.KEPT_BYTES // 2:
            self.parts, self.parts_bytes = {}, 0
        split, wanted, parts = [], {}, self.parts
        for w in words:
            core = w if w.isalnum() or "<|" in w else _TAIL.sub("", w)
            # Lower case may end a letter with a mark, which the punctuation behind it joins.
            if len(core) < len(w) and not (core[-1:].isalpha() and core[-1:].lower()[-1:].isalpha()):
                core = w
            tail = w[len(core) :]
            if core.isascii() and "<|" not in core:
                core = core.lower()
            split.append((core, tail))
            if core not in parts:
                wanted[core] = None
            if tail and tail not in parts:
                wanted[tail] = None
        plain = [p for p in wanted if p.isalpha() and is_normalized("NFC", p)]
        other = [p for p in wanted if not (p.isalpha() and is_normalized("NFC", p))]
        for i in range(0, len(plain), 256):  # one token ends a plain word, so many can be encoded as one text
            some = plain[i : i + 256]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some):
                other += some
                continue
            flat = ids.tobytes()
            parts.update(zip(some, map(flat.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for p, e in zip(other, self.model.encode_batch_fast(other, add_special_tokens=False), strict=True):
            parts[p] = np.array(e.ids, "<u4").tobytes()
        out = [parts[core] + parts[tail] if tail else parts[core] for core, tail in split]
        for p in wanted:
            if len(p) > textkit.LONG:
                del parts[p]
            else:
                self.parts_bytes += 150 + len(p) + len(parts[p])  # about what two small objects and their place take
        return out


_BY_SPACE = np.ones(256, bool)
_BY_SPACE[[10, 32]] = False

@functools.lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The vocabulary is read once by a worker; words' ids are forgotten when a task ends."""
    return WordEncoder(path)


def _cutter(path: str, capacity: int, closing: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        encode.forget()
        for whole in batches:
            for a, b in textkit.slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                flat, firsts = encode(batch.column(1))
                rows, piece, start, length, crc, out = [], [], [], [], [], []
                for i in range(len(batch)):
                    ids = np.append(flat[firsts[i] : firsts[i + 1]], np.uint32(closing)).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        rows.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            out.append(part.astype(np.int64))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(out, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        encode.forget()

    return textkit.task(cut)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, ranks, first sequence, pieces of this
    slot in each sequence, offset of the first): rank r of a length lies in
    sequence first + (r - first rank) // pieces, at offset + (r - first rank)
    % pieces * length.  The work depends on the number of lengths, not pieces.
    """
    slots, sequences = [], 0
    rooms: list[int] = []  # spaces left in open sequences, ascending
    groups: dict[int, list[list[int]]] = {}  # space left -> runs [first sequence, number]

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([first, n])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                room, first, n = capacity, sequences, -(-left // each)
                sequences += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if rest:
                slots.append((length, rank, rest, first + full, rest, capacity - room))
                keep(room - rest * length, first + full, 1)
                rank, left, used = rank + rest, left - rest, full + 1
            if used < n:
                keep(room, first + used, n - used)
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Only counts reach the driver: one per length, then one per length and rank
    bucket, BUCKETS plus the number of lengths at most.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = scratch.save(scratch.spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(_cutter(tokenizer, capacity, closing, with_ids), schema), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(BUCKET_ROWS, -(-sum(histogram.values()) // BUCKETS))
    dealt = F.broadcast(spark.createDataFrame([(k, max(1, -(-n // target))) for k, n in histogram.items()], "l long, buckets long"))
    bucketed = pieces.join(dealt, pieces.length == dealt.l).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("l", "buckets")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["length"], []).append((r["bucket"], r["n"]))
    bases = []
    for length, found in counts.items():
        base = 0
        for bucket, n in sorted(found):
            bases.append((length, bucket, base))
            base += n
    ranked = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    first = F.broadcast(spark.createDataFrame(bases, "l long, b long, base long"))
    ranked = ranked.join(first, (ranked.length == first.l) & (ranked.bucket == first.b)).withColumn("rank", F.col("rank") + F.col("base")).drop("l", "b", "base", "bucket")
    slots = F.broadcast(spark.createDataFrame(plan(histogram, capacity), "l long, first_rank long, ranks long, sequence long, each long, place long"))
    placed = ranked.join(slots, (ranked.length == slots.l) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    behind = F.col("rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(behind / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + behind % F.col("each") * F.col("length")).alias("offset"),
    )
