"""Language-model scores by a weighted backoff automaton.

The model is of order three.  Its automaton has a state for every training word
and every training bigram (and one for a text's start), an arc for every longer
training n-gram, and failure arcs from a bigram to its last word and from a word
to the root, whose arcs are the words:

    arc uv -> w      log10 (c(uvw) + m3 p(w|v)) / (c(uv) + m3),   to vw
    failure of uv    log10 m3 / (c(uv) + m3),                     to v
    arc u -> w       log10 (c(uw) + m2 q(w)) / (c(u) + m2),       to uw
    failure of u     log10 m2 / (c(u) + m2),                      to the root
    arc of the root  log10 q(w),                                  to w

with p(w|v) what the automaton gives w from state v.  The root discounts words:
q(w) = (c(w) - d) / N, and a word without a training count, of which all are one
class as in the base score, has d V / N; d = (n1 + 1) / (n1 + 2 n2 + 2), where
n1 and n2 words occur once and twice.  Probabilities sum to one in every state.  A text is
walked once from left to right; the walk carries the state, takes failure arcs
until a state has an arc for the token, and adds up log probabilities.

No automaton is built whole: its size grows with the corpus.  Texts are cut
into blocks; a block asks for exactly the states and arcs that its own texts can
visit.  Its distinct words, bigrams and trigrams, with its training counts of
them, go to shards by key range; a shard sums the counts of all blocks and
answers each block in its own order; block and answers meet, the block's part of
the automaton is built and its texts are walked.  Frequent words cost one key
per block, and the number of shards follows the number of tokens.

Words are known by 64-bit hashes, longer n-grams by so many bits that a key that
no training text has is taken for another with a chance of about 1e-6.

Defined cases: a null text is empty and has only the end token; with no
training texts every probability is 1; very long texts are walked in parts, each
entered two tokens early, and make a block of their own; repeated rows are
counted and scored each, equally; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit

#: m2 and m3.  Held-out likelihood is flat around them: a factor of eight costs 0.1 a token at most.
MASSES = (8192.0, 64.0)
#: Bytes of text in a block (more if one text is longer).
BLOCK_BYTES = 6 << 20
#: Keys that blocks send to a shard at most, on average, and keys summed at a time.
SHARD_KEYS, WINDOW = 2_000_000, 1 << 18
#: Bits of longer n-grams' keys beyond those that count the tokens, and at least.
MORE_BITS, LEAST_BITS = 20, 40
#: Tokens of a text that are walked side by side with other texts' before its next ones.
PART = 1024

_END, _START = np.uint64(0x0E0E0E0E0E0E0E0E), np.uint64(0x0B0B0B0B0B0B0B0B)
_ORDERS = ("words", "bigrams", "trigrams")


def _by_frequency(often: np.ndarray) -> np.ndarray:
    """Words' numbers, the most frequent first."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text, trains -> blocks: ids, flags, tokens per text, distinct words, how often each stands there, tokens as ranks of words, their count."""
    for whole in batches:
        for a, b in textkit.slices(whole.column(1), BLOCK_BYTES):
            part = whole.slice(a, b - a)
            hashes, firsts = textkit.words(part.column(1), textkit.SPACE_WORD)
            sizes = np.diff(firsts)
            words, numbers, often = np.unique(np.insert(hashes, firsts[1:], _END), return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            rank[_by_frequency(often)] = np.arange(len(words))  # small numbers for frequent words compress well
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
            flags = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(2))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(os.urandom(8), "little") >> 1]), ids, flags, pa.array([textkit.squeeze(sizes + 1)]), pa.array([textkit.squeeze_keys(words)]), pa.array([textkit.squeeze(often)]), pa.array([textkit.squeeze(rank[numbers])]), pa.array([len(numbers)], pa.int64())],
                ["block", "ids", "trains", "sizes", "words", "often", "tokens", "n"],
            )


class Block:
    """A block's n-grams of each order as ascending keys, and its tokens as indices into them.

    `index[k]` has at each token the n-gram of order k + 1 that ends there; at a
    text's first token, where no trigram ends, it has a number past the last.
    """

    def __init__(self, trains: list[bool], sizes: bytes, words: bytes, often: bytes, tokens: bytes, bits: int):
        self.sizes = textkit.expand(sizes).astype(np.int64)
        numbers = _by_frequency(textkit.expand(often))[textkit.expand(tokens).astype(np.int64)]
        known = np.append(textkit.expand_keys(words), _START)
        order = np.argsort(known).astype(np.int32)  # the start's key stands somewhere among the others
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.start = int(place[-1])
        words_, at = known[order], place[numbers]
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(at)
        self.before[1:] = at[:-1]
        self.before[first] = self.start
        pairs = textkit.pair(words_[self.before], words_[at])
        bigrams, second = _numbered(pairs)
        inner = np.delete(np.arange(len(at)), first)
        trigrams, found = _numbered(textkit.pair(pairs[inner - 1], words_[at[inner]]))
        del pairs
        third = np.full(len(at), len(trigrams), np.int32)
        third[inner] = found
        shift = np.uint64(64 - bits)
        self.keys = [words_, bigrams >> shift, trigrams >> shift]
        self.bits = [64, bits, bits]
        self.index = [at, second, third]
        self.trains = np.repeat(np.array(trains, bool), self.sizes)
        self.texts = int(np.sum(trains))

    def counts(self) -> list[np.ndarray]:
        """Training counts of this block; the start's is the number of texts."""
        out = [np.bincount(i[self.trains], minlength=len(k))[: len(k)] for i, k in zip(self.index, self.keys, strict=True)]
        out[0][self.start] = self.texts
        return out

    def shares(self, shards: int) -> Iterator[tuple]:
        """For each shard, its keys and this block's counts of them, order by order."""
        cuts = [_cuts(k, shards, b) for k, b in zip(self.keys, self.bits, strict=True)]
        counts = self.counts()
        for s in range(shards):
            parts = [slice(c[s], c[s + 1]) for c in cuts]
            if any(p.stop > p.start for p in parts):
                row = [s]
                for k, n, p in zip(self.keys, counts, parts, strict=True):
                    row += [textkit.squeeze_keys(k[p]), textkit.squeeze(n[p])]
                yield tuple(row)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and each key's number among them."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    numbers = np.empty(len(keys), np.int32)
    numbers[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], numbers


def _cuts(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    bounds = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


_ASKED = [f"{o}{c}" for o in _ORDERS for c in ("", "_counts")]


def _asker(shards: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of block, trains, sizes, words, often, tokens -> rows of shard, block, keys and counts."""
        for batch in batches:
            for block, trains, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(zip(*Block(trains, *data, bits).shares(shards), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([block] * len(rows[0])), *(pa.array(r, pa.binary()) for r in rows[1:])], ["shard", "block", *_ASKED])

    return ask


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all rows and their totals, summed a window of rows at a time."""
    distinct, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting_k, waiting_n, size = [], [], 0
    for i, (k, n) in enumerate(zip(keys, counts, strict=True)):
        waiting_k.append(textkit.expand_keys(k))
        waiting_n.append(textkit.expand(n).astype(np.int64))
        size += len(waiting_k[-1])
        if size >= max(WINDOW, len(distinct)) or i == len(keys) - 1:
            every, number = np.unique(np.concatenate([distinct, *waiting_k]), return_inverse=True)
            summed = np.zeros(len(every), np.int64)
            np.add.at(summed, number, np.concatenate([totals, *waiting_n]))
            distinct, totals = every, summed
            waiting_k, waiting_n, size = [], [], 0
    return distinct, totals


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> rows of block, shard, counts that other blocks have, by order.

    These are nearly all zero for what only one block has.  A shard's first row
    tells how many words it has, and how often.
    """
    for group in textkit.groups(batches, 1):
        shard, blocks, *data = (group.column(i).to_pylist() for i in range(8))
        answers = []
        facts = [[0] * len(shard) for _ in range(4)]
        for k in range(3):
            keys, counts = data[2 * k], data[2 * k + 1]
            distinct, totals = _totals(keys, counts)
            answers.append(pa.array([textkit.squeeze(totals[np.searchsorted(distinct, textkit.expand_keys(x))] - textkit.expand(n).astype(np.int64)) for x, n in zip(keys, counts, strict=True)], pa.binary()))
            if k == 0:
                of_words = totals[distinct != _START]
                for f, n in zip(facts, (of_words.sum(), (of_words > 0).sum(), (of_words == 1).sum(), (of_words == 2).sum()), strict=True):
                    f[0] = int(n)
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(shard, pa.int32()), *answers, *(pa.array(f, pa.int64()) for f in facts)], ["block", "shard", *_ORDERS, "n", "v", "once", "twice"])


class Automaton:
    """The part of the model's automaton that a block's texts can visit.

    States: 0 the root, then the words, then the bigrams; `fail` and `bow` are
    each state's failure arc and its weight.  Arcs are known by their n-grams:
    `source`, `weight` and `target` of each, by order, where -1 as the source
    means that the arc is not there.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, once: int, twice: int, masses: tuple[float, float]):
        c1, c2, c3 = (np.append(c, 0).astype(np.float64) for c in counts)
        words, bigrams = len(counts[0]), len(counts[1])
        second, third = block.index[1], block.index[2]
        discount = (once + 1) / (once + 2 * twice + 2)
        q = np.where(c1 > 0, (c1 - discount) / max(n, 1), discount * v / max(n, 1)) if n else np.ones(words + 1)
        # A place of each bigram and trigram tells the n-grams it is made of.
        at2 = np.zeros(bigrams + 1, np.int32)
        at2[second] = np.arange(len(second), dtype=np.int32)
        at3 = np.zeros(len(counts[2]) + 1, np.int32)
        at3[third] = np.arange(len(third), dtype=np.int32)
        u, w, context, last = block.before[at2], block.index[0][at2], second[at3 - 1], second[at3]
        m2, m3 = masses
        p2 = (c2 + m2 * q[w]) / (c1[u] + m2)
        p3 = (c3 + m3 * p2[last]) / (c2[context] + m3)
        none = np.full(1, -1)
        self.fail = np.concatenate([none, np.zeros(words, np.int32), 1 + w[:-1]]).astype(np.int32)
        self.bow = np.log10(np.concatenate([[1.0], m2 / (c1[:-1] + m2), m3 / (c2[:-1] + m3)]))
        self.bigram_states = 1 + words
        state1, state2 = np.where(c1 > 0, 1 + np.arange(words + 1), 0), np.where(c2 > 0, self.bigram_states + np.arange(bigrams + 1), 0)
        self.start = int(state1[block.start])
        self.source = [None, np.where(c2 > 0, 1 + u, -1).astype(np.int32), np.where(c3 > 0, self.bigram_states + context, -1).astype(np.int32)]
        self.weight = [np.log10(q), np.log10(p2), np.log10(p3)]
        #: Where an arc leads: the longest n-gram that ends with its token and is a state.
        self.target = [x.astype(np.int32) for x in (state1, np.where(c2 > 0, state2, state1[w]), state2[last])]

    def walk(self, block: Block) -> np.ndarray:
        """Each text's log probability; texts go side by side, long ones in parts that are entered two tokens early."""
        sizes = block.sizes
        begin = np.cumsum(sizes) - sizes
        parts = -(-sizes // PART)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        early = np.where(number > 0, 2, 0)
        at = begin[text] + number * PART - early
        length = np.minimum(PART, sizes[text] - number * PART) + early
        order = np.argsort(-length, kind="stable")
        text, at, length, early = text[order], at[order], length[order], early[order]
        state = np.where(early > 0, 0, self.start)
        total = np.zeros(len(text))
        running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for step, n in enumerate(running.tolist()):
            here = at[:n] + step
            now, cost, to = state[:n].copy(), np.zeros(n), np.zeros(n, np.int64)
            waits = np.ones(n, bool)
            for k in (2, 1):
                arc = block.index[k][here]
                taken = waits & (self.source[k][arc] == now)
                cost += np.where(taken, self.weight[k][arc], 0.0)
                to = np.where(taken, self.target[k][arc], to)
                waits &= ~taken
                fails = waits & (now >= (self.bigram_states if k == 2 else 1))
                cost += np.where(fails, self.bow[now], 0.0)
                now = np.where(fails, self.fail[now], now)
            word = block.index[0][here]
            cost += np.where(waits, self.weight[0][word], 0.0)
            state[:n] = np.where(waits, self.target[0][word], to)
            total[:n] += np.where(step >= early[:n], cost, 0.0)
        return np.bincount(text, total, len(sizes))


def _traverser(n: int, v: int, once: int, twice: int, bits: int, masses: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and shard; the block itself comes first, as shard -1."""
        for group in textkit.groups(batches, 1):
            ids = group.column(2)[0].values
            trains, *data = (group.column(i)[0].as_py() for i in range(3, 8))
            block = Block(trains, *data, bits)
            answers = {s: a for s, *a in zip(*(group.column(i).to_pylist()[1:] for i in (1, 8, 9, 10)), strict=True)}
            in_order = [answers[s] for s in sorted(answers)]
            del group, data
            counts = [own + np.concatenate([np.zeros(0, np.uint64), *(textkit.expand(a[k]) for a in in_order)]).astype(np.int64) for k, own in enumerate(block.counts())]
            score = Automaton(block, counts, n, v, once, twice, masses).walk(block)
            c = counts[0][block.index[0]]
            ends = np.append(0, np.cumsum(block.sizes))
            known = np.diff(np.append(0, np.cumsum(c > 0))[ends])
            base = np.diff(np.append(0.0, np.cumsum(np.log10((c + 1) / (n + v + 1))))[ends])
            yield pa.RecordBatch.from_arrays([ids, pa.array(trains), pa.array(block.sizes), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "trains", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", masses: tuple[float, float] = MASSES) -> DataFrame:
    """Per document: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    `trains` says which rows the model learns from.  The driver gets five numbers.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    blocks = scratch.save(scratch.spread(rows).mapInArrow(textkit.task(_blocks), f"block long, ids array<{kind}>, trains array<boolean>, sizes binary, words binary, often binary, tokens binary, n long"), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    shards = max(partitions, math.ceil(3 * tokens / SHARD_KEYS))
    bits = min(64, max(LEAST_BITS, math.ceil(math.log2(tokens + 1)) + MORE_BITS))
    binary = ", ".join(f"{c} binary" for c in _ASKED)
    asked = blocks.select("block", "trains", "sizes", "words", "often", "tokens").mapInArrow(textkit.task(_asker(shards, bits)), f"shard int, block long, {binary}")
    answers = asked.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(textkit.task(_answer), "block long, shard int, words binary, bigrams binary, trigrams binary, n long, v long, once long, twice long")
    answers = scratch.save(answers, "lm-answers")
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "twice"))).head()
    none = F.lit(None).cast("binary")
    left = blocks.select("block", F.lit(-1).alias("shard"), "ids", "trains", "sizes", F.col("words").alias("w"), "often", "tokens", *(none.alias(o) for o in _ORDERS))
    met = left.unionByName(answers.select("block", "shard", *_ORDERS), allowMissingColumns=True)
    out = f"doc_id {kind}, trains boolean, n_tokens long, n_known long, base_score double, score double"
    walk = textkit.task(_traverser(total.n, total.v, total.once, total.twice, bits, masses))
    scored = met.repartition(max(partitions, math.ceil(tokens / SHARD_KEYS)), "block").sortWithinPartitions("block", "shard").mapInArrow(walk, out)
    return scored.select("doc_id", "trains", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")
