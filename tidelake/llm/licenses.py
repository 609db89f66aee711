"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the licence templates.  Streaming a
text's words through it yields matching statistics: at each word, the longest
template substring that ends there.  Phrases are the places where that
substring ends with a whole phrase.  Maximal long matches are anchored in the
templates and chained, in order in both text and template, into covered spans.
Spans do not overlap: where several chains claim a place, the one that covers
most of its template stays, then the one of more words, then the earlier, then
the template first in the list.  A template labels the text when a span covers
enough of it.

Only runs of words that occur in some template reach the automaton; elsewhere
the matching statistic is 0 by definition.

Defined cases: a null text is empty, has no words and no labels; very long texts
are scanned whole; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit
from .license_texts import PHRASES, TEMPLATES

#: Words that a match needs to become an anchor, and words between two anchors of a chain at most.
ANCHOR, GAP = 3, 12
#: Part of a template that a chain must cover for its label.
COVERED = 0.75

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class _State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: (sequence, index of its last token) of the strings that end here.
    places: list[tuple[int, int]] = field(default_factory=list)


class SuffixAutomaton:
    """All substrings of several token sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.states = [_State()]
        for number, sequence in enumerate(sequences):
            last = 0
            for index, token in enumerate(sequence):
                last = self._extend(last, token)
                self.states[last].places.append((number, index))
        for s in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            if (link := self.states[s].link) > 0:
                known = set(self.states[link].places)
                self.states[link].places += [p for p in self.states[s].places if p not in known]

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the strings of length up to p's plus one."""
        states = self.states
        copy = len(states)
        states.append(_State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = copy
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = copy
            p = states[p].link
        return copy

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if (q := states[last].next.get(token)) is not None:
            return q if states[q].length == states[last].length + 1 else self._split(last, token, q)
        new = len(states)
        states.append(_State(states[last].length + 1))
        p = last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].next[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._split(p, token, q)
        return new


class LicenseScanner:
    def __init__(self, phrases=tuple(PHRASES), templates=tuple(TEMPLATES), anchor: int = ANCHOR, gap: int = GAP):
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.phrases, self.anchor, self.gap = len(phrases), anchor, gap
        split = [split_words(text) for _, text in (*phrases, *templates)]
        vocabulary = sorted({w for s in split for w in s})
        self.sizes = [len(s) for s in split]
        self.shortest = min([anchor, *self.sizes[: len(phrases)]])
        number = {w: i for i, w in enumerate(vocabulary)}
        automaton = SuffixAutomaton([[number[w] for w in s] for s in split])
        hashes, _ = textkit.words(pa.array(vocabulary), textkit.LETTER_WORD)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        states = automaton.states
        self.next = [s.next for s in states]
        self.link = [s.link for s in states]
        self.length = [s.length for s in states]
        self.places = [s.places for s in states]
        #: Phrases that end where a state's strings end, as (words, phrase): its own and those of its suffixes.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in states]
        for phrase in range(self.phrases):
            state = 0
            for word in split[phrase]:
                state = self.next[state][number[word]]
            self.ends[state].append((self.sizes[phrase], phrase))
        for i in sorted(range(1, len(states)), key=self.length.__getitem__):
            self.ends[i] += self.ends[self.link[i]]

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]]:
        """Of each text: its words; phrases found (phrase, start); spans (template, first word, end word, coverage)."""
        hashes, firsts = textkit.words(column, textkit.LETTER_WORD)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes
        numbers = self.numbers[at]
        # Runs of known words inside a text that can hold a phrase or an anchor.
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        inner = firsts[1:-1][firsts[1:-1] < len(known)]
        begin[inner] = known[inner]
        starts = np.flatnonzero(begin)
        stop = ~known
        stop[inner] = True
        stops = np.append(np.flatnonzero(stop), len(known))
        ends = stops[np.searchsorted(stops, starts, "right")]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        runs = np.searchsorted(starts, firsts)
        starts, ends, runs = starts.tolist(), ends.tolist(), runs.tolist()
        for i, first in enumerate(firsts[:-1].tolist()):
            phrases: list[tuple[int, int]] = []
            anchors: list[tuple[int, int, int]] = []
            for r in range(runs[i], runs[i + 1]):
                self._run(numbers[starts[r] : ends[r]].tolist(), starts[r] - first, phrases, anchors)
            yield int(firsts[i + 1]) - first, phrases, self._chains(anchors) if anchors else []

    def _run(self, tokens: list[int], base: int, phrases: list, anchors: list) -> None:
        next_, link, length, ends = self.next, self.link, self.length, self.ends
        state = size = 0
        for i, token in enumerate(tokens):
            if token not in next_[state]:
                if size >= self.anchor:
                    anchors.append((base + i - size, size, state))
                while state and token not in next_[state]:
                    state = link[state]
                size = length[state]
            if token in next_[state]:
                state = next_[state][token]
                size += 1
            for words, phrase in ends[state]:
                if words <= size:
                    phrases.append((phrase, base + i + 1 - words))
        if size >= self.anchor:
            anchors.append((base + len(tokens) - size, size, state))

    def _chains(self, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """The best chains of the templates, none overlapping another."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in anchors:
            for template, last in self.places[state]:
                by_template.setdefault(template, []).append((start, last + 1 - size, size))
        spans = []
        for template, found in sorted(by_template.items()):
            found.sort()
            open_: list[tuple[int, int, int, int]] = []  # first word, end word, end in template, words covered
            done: list[tuple[int, int, int, int]] = []
            for start, place, size in found:
                done += [c for c in open_ if c[1] + self.gap < start]
                open_ = [c for c in open_ if c[1] + self.gap >= start]
                best = (start, start + size, place + size, size)
                for c in open_:
                    cut = max(0, c[1] - start, c[2] - place)  # overlap counts once
                    if cut < size and c[3] + size - cut > best[3] and place + size > c[2]:
                        best = (c[0], start + size, place + size, c[3] + size - cut)
                # Chains that end in the same place of the template only differ in what they cover.
                open_ = [c for c in open_ if c[2] != best[2] or c[3] > best[3]]
                open_.append(best)
            spans += [(template, first, end, covered / self.sizes[template], covered) for first, end, _, covered in done + open_]
        spans.sort(key=lambda s: (-s[3], -s[4], s[1], s[0]))
        kept: list[tuple[int, int, int, float]] = []
        starts: list[int] = []  # of the spans kept, ascending, and their ends
        ends: list[int] = []
        for template, first, end, coverage, _ in spans:
            at = bisect_right(starts, first)
            if (at == 0 or ends[at - 1] <= first) and (at == len(starts) or end <= starts[at]):
                starts.insert(at, first)
                ends.insert(at, end)
                kept.append((template, first, end, coverage))
        return kept


_scanner: LicenseScanner | None = None


def scanner() -> LicenseScanner:
    global _scanner
    _scanner = _scanner or LicenseScanner()
    return _scanner


_SCAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    for whole in batches:
        for a, b in textkit.slices(whole.column(1)):
            n_words, phrases, spans = [], [], []
            for n, found, covered in s.scan(whole.column(1).slice(a, b - a)):
                n_words.append(n)
                phrases.append([{"label": s.labels[p], "start": w} for p, w in found])
                spans.append([{"label": s.labels[t], "start": i, "end": j, "coverage": c} for t, i, j, c in covered])
            yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(phrases, _SCAN), pa.array(spans, _SPAN)], ["doc_id", "n_words", "phrases", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, phrases (label, start), spans (label, start, end, coverage); words count from 0."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, phrases array<struct<label: string, start: long>>, spans array<struct<label: string, start: long, end: long, coverage: double>>"
    return scratch.spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(textkit.task(_scan), schema)


def summary(scanned: DataFrame, covered: float = COVERED) -> DataFrame:
    """Per document: counts and places of phrases, labels of phrases and of covered templates, the best coverage."""
    base = F.sort_array(F.array_distinct(F.col("phrases.label")))
    own = F.transform(F.filter("spans", lambda s: s["coverage"] >= covered), lambda s: s["label"])
    best = F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.col("phrases.start")).alias("first_word"),
        F.array_max(F.col("phrases.start")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )
