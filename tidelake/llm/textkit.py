"""Vectorised text primitives over Arrow string buffers.

Words are found and hashed for a whole record batch at once, straight from the
UTF-8 bytes, so no Python object is made per word.  A word's hash is a
polynomial over per-byte random values modulo 2**64 followed by a finaliser;
two distinct words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at a time; bounds the working memory whatever the text's length.
BLOCK = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def _random_bytes_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)


#: One value per byte, and the same with A-Z folded onto a-z.
EXACT = _random_bytes_table(20240607)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]

#: Byte classes.  Space words: anything but ASCII white space.  Letter words:
#: ASCII letters and digits, and every byte of a non-ASCII character.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
LETTER_WORD = np.zeros(256, bool)
LETTER_WORD[48:58] = LETTER_WORD[65:91] = LETTER_WORD[97:123] = LETTER_WORD[128:] = True

def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > BLOCK + 1:  # one word of over a block: its tables are not kept
        return _make_powers(n)
    return _block_powers()


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(n, _MULT, U64)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    steps[1:] = _MULT_INV
    return powers, np.multiply.accumulate(steps)


@functools.cache
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair of two hashes."""
    return mix(a * U64(0xA0761D6478BD642F) + mix(b) + U64(0x8EBC6AF09C88C6E3))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of their ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0]
    return buf[first : offsets[-1]], offsets - first


def word_spans(buf: np.ndarray, offsets: np.ndarray, word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text its first word's index (n+1 values).

    A word is a maximal run of bytes of the class inside one text.
    """
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word_class[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, computed block by block."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        stop = int(ends[b - 1] - base)
        powers, inverse = _power_tables(stop + 1)
        sums = np.empty(stop + 1, U64)
        sums[0] = 0
        np.cumsum(table[buf[base : base + stop]] * powers[:stop], out=sums[1:])
        s = starts[a:b] - base
        out[a:b] = (sums[ends[a:b] - base] - sums[s]) * inverse[s]
        a = b
    return mix(out + (ends - starts).astype(U64))


def words(column: pa.Array, word_class: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and each text's first word's index (n+1 values)."""
    buf, offsets = text_buffers(column)
    starts, ends, firsts = word_spans(buf, offsets, word_class)
    return span_hashes(buf, starts, ends, table), firsts


def slices(column: pa.Array, most: int = 4 << 20):
    """The rows of a text column in runs of about `most` bytes at most (one row at least)."""
    if not len(column):
        return
    sizes = np.diff(text_buffers(column)[1])
    a, total = 0, 0
    for i, size in enumerate(sizes):
        if i > a and total + size > most:
            yield a, i
            a, total = i, 0
        total += int(size)
    yield a, len(column)


#: Bytes of words' numbers that a task keeps; longer words than `LONG` bytes are never kept as text.
KEPT_BYTES = 48 << 20
LONG = 256


_CODEC = pa.Codec("zstd", 1)


def squeeze(numbers: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, plane by plane."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    return squeeze(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=U64)


class Growing:
    """An array that rows are appended to."""

    def __init__(self, dtype, *shape: int):
        self._data, self.n = np.zeros((1024, *shape), dtype), 0

    def append(self, rows: np.ndarray) -> None:
        end = self.n + len(rows)
        if end > len(self._data):
            wider = np.zeros((max(end, 2 * len(self._data)), *self._data.shape[1:]), self._data.dtype)
            wider[: self.n] = self._data[: self.n]
            self._data = wider
        self._data[self.n : end] = rows
        self.n = end

    @property
    def rows(self) -> np.ndarray:
        return self._data[: self.n]


class KeyIndex:
    """Places of 64-bit keys, numbered as they come.

    Keys wait in sorted levels, each over twice as large as the next, so adding
    costs a merge now and then instead of a sort of all keys each time.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1)
        for known, places in self.levels:
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            hit = known[at] == keys
            out[hit] = places[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Places for ascending keys that are not here yet."""
        places = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        known, at = keys, places
        while self.levels and len(self.levels[-1][0]) < 2 * len(known):
            older, older_at = self.levels.pop()
            known, at = np.concatenate([older, known]), np.concatenate([older_at, at])
            order = np.argsort(known, kind="stable")
            known, at = known[order], at[order]
        self.levels.append((known, at))
        return places


class WordTable:
    """A row of numbers for each distinct word, worked out when the word is first met.

    Keeps about `KEPT_BYTES` of them and then starts anew, so memory stays
    bounded over any number of texts.
    """

    def __init__(self, width: int, learn):
        self.learn, self.width = learn, width
        self._forget()

    def _forget(self) -> None:
        self.index, self.kept = KeyIndex(), Growing(np.float64, self.width)

    def sums(self, column: pa.Array, word_class: np.ndarray, table: np.ndarray) -> np.ndarray:
        """For each text, the sum of its words' rows."""
        buf, offsets = text_buffers(column)
        starts, ends, firsts = word_spans(buf, offsets, word_class)
        if not len(starts):
            return np.zeros((len(column), self.width))
        distinct, where, inverse = np.unique(span_hashes(buf, starts, ends, table), return_index=True, return_inverse=True)
        rows = self._rows(buf, starts, ends, distinct, where)
        totals = np.zeros((len(starts) + 1, self.width))
        np.cumsum(rows[inverse], axis=0, out=totals[1:])
        return totals[firsts[1:]] - totals[firsts[:-1]]

    def _rows(self, buf, starts, ends, distinct, where) -> np.ndarray:
        places = self.index.find(distinct)
        new = np.flatnonzero(places < 0)
        if len(new):
            if self.index.n * (16 + 8 * self.width) > KEPT_BYTES:
                self._forget()
                new = np.arange(len(distinct))
            raw = buf.tobytes()
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)
            self.kept.append(self.learn([raw[i:j].decode() for i, j in spans]))
            places[new] = self.index.add(distinct[new])
        return self.kept.rows[places]


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return None


_trim = _find_trim()


def task(run):
    """A function of Arrow batches that gives its memory back when its task ends.

    Python workers serve task after task and stage after stage; what one leaves
    behind would add up in them.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def groups(batches, keys: int):
    """Runs of rows with equal values in the first `keys` columns, as tables; rows come sorted by these."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for column in batch.columns[:keys]:
            changed[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(changed).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = key
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def runs(batches, keys: int, rows: int = 20_000):
    """Many whole groups at a time of rows with equal values in the first `keys` integer columns, by which they come sorted.

    Yields tables of at least `rows` rows (less at the end) and the starts of
    their groups, with the end of the last.
    """
    waiting: list[pa.RecordBatch] = []
    n = 0

    def starts_of(table: pa.Table) -> np.ndarray:
        changed = np.zeros(len(table), bool)
        changed[0] = True
        for column in table.columns[:keys]:
            values = column.to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(changed), len(table))

    for batch in batches:
        if len(batch):
            waiting.append(batch)
            n += len(batch)
        if n >= rows:
            table = pa.Table.from_batches(waiting)
            starts = starts_of(table)
            last = int(starts[-2])
            if last:
                yield table.slice(0, last), starts[:-1]
            waiting, n = table.slice(last).to_batches(), n - last
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, starts_of(table)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that edges (a, b) connect it to."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
