"""Language identification, words first.

A word seen in training scores by its log frequency in each language.  A word
not seen falls back to its character n-grams: the longest length of which it
has a known n-gram is used, then the next shorter, down to single characters.
The language of the greatest mean over a text's words is predicted; the score
is the softmax of these means, sharpened by a factor that is fitted on rows kept
aside, so it tells how one-sided the words are and not how many there are: a
text of two languages in equal parts scores about one half however long it is.

The classifier is fitted on a bounded sample of labelled rows (`TRAIN_ROWS`,
drawn by hash); it is the only part that does not read everything.

Defined cases: a null text or one without a letter is ``und`` with score 0;
ties go to the language first by code point; rows with a null language do not
train; without a training row every text is ``und``; texts of any length are
read whole, a few million bytes at a time; repeated rows each get a row; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit

#: Labelled rows drawn for fitting, on average, where there are more.
TRAIN_ROWS = 2_000
#: Longest character n-grams, and how often a training word must occur to be a known word.
LONGEST, KNOWN = 4, 2
#: One in so many drawn rows is kept aside from a first fit, which finds the scores' sharpness, which is at most `SHARPEST`.
ASIDE, SHARPEST = 5, 64.0
UNDETERMINED = "und"


def _letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _gram_counts(words: list[str], by_word: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
    """Character n-grams of the words with their counts, longest first; those of two or more characters see the words' edges."""
    marked = "".join(f"^{w}$" for w in words)
    alphabet, chars = np.unique(np.frombuffer(marked.encode("utf-32-le"), "<u4"), return_inverse=True)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters from here to the word's end
    inner = (left > 1) & (left < np.repeat(sizes, sizes))
    out = []
    code = np.zeros(len(chars), np.int64)
    for n in range(1, LONGEST + 1):  # a gram is the one shorter by a character and that character
        following = np.zeros(len(chars), np.int64)
        following[: len(chars) - n + 1] = chars[n - 1 :]
        fits = left >= n
        keys, first, number = np.unique((code * len(alphabet) + following)[fits], return_index=True, return_inverse=True)
        code = np.zeros(len(chars), np.int64)
        code[fits] = number
        counted = inner if n == 1 else fits
        by_gram = np.stack([np.bincount(code[counted], by_word[word[counted], k], len(keys)) for k in range(by_word.shape[1])], axis=1) if len(words) else np.zeros((0, by_word.shape[1]))
        at = np.flatnonzero(fits)[first].tolist() if len(words) else []
        some = np.flatnonzero(by_gram.sum(1) > 0)  # not the edges alone
        out.append(([marked[at[k] : at[k] + n] for k in some.tolist()], by_gram[some]))
    return out[::-1]


class LanguageModel:
    """Log frequencies per language of known words and of n-grams by length."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.sharpness = 1.0
        self.words: dict[str, int] = {}  # to rows of logs
        self.grams: list[dict[str, int]] = []  # the same, longest first
        self.logs = np.zeros((0, len(languages)))

    @classmethod
    def fit(cls, counts: Counter) -> LanguageModel:
        """From counts of (language, word)."""
        model = cls(sorted({lang for lang, _ in counts}, key=str.encode))
        column = {lang: i for i, lang in enumerate(model.languages)}
        index = {w: i for i, w in enumerate(dict.fromkeys(w for _, w in counts))}
        by_word = np.zeros((len(index), len(column)))
        places, values = [(index[w], column[lang]) for lang, w in counts], list(counts.values())
        if places:
            np.add.at(by_word, tuple(np.array(places).T), values)
        model.words = model._add(list(index), by_word)
        model.grams = [model._add(names, found) for names, found in _gram_counts(list(index), by_word)]
        return model

    def _add(self, names: list[str], counts: np.ndarray) -> dict[str, int]:
        """Keep the keys that occur often enough, with smoothed log frequencies."""
        kept = np.flatnonzero(counts.sum(1) >= KNOWN)
        logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(counts)))[kept]
        first = len(self.logs)
        self.logs = np.concatenate([self.logs, logs])
        return {names[i]: first + k for k, i in enumerate(kept.tolist())}

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word per language, and 1 if it has a letter."""
        flat, sizes, letters = [], [], []
        known = self.words.get
        tables = [(n, table.get) for n, table in zip(range(LONGEST, 0, -1), self.grams, strict=True)]
        for raw in words:
            word = _letters(raw)
            letters.append(bool(word))
            if (at := known(word)) is not None:
                flat.append(at)
                sizes.append(1)
                continue
            found = []
            for n, get in tables if word else ():
                marked = f"^{word}$" if n > 1 else word
                if found := [at for i in range(len(marked) - n + 1) if (at := get(marked[i : i + n])) is not None]:
                    break
            flat += found
            sizes.append(len(found))
        size = np.array(sizes, np.int64)
        sums = np.zeros((len(flat) + 1, len(self.languages)))
        np.cumsum(self.logs[np.array(flat, np.int64)], axis=0, out=sums[1:])
        ends = np.cumsum(size)
        out = np.empty((len(words), len(self.languages) + 1))
        out[:, :-1] = (sums[ends] - sums[ends - size]) / np.maximum(size, 1)[:, None]
        out[:, -1] = letters
        return out


def held_out(id_col: str, mod: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, lang, aside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buf = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = textkit.word_spans(buf, np.array([0, len(buf)]), textkit.LETTER_WORD)
            raw = buf.tobytes()
            counts.update((lang, w, aside) for i, j in zip(starts.tolist(), ends.tolist(), strict=True) if (w := _letters(raw[i:j].decode())))
    if counts:
        langs, words, aside = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(aside), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "aside", "n"])


def sample_rows(rows: DataFrame, key: Column, wanted: int) -> DataFrame:
    """All rows, or where there are more than `wanted` about that many, drawn by the hash of a key."""
    n = rows.count()
    return rows if n <= wanted else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 32)) < int(wanted / n * (1 << 32)))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on at most about `train_rows` rows; the counts of their words and a few numbers for each row kept aside reach the driver."""
    labelled = train.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit("aside")).alias("h"))
    drawn = sample_rows(labelled, F.col("h"), train_rows)
    drawn = scratch.spread(drawn).select("text", "lang", (F.pmod("h", F.lit(ASIDE)) == 0).alias("aside"))
    counted = drawn.mapInArrow(textkit.task(_count_words), "lang string, word string, aside boolean, n long")
    most, every = Counter(), Counter()
    for lang, word, aside, n in zip(*(c.to_pylist() for c in counted.groupBy("lang", "word", "aside").agg(F.sum("n").alias("n")).toArrow().columns), strict=True):
        every[lang, word] += n
        most[lang, word] += 0 if aside else n
    model, part = LanguageModel.fit(every), LanguageModel.fit(+most)
    if len(part.languages) > 1:
        shared = train.sparkSession.sparkContext.broadcast(part)
        kept = drawn.where("aside").where(F.col("lang").isin(part.languages)).select("lang", "text")
        found = kept.mapInArrow(textkit.task(_averager(shared)), "lang string, means array<double>").collect()
        model.sharpness = sharpness([(part.languages.index(r.lang), r.means) for r in found])
    return model


def sharpness(rows: list[tuple[int, list[float]]]) -> float:
    """The factor on mean logs that makes the languages of rows (language, means) likeliest; one in 200 labels may be wrong."""
    if not rows:
        return 1.0
    means = np.array([m for _, m in rows])
    right = (np.arange(len(rows)), np.array([i for i, _ in rows]))

    def likelihood(a: float) -> float:
        each = np.exp(a * (means - means.max(1, keepdims=True)))
        return float(np.log(0.995 * each[right] / each.sum(1) + 0.005 / means.shape[1]).sum())

    return max((2.0 ** (k / 4) for k in range(int(4 * np.log2(SHARPEST)) + 1)), key=likelihood)


def _means(table: textkit.WordTable, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean logs of each text's words, and whether it has a letter."""
    sums = table.sums(column, textkit.LETTER_WORD, textkit.EXACT)
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1] > 0.5


def _averager(shared):
    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of lang, text -> lang, means."""
        table = textkit.WordTable(len(shared.value.languages) + 1, shared.value.rows)
        for whole in batches:
            for a, b in textkit.slices(whole.column(1)):
                means, letters = _means(table, whole.column(1).slice(a, b - a))
                some = np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a).take(pa.array(some)), pa.array(list(means[some]), pa.list_(pa.float64()))], ["lang", "means"])

    return average


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = textkit.WordTable(len(model.languages) + 1, model.rows)
        names = np.array([*model.languages, UNDETERMINED], object)
        for whole in batches:
            for a, b in textkit.slices(whole.column(1)):
                means, letters = _means(table, whole.column(1).slice(a, b - a))
                if model.languages:
                    best = means.argmax(1)
                    score = 1 / np.exp(model.sharpness * (means - means.max(1, keepdims=True))).sum(1)
                else:
                    best, letters, score = np.zeros(b - a, int), np.zeros(b - a, bool), np.zeros(b - a)
                best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return scratch.spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(textkit.task(_predictor(shared)), schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language is determined with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in textkit.slices(batch.column(at)):
                    waiting.append(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.nulls(b - a), batch.column(at).slice(a, b - a)], ["i", "t"])

        for scored in _predictor(shared)(texts()):  # a slice at a time, in the same cuts
            yield waiting.popleft().filter(pc.greater_equal(scored.column(2), least))

    return scratch.spread(docs).mapInArrow(textkit.task(keep), docs.schema)
