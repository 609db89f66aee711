import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.llm import components, embeddings, fingerprints, jaccard, language, licenses, lm_scores, mixing, packing, quality, queries, scratch, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def empty(docs):
    return docs.limit(0)


# -- 1: quality


def test_quality_learns_and_handles_odd_rows(spark, docs):
    rows = [(i, ("good words in a calm line " if i % 2 else "BUY!! NOW!! ### ") * (i % 5 + 1)) for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(train, labels)
    scored = {r.doc_id: r.score for r in quality.score(train, model).collect()}
    assert all((scored[i] >= quality.THRESHOLD) == bool(i % 2) for i in range(120))
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty(docs), model).count() == 0
    assert quality.score(docs, quality.train(train, empty(labels))).count() == docs.count()
    one = quality.train(train, labels.where("quality = 1"))
    assert {r.score > 0.99 for r in quality.score(docs, one).collect()} == {True}
    assert quality.keep_good(train, model).columns == train.columns and quality.keep_good(train, model).count() == 60


def test_quality_held_out(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    labelled = queries.op1_nb_svm_quality(spark, larger).where("held_out").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    assert labelled.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).head()[0] > 0.88


def test_descent_reaches_the_optimum():
    """Primal and dual objectives meet, so the weights are those of any exact solver."""
    draw = np.random.default_rng(1)
    dense = draw.normal(size=(60, 9)) * (draw.random((60, 9)) < 0.5) + 1e-3
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    y = np.where(dense[:, 0] + 0.3 * draw.normal(size=60) > 0, 1.0, -1.0)
    costs = np.where(y > 0, 0.7, 1.6)
    rows = [np.flatnonzero(x) for x in dense]
    w, b, alpha = quality.descend(rows, [x[r] for x, r in zip(dense, rows, strict=True)], y, costs, 9, 400, 3)
    norm = w @ w + b * b  # the bias is a weight of a constant 1
    primal = norm / 2 + costs @ np.maximum(0, 1 - y * (dense @ w + b))
    dual = alpha.sum() - norm / 2
    assert np.allclose(w, (alpha * y) @ dense) and b == pytest.approx(alpha @ y) and (alpha >= 0).all() and (alpha <= costs).all()
    assert primal - dual < 1e-3 * primal


def test_quality_trains_on_one_row_of_an_id(spark):
    rows = [(i, "calm good line " * 3 if i % 2 else "BUY NOW ### " * 3) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = quality.train(spark.createDataFrame(rows + rows[:7] * 50, "doc_id long, text string").repartition(5), labels)
    assert np.array_equal(once.weights, again.weights) and once.bias == again.bias
    assert {r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0))).collect()} == {0.5}


@given(st.binary(max_size=200))
def test_indicators(data):
    seen = np.zeros(1 << quality.BITS, np.int32)
    found = quality.indicators(np.frombuffer(data, np.uint8), seen)
    assert len(found) == len(set(found.tolist()))
    assert len(found) <= sum(len({data[i : i + n] for i in range(len(data) - n + 1)}) for n in quality.LENGTHS)


# -- 2: packing


def test_packing_covers_every_token(spark, sf):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = queries.op2_best_fit_packing(spark, sf).collect()
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(spark, sf).items()}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.start for p in pieces] == [2048 * k for k in range(len(pieces))] and sum(p.length for p in pieces) == len(ids[i])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= math.ceil(total / 2048) * 1.02 + 1


def test_packing_odd_rows(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(docs, path, with_ids=True).collect()
    assert len({r.sequence_id for r in out if r.doc_id == 5}) >= 15 and all(len(r.ids) == r.length for r in out)
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id in (3, 4)) == [(3, 1), (4, 1)]
    assert sum(r.doc_id == 2 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    assert packing.pack(empty(docs), path).count() == 0


WORDS = ["it's", "don't!'s", "A\nB\tC", "x<|endoftext|>Y z", "É́é ΣΑΣ. İI ǅ", "a≠b x y z", "foo!!! $$$ a.b,c' 12a3", "́ ́a á.", "it'S. 'LL", "a　b", "🙂🙂. x🙂 .🙂", "o'.s o.'s x.'ll", "İ= KİTABİ. BEYİ, İ.", "ŉ. ǰ! ß. ẞ, ﬁ; Ω.", "á̧. ệ= x̸= i̇.", ""]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t'.,!<|>abzABéßΣ̸́🙂½٣²")), max_size=24), max_size=5))
def test_word_encoder_is_exact(more):
    encode = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode.by_word
    column = pa.array([*WORDS, *more])
    ids, firsts = encode(column)
    for i, t in enumerate(column.to_pylist()):
        assert ids[firsts[i] : firsts[i + 1]].tolist() == encode.model.encode(t, add_special_tokens=False).ids, t


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plan_fills_gaplessly(histogram):
    places = {}
    for length, first_rank, ranks, sequence, each, place in packing.plan(histogram, 64):
        for r in range(ranks):
            places.setdefault(sequence + r // each, []).append((place + r % each * length, length))
        assert first_rank + ranks <= histogram[length]
    assert Counter(n for p in places.values() for _, n in p) == histogram
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    if histogram:
        assert len(places) <= 11 / 9 * max(1, math.ceil(sum(k * n for k, n in histogram.items()) / 64)) + 1 + sum(n for k, n in histogram.items() if k > 32)


# -- 3: language-model scores


class LmReference:
    """The model by its formulas, with no automaton."""

    def __init__(self, rows, trains):
        self.split = {i: t.encode().lower().split() + [None] for i, t in rows}
        self.c = c = Counter()
        for i, w in self.split.items():
            if trains(i):
                c["^",] += 1
                for before, x in self.steps(w):
                    c.update([(x,), (before[-1], x)] + [(*before[-2:], x)] * (len(before) > 1))
        self.words = {k[0]: n for k, n in c.items() if len(k) == 1 and k != ("^",)}
        self.n, self.v = sum(self.words.values()), len(self.words)
        once, twice = (sum(x == k for x in self.words.values()) for k in (1, 2))
        self.d = (once + 1) / (once + 2 * twice + 2)

    def steps(self, w):
        return [(("^", *w[:k]), x) for k, x in enumerate(w)]

    def p(self, before, x):
        c, (m2, m3) = self.c, lm_scores.MASSES
        q = ((c[x,] - self.d) / self.n if c[x,] else self.d * self.v / self.n) if self.n else 1.0
        p = (c[before[-1], x] + m2 * q) / (c[before[-1],] + m2)
        return (c[(*before[-2:], x)] + m3 * p) / (c[before[-2:]] + m3) if len(before) > 1 else p

    def score(self, w):
        return sum(math.log10(self.p(*s)) for s in self.steps(w))


def lm_reference(rows, trains):
    r = LmReference(rows, trains)
    return {i: (len(w), sum(r.c[x,] > 0 for x in w), r.n, sum(math.log10((r.c[x,] + 1) / (r.n + r.v + 1)) for x in w), r.score(w)) for i, w in r.split.items()}


def test_lm_automaton(monkeypatch):
    """In every state the words and the class of unknown ones have probabilities that sum to one, and walks by parts agree."""
    rows = [(1, "a b a c a b"), (2, "b a b"), (3, "c c c a"), (4, "d"), (5, "zz a b zz zz d d d"), (6, "a b c " * 60), (7, "")]
    r = LmReference(rows, lambda i: i < 5)
    for before in (("^",), ("^", b"a"), (b"a", b"b"), (b"c", b"d"), (b"zz", b"a"), (b"b", b"zz")):
        assert sum(r.p(before, x) for x in [*r.words, b"unknown"]) == pytest.approx(1.0)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), pa.array([i < 5 for i, _ in rows])], ["i", "t", "trains"])
    (made,) = list(lm_scores._blocks(iter([batch])))
    block = lm_scores.Block(made.column(2)[0].as_py(), *(made.column(k)[0].as_py() for k in (3, 4, 5, 6)), 60)
    own = np.delete(block.counts()[0], block.start)
    for part in (lm_scores.PART, 3, 7):
        monkeypatch.setattr(lm_scores, "PART", part)
        walked = lm_scores.Automaton(block, block.counts(), own.sum(), (own > 0).sum(), (own == 1).sum(), (own == 2).sum(), lm_scores.MASSES).walk(block)
        assert walked == pytest.approx([r.score(w) for w in r.split.values()])


def test_lm_equals_reference(spark, sf):
    want = lm_reference(texts(spark, sf).items(), lambda i: held(i, 7) != 2)
    got = {r.doc_id: r for r in queries.op3_backoff_lm(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (tokens, known, n, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held(i, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_lm_odd_rows(spark, docs):
    out = lm_scores.score(docs, F.col("doc_id") != 7).collect()
    assert len(out) == docs.count() and {r.n_tokens for r in out if r.doc_id in (3, 4)} == {1}
    assert not any(r.trains for r in out if r.doc_id in (None, 7)) and all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert {r.score for r in lm_scores.score(docs, F.lit(False)).collect()} <= {0.0} | {r.score for r in lm_scores.score(docs, F.lit(False)).collect() if r.train_tokens == 0}
    assert lm_scores.score(empty(docs), F.lit(True)).count() == 0


# -- 4: licenses


def test_license_places_equal_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        w = licenses.split_words(t)
        found = [(label, k) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for _, k in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize("label,text", licenses.TEMPLATES)
def test_license_texts(label, text):
    """A whole text, somewhere in noise, is one span of its own label; cut in half it is none."""
    s = licenses.scanner()
    noise = "und zxq the of blörk "
    ((n, _, spans),) = list(s.scan(pa.array([noise * 5 + text + " " + noise * 5])))
    words = licenses.split_words(text)
    assert [(s.labels[t], first, end, c) for t, first, end, c in spans if c >= licenses.COVERED] == [(label, 25, 25 + len(words), 1.0)] and n == 50 + len(words)
    ((_, _, spans),) = list(s.scan(pa.array([noise + " ".join(words[: len(words) // 2])])))
    assert not any(c >= licenses.COVERED for t, _, _, c in spans if s.sizes[t] == len(words))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.sampled_from("a b c d e x".split()), max_size=300), st.integers(1, 3))
def test_spans_never_overlap(words, anchor):
    s = licenses.LicenseScanner([("one", "e")], [("t", "a b c d a b"), ("u", "c d a a b c")], anchor)
    ((_, phrases, spans),) = list(s.scan(pa.array([" ".join(words)])))
    assert [w for _, w in phrases] == [i for i, w in enumerate(words) if w == "e"]
    places = sorted((a, b) for _, a, b, _ in spans)
    assert all(x[1] <= y[0] for x, y in zip(places, places[1:])) and all(0 < c <= 1 for *_, c in spans)
    # The best covered template is that of the best chain: anchors in order in text and template, gaps kept.
    def best(template):
        t, found = template.split(), []
        for i in range(len(words)):
            for k in range(len(t)):
                size = 0
                while i + size < len(words) and k + size < len(t) and words[i + size] == t[k + size]:
                    size += 1
                if size >= anchor:
                    found.append((i, k, size))
        return max((size / len(t) for *_, size in found), default=0.0)

    assert max((c for *_, c in spans), default=0.0) >= max(best("a b c d a b"), best("c d a a b c")) - 1e-9


@settings(deadline=None)
@given(st.lists(st.sampled_from("mit license apache cc by gnu general public the licensed under version".split()), max_size=40))
def test_matching_statistics(words):
    s = licenses.scanner()
    ((n, phrases, _),) = list(s.scan(pa.array([" ".join(words)])))
    want = sorted((k, i) for k, (_, p) in enumerate(licenses.PHRASES) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert n == len(words) and sorted(phrases) == want


def test_license_spans(spark, docs):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit").replace("any person", "each person")
    df = spark.createDataFrame([(1, f"some code\n{mit}\nmore code"), (2, "free of charge"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    (span,) = [s for s in out[1].spans if s.label == "mit"]
    assert span.coverage > 0.9 and span.start == 2 and {r.doc_id: r.labels for r in licenses.summary(licenses.scan(df)).collect()} == {1: "mit", 2: "", 3: ""}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(docs)).count() == 0
    assert licenses.summary(licenses.scan(docs)).where("doc_id IS NULL").head().n_base == 2


# -- 5: fingerprints


def cut(text):
    """Chunks by the gear hash, byte after byte."""
    data, out, start, gear = text.encode(), [], 0, 0
    for i, byte in enumerate(data):
        gear = ((gear << 1) + int(fingerprints._GEAR[byte])) & 0xFFFFFFFF
        n = i + 1 - start
        mask = fingerprints.STRICT if n < fingerprints.NORMAL else fingerprints.LOOSE
        if n == fingerprints.LARGEST or n > fingerprints.LEAST and gear & int(mask) == 0:
            out.append(data[start : i + 1])
            start = i + 1
    return out + [data[start:]] * (start < len(data))


def contained(a, b):
    a, b = set(cut(a)), set(cut(b))
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def test_fingerprints_of_edits(spark, sf):
    own = sorted(texts(spark, sf).items(), reverse=True)
    got = {r.doc_id: r for r in queries.op5_chunk_fingerprints(spark, sf).collect()}
    for k, (i, t) in enumerate(own):
        following = own[(k + 1) % len(own)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(fingerprints.chunk_set(t)) and r.edited_fingerprint == fingerprints.fingerprint(fingerprints.chunk_set(edited))
        assert r.near_edited == pytest.approx(contained(t, edited)) and r.near_next == pytest.approx(contained(t, following))


@given(st.text(max_size=3000), st.text(max_size=20), st.integers(0, 3000))
def test_chunks_resist_shifts(text, inserted, at):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = fingerprints.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(data) and all(s <= fingerprints.LARGEST for s in sizes) and all(s > fingerprints.LEAST or s > 0 and i == len(sizes) - 1 for i, s in enumerate(sizes))
    a = fingerprints.chunk_set(text)
    assert fingerprints.likeness(a, a) == 1.0
    prose = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[: i % 9 + 2] for i in range(400))
    b = fingerprints.chunk_set(prose[: at % 2000] + inserted + prose[at % 2000 :])
    assert fingerprints.likeness(fingerprints.chunk_set(prose), b) > 0.75


def test_fingerprint_odd_rows(spark, docs):
    out = fingerprints.compare_next(docs).collect()
    assert len(out) == docs.count() and len({r.fingerprint for r in out if r.doc_id == 2}) == 1
    assert {r.fingerprint for r in out if r.doc_id in (3, 4)} == {""}
    assert fingerprints.compare_next(empty(docs)).count() == 0 and fingerprints.compare_next(docs.where("doc_id = 1")).head().near_next == 1.0
    assert fingerprints.fingerprints(docs).count() == docs.count()
    with pytest.raises(TypeError):
        fingerprints.compare_next(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


# -- 6: language


def test_language_held_out(spark, sf):
    out = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).head()[0] > 0.9


def test_language_odd_rows(spark, docs):
    model = language.fit(docs)
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert {out[i].lang_pred for i in (3, 4, 6)} == {"und"} and out[7].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    assert language.predict(empty(docs), model).count() == 0
    assert language.keep_identified(docs, model).columns == docs.columns
    none = language.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_language_backoff():
    model = language.LanguageModel.fit(Counter({("de", "schule"): 5, ("de", "schon"): 5, ("en", "the"): 5, ("en", "there"): 5}))
    rows = model.rows(["Schule", "scholz", "12", "theremin", "qq"])
    assert rows[0, 0] > rows[0, 1] and rows[1, 0] > rows[1, 1] and rows[3, 1] > rows[3, 0] and rows[2].tolist() == [0, 0, 0] and rows[4].tolist() == [0, 0, 1]


# -- 7: embeddings


def cosine_links(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T >= threshold
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("functions,tables", [(None, embeddings.TABLES), (2, 16), (3, 24)])
def test_embedding_links(spark, monkeypatch, functions, tables):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 32))
    x = np.concatenate([np.repeat(centres, 25, 0) + 0.08 * draw.normal(size=(150, 32)), draw.normal(size=(60, 32)), np.repeat(centres[:1], 30, 0)])
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, functions=functions, tables=tables).collect()}
    found = total = 0
    for label in (0, 1):
        ids = np.arange(len(x))[np.arange(len(x)) % 2 == label]
        s = cosine_links(x[ids], 0.98)
        n = np.array([got[i].n_links for i in ids])
        assert (n <= s.sum(1)).all()
        found, total = found + n.sum(), total + s.sum()
    assert total > 500 and found >= 0.99 * total
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got.values())


def test_embedding_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], None), (7, [1.0, inf], 1), (8, [1.0, None], 1), (9, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1), (12, [], 1), (3, [1.0, 2.0], 1), (13, [1e300, 2e300], 1)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash")))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in out.collect())
    assert got == [(0, 5, 1, False), (1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (3, 5, 1, False), *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 12)), (13, 5, 1, False)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- 8: mixing


def test_mix_meets_targets(spark, sf):
    rows = queries.op8_source_mix(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    own = texts(spark, sf)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(own[r.doc_id].encode().split()) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == len(own) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    largest = max(r.size for r in rows)
    assert all(r.source_size == sizes[r.source] for r in rows) and all(abs(taken[s] - target[s]) <= largest for s in sizes)
    again = {(r.doc_id, r.taken) for r in queries.op8_source_mix(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def shared(sizes, weights=(1, 2, 3), cap=3):
    """Targets by filling up source after source."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i % 3] for i in open_)
        full = {i for i in open_ if unit * weights[i % 3] > cap * sizes[i]}
        for i in full or open_:
            out[i] = float(cap * sizes[i]) if full else unit * weights[i % 3]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def test_mix_equals_brute_force(spark):
    """Ranks, targets and the chosen documents, recomputed one by one; a source has one huge row and one has only copies."""
    draw = np.random.default_rng(8)
    rows = [(i, "w " * int(draw.integers(0, 40)), ["b", "a", "é", "z", None, "𝒳"][min(5, int(draw.exponential(1.2)))]) for i in range(400)]
    rows += [(900, "big " * 3000, "solo")] + [(800, "same text again", "twins")] * 9 + [(1000 + i, "", "void") for i in range(3)]
    rows += [(2000 + i, "one two", f"s{i:03}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit("clash"))
    got = mixing.mix(df).collect()
    hashed = df.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("x"), mixing._hash("doc_id", "text").alias("hash")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, shared([sizes[s] for s in names]), strict=True))
    size_of = {(i, t): len(t.split()) for i, t, _ in rows}
    by_source = {}
    for (i, t, s), h in zip(rows, hashed, strict=True):
        assert i == h.doc_id
        by_source.setdefault(s, Counter())[h.hash] += size_of[i, t]
    want = Counter()
    for (i, t, s), h in zip(rows, hashed, strict=True):
        n = sizes[s]
        copies = min(3, int(target[s] // n)) if n else 0
        left = target[s] - copies * n if copies < 3 else 0.0
        chosen = False
        for value, words in sorted(by_source[s].items()):
            if left <= 0:
                break
            take = words <= left or words - left < left
            if value == h.hash:
                chosen = take
            if words > left:
                break
            left -= words
        want[i, s, size_of[i, t], (copies + chosen) * size_of[i, t]] += 1
    of = {i: s for i, _, s in rows}
    assert Counter((r.doc_id, of[r.doc_id], r.size, r.taken) for r in got) == want
    assert all(r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]]) for r in got)


def test_mix_odd_rows(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and {r.size for r in out if r.doc_id in (3, 4)} == {0}
    copied = mixing.apply(docs)
    words = lambda df: df.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).head()[0]
    assert copied.columns == docs.columns and words(copied) == sum(r.taken for r in out)
    assert mixing.mix(empty(docs)).count() == 0


# -- 9: token counts


def test_token_counts_equal_library(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = texts(spark, sf)
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, sf).collect()}
    for i, t in own.items():
        n = len(model.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list(" \n\tab.é▁🙂<s> \r\x00")), max_size=20), max_size=6))
def test_piece_counter_is_exact(texts_):
    count = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert count.by_word
    assert count(pa.array(texts_, pa.string())).tolist() == [len(count.model.encode(t or "")) for t in texts_]


def test_cache_encodes_only_misses(spark, docs, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = token_counts.TokenCountCache(spark, f"file://{tmp_path}/counts")
    first = cache.fill(docs, path).count()
    assert first == 8 and cache.fill(docs, path).count() == 8 and spark.read.parquet(cache.path).count() == 8
    more = docs.union(spark.createDataFrame([(99, "brand new", None, None, None)], docs.schema))
    assert cache.fill(more, path).count() == 9
    out = token_counts.count_tokens(more, path, cache.path, limit=3).collect()
    assert len(out) == more.count() and spark.read.parquet(cache.path).count() == 9
    assert cache.fill(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 8 and spark.read.parquet(cache.path).count() == 17
    assert token_counts.count_tokens(empty(docs), path).count() == 0


# -- 10: Jaccard join


def jaccard_reference(own, threshold=0.8):
    sets = {}
    for i, t in own.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, label = Counter(), {i: i for i in own}
    ids = [i for i in own if sets[i]]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    for _ in own:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, label


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(spark, sf, monkeypatch, small):
    own = texts(spark, sf)
    if small:  # splits, dense buckets and blocks on few rows
        monkeypatch.setattr(jaccard, "LIMIT", 6)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        base = "one two three four five six seven eight nine ten eleven twelve " * 4
        passage = " ".join(f"p{i}" for i in range(20))
        own = {i: f"{base} tail{i}" for i in range(40)} | {100 + i: passage + " " + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)} | {200: base, 201: base}
    links, label = jaccard_reference(own)
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    assert {i: (r.n_links, r.class_id) for i, r in got.items()} == {i: (links[i], label[i]) for i in own}
    kept = {r.doc_id for r in jaccard.keep_first(df).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_join_odd_rows(spark, docs):
    out = sorted(((r.doc_id or 0, r.n_links, r.class_id, r.kept) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert [r for r in out if r[0] in (1, 2)] == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert all(r[1] == 0 and r[3] for r in out if r[0] not in (1, 2))
    kept = jaccard.keep_first(docs.union(docs.where("doc_id = 7")))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {i: 1 for i in (1, 3, 4, None, 5, 6, 7, 8)}
    assert jaccard.near_duplicates(empty(docs)).count() == 0 and jaccard.keep_first(empty(docs)).count() == 0


@given(st.lists(st.frozensets(st.integers(0, 30), max_size=12), min_size=1, max_size=25))
def test_intersections(sets):
    pairs = [(i, t) for i, s in enumerate(sets) for t in s]
    got = jaccard.intersections(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], np.uint64), len(sets))
    assert all(got[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(groups.values(), key=min) == [set(range(1, 61)), set(range(100, 140))]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- the pipeline


def test_pipeline_runs_and_keeps_clean_documents(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "jaccard_dedup", "source_mix", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = scratch.save(p.language_stage(spark, docs, sf), "t")
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    out = p.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).head()[0] <= 2048
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bad = [labels[r.doc_id] for r in out.select("doc_id").distinct().collect() if r.doc_id in labels]
    assert sum(bad) / len(bad) > sum(labels.values()) / len(labels)
