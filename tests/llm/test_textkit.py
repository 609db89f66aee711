import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tidelake.llm import textkit


@given(st.lists(st.none() | st.text(alphabet=" \t\nabcABé🙂.", max_size=30), max_size=8), st.integers(0, 3))
def test_words_equal_python(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    hashes, firsts = textkit.words(column, textkit.SPACE_WORD)
    want = [(t or "").encode().lower().split() for t in column.to_pylist()]
    assert np.diff(firsts).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_hash_does_not_depend_on_place():
    long = "q" * (textkit.BLOCK + 10)
    column = pa.array([f"a {long} b", f"{long} a", "b a"])
    h, f = textkit.words(column, textkit.SPACE_WORD)
    assert h[0] == h[4] == h[6] and h[1] == h[3] and h[2] == h[5] and f.tolist() == [0, 3, 5, 7]


def test_slices_cover_all():
    column = pa.array(["x" * n for n in (5, 0, 20, 3, 3)])
    cuts = list(textkit.slices(column, 8))
    assert cuts == [(0, 2), (2, 3), (3, 5)] and list(textkit.slices(column.slice(0, 0))) == []


@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), max_size=60))
def test_forest(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    a, b = (np.array([e[i] for e in edges], int) for i in (0, 1))
    assert textkit.forest(n, a, b).tolist() == label


def test_groups_cross_batches():
    batches = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": range(6)}).to_batches(max_chunksize=2)
    assert [g.column(1).to_pylist() for g in textkit.groups(batches, 1)] == [[0, 1], [2, 3, 4], [5]]
