import random

import numpy as np
import pytest
from brute import partial, ratio

from assetloom.functions import similarity as S


def texts(rnd, n, longest, letters):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def grid(a, b):
    return [x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)))]


@pytest.mark.parametrize("longest", [5, 20, 64, 65, 140, 300, 700])
def test_ratio_and_bound(longest):
    rnd = random.Random(longest)
    a, b = texts(rnd, 9, longest, "abcé 1"), texts(rnd, 8, longest, "abcd 2😀")
    ai, bi = grid(a, b)
    ta, tb = S.Texts(a), S.Texts(b)
    got = S.ratio_pairs(ta, tb, ai, bi)
    assert got == pytest.approx([ratio(a[i], b[j]) for i, j in zip(ai, bi)])
    overlap = S.overlap_matrix(ta.class_counts(), tb.class_counts())[ai, bi]
    assert (S.score_bound("ratio", overlap, ta.lengths[ai], tb.lengths[bi], tb.lengths[bi]) >= got).all()


@pytest.mark.parametrize("longest", [4, 12, 30, 80])
def test_partial_and_bound(longest):
    rnd = random.Random(longest)
    a, b = texts(rnd, 8, longest, "abé 1"), texts(rnd, 8, longest, "abc 2")
    a.append(b[0][1:])
    ai, bi = grid(a, b)
    ta, tb = S.Texts(a), S.Texts(b)
    got = S.partial_pairs(ta, tb, ai, bi)
    assert got == pytest.approx([partial(a[i], b[j]) for i, j in zip(ai, bi)])
    overlap = S.overlap_matrix(ta.class_counts(), tb.class_counts())[ai, bi]
    assert (S.score_bound("partial", overlap, ta.lengths[ai], tb.lengths[bi], tb.lengths[bi]) >= got - 1e-9).all()


def test_column_functions(spark):
    rows = [("abc", "adc"), ("", ""), (None, "x"), ("a\0b", "a\0c"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.ratio(df.a, df.b), S.partial_ratio(df.a, df.b)).collect()
    assert [r[0] if r[0] is None else round(r[0], 2) for r in got] == [66.67, 100.0, None, 66.67, 100.0]
    assert got[2][1] is None and got[4][1] == 100.0


@pytest.mark.parametrize("cells", [1, 40, 1 << 17])
def test_lcs_with_all_beginnings(cells, monkeypatch):
    monkeypatch.setattr(S, "MATRIX_CELLS", cells)
    rnd = random.Random(cells)
    for longest in (5, 32, 64):
        a, b = texts(rnd, 12, 80, "abé 1x"), texts(rnd, 9, longest, "abc 1😀")
        a += [a[0] + "b", a[0], ""]
        ids = np.array(rnd.choices(range(len(a)), k=20))
        bits = S.WordTexts(S.Texts(b)).lcs_bits(S.Texts(a), ids)
        for row, i in enumerate(ids):
            for col, text in enumerate(b):
                for j in range(len(text) + 1):
                    lcs = round(ratio(a[i], text[:j]) * (len(a[i]) + j) / 200) if a[i] or j else 0
                    assert (int(bits[row, col]) & ((1 << j) - 1)).bit_count() == lcs


@pytest.mark.parametrize("longest", [4, 12, 30, 64, 90])
def test_windows_by_words(longest):
    rnd = random.Random(longest)
    a, b = texts(rnd, 14, longest, "abé 1"), texts(rnd, 12, longest, "abc 2")
    a.append(b[0][1:])
    ai, bi = grid(a, b)
    windows = S.Windows(S.Texts(b))
    windows.ask(S.Texts(a), np.arange(len(a)))
    want = np.array([partial(a[i], b[j]) for i, j in zip(ai, bi)])
    assert windows.scores(ai, bi, np.zeros(len(ai))) == pytest.approx(want)
    assert (windows.bound(ai, bi) >= want - 1e-9).all()
    bar = np.array([rnd.choice([0.0, 50.0, 80.0, 100.0]) for _ in a])
    reaching = set(zip(*(x.tolist() for x in windows.reaching(bar))))
    assert all((i, j) in reaching for i, j, score in zip(ai.tolist(), bi.tolist(), want) if score > bar[i] + 1e-9)
    high = want >= bar[ai] - 1e-9
    assert windows.scores(ai, bi, bar[ai])[high] == pytest.approx(want[high])
