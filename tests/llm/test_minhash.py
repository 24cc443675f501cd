import random

import numpy as np
import pytest
from edges import ROWS, same, table
from test_jaccard import brute, corpus

from assetloom.llm import minhash


def with_kept(rows):
    return [(*r, r[0] == r[2]) for r in rows]


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 90)])
def test_against_brute_force(spark, n, percent):
    rows = corpus(percent + n, 40, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in minhash.near_duplicates(docs, n, percent).collect()], with_kept(brute(rows, n, percent)))


@pytest.mark.parametrize(("stars", "likeliest"), [(0, 0), (1, 1)])
def test_large_group_in_small_blocks(spark, monkeypatch, stars, likeliest):
    """Copies of one text with so many changes that many pairs are not linked, by stars and by blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "LIKELIEST", likeliest)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.randint(0, 5)):
            words[pick.randrange(80)] = f"x{pick.randrange(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in minhash.near_duplicates(docs, 4, 80).collect()], with_kept(brute(rows, 4, 80)))


def test_edges(spark):
    rows = [r[:2] for r in ROWS]
    assert same([tuple(r) for r in minhash.near_duplicates(table(spark), 4, 80).collect()], with_kept(brute(rows, 4, 80)))
    assert minhash.near_duplicates(table(spark).limit(0)).count() == 0


def test_structured_words(spark):
    """Words whose letters alternate by a rule are as different as any others."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two {one} three"), (2, f"one two {other} three"), (3, f"one two {one} three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in minhash.near_duplicates(docs, 4, 80).collect()], with_kept(brute(rows, 4, 80)))


def test_bins_agree_as_often_as_sets():
    chance = np.random.default_rng(5)
    for size, common in ((5, 4), (40, 30), (300, 250), (4_000, 3_000)):
        agree = []
        for _ in range(60):
            both = chance.integers(0, 2**64, 2 * size - common, dtype=np.uint64)
            one, other = np.unique(both[:size]), np.unique(np.concatenate([both[:common], both[size:]]))
            values = minhash.bins([one, other])
            assert np.isin(values[0], one).all()
            agree.append((values[0] == values[1]).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.05


def test_linked_sets_share_a_band():
    chance = np.random.default_rng(6)
    assert minhash.miss(0.8) < 1e-8
    for size in [*range(1, 30), 100, 700]:
        common = -(-8 * size // 10)
        for _ in range(20):
            one = np.unique(chance.integers(0, 2**64, size, dtype=np.uint64))
            keys = minhash.band_keys([one, np.sort(chance.permutation(one)[:common])])
            assert np.intersect1d(keys[0], keys[1]).size
