import random
import re

import numpy as np
import pyarrow as pa
import pytest
from edges import ROWS, same, table

from assetloom.llm import jaccard


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [sets_of(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]):
                group[root(i)] = root(k)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return out


def corpus(seed, families, copies):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(families):
        base = [pick.choice(vocabulary) for _ in range(pick.choice((1, 2, 3, 4, 6, 9, 15, 40, 90)))]
        for _ in range(copies):
            words = list(base)
            for _ in range(pick.choice((0, 0, 1, 1, 2, 4))):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, n, percent):
    rows = corpus(percent, 40, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in jaccard.near_duplicates(docs, n, percent).collect()], brute(rows, n, percent))


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 5)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.randint(0, 4)):
            words[pick.randrange(80)] = f"x{pick.randrange(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in jaccard.near_duplicates(docs, 4, 85).collect()], brute(rows, 4, 85))


def test_edges(spark):
    rows = [r[:2] for r in ROWS]
    assert same([tuple(r) for r in jaccard.near_duplicates(table(spark), 4, 85).collect()], brute(rows, 4, 85))
    assert jaccard.near_duplicates(table(spark).limit(0)).count() == 0


def test_linked_sets_share_a_key():
    chance = np.random.default_rng(1)
    for percent in (50, 80, 85, 95):
        for size in [*range(1, 40), 100, 400, 3000]:
            one = np.unique(chance.integers(0, 2**64, size, dtype=np.uint64))
            for common in {len(one), -(-percent * len(one) // 100), -(-2 * percent * len(one) // (100 + percent))}:
                for extra in {0, max(0, (100 * common - percent * len(one)) // percent)}:
                    other = np.unique(np.concatenate([chance.permutation(one)[:common], chance.integers(0, 2**64, extra, dtype=np.uint64)]))
                    both = len(np.intersect1d(one, other))
                    if 100 * both >= percent * (len(one) + len(other) - both):
                        assert np.intersect1d(jaccard.sketch_keys(one, percent), jaccard.sketch_keys(other, percent)).size
                        bits = [np.frombuffer(jaccard.parity_bits(x), np.uint8) for x in (one, other)]
                        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, other))


def test_words_across_blocks():
    text = "x" * 2_100_000 + " foo BAR baz " + "y " * 700_000
    got = [len(s) for s in jaccard.shingle_sets(pa.array([text, None, "foo", "a b c d"]), 4)]
    assert got == [len(sets_of(t, 4)) for t in (text, None, "foo", "a b c d")]


def test_words_built_by_a_rule():
    """The Thue-Morse word and its complement, which agree under polynomial hashes, are different words."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    first, second, third = jaccard.shingle_sets(pa.array([f"one two {w} three" for w in (one, other, one.upper())]), 4)
    assert first.tolist() == third.tolist() != second.tolist()
