import random

import numpy as np
import pytest
from edges import ROWS, same, table

from assetloom.llm import language

SOUNDS = {"aa": "the and of ing er tion th", "bb": "der die und sch ich ein keit", "cc": "que les eau oi ment é è"}


def text(lang, words, pick):
    parts = SOUNDS[lang].split()
    return " ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    pick = random.Random(1)
    rows = [(i, text(lang, 120, pick), lang) for i, lang in enumerate(list(SOUNDS) * 30)] + [(900, None, "aa"), (901, "x", None), (None, "y", "bb")]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id IS NOT NULL"))


def test_single_and_mixed_texts(spark, model):
    pick = random.Random(2)
    rows = [(i, text(lang, 40, pick), lang) for i, lang in enumerate(list(SOUNDS) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows)
    half = text("aa", 150, pick) + " " + text("bb", 80, pick)
    shares = language.identify(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first().shares
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 0.65) < 0.12 and abs(sum(shares.values()) - 1) < 1e-6


def test_mixture_is_the_most_likely_one():
    chance = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]])
    n = np.array([60.0, 20.0, 60.0])
    weight = language.mixtures(np.hstack([chance, chance]), np.concatenate([n, [100.0, 20, 5]]), np.array([0, 3, 6]))
    likelihood = lambda w: (n * np.log(w * chance[0] + (1 - w) * chance[1])).sum()
    grid = np.linspace(0.001, 0.999, 999)
    assert abs(weight[0, 0] - grid[np.argmax([likelihood(w) for w in grid])]) < 5e-3
    assert weight[1].tolist() == [1, 0]


def test_trigrams_of_a_long_text(monkeypatch):
    whole = "Ab, cd  Ef!" * 50
    found, n = language.trigrams(whole)
    for piece in (7, 10, 64):
        monkeypatch.setattr(language, "_PIECE", piece)
        again, m = language.trigrams(whole)
        assert found.tolist() == again.tolist() and n.tolist() == m.tolist()
    assert len(language.trigrams("12 -")[0]) == 0 and len(language.trigrams("a")[0]) == 1


def test_edges(spark, model):
    got = language.identify(table(spark), model).collect()
    assert same([(r.doc_id,) for r in got], [(r[0],) for r in ROWS])
    for r in got:
        letters = {x[0]: any(c.isalpha() for c in x[1] or "") for x in ROWS}
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not letters[r.doc_id]) and 0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und")
    kept = language.keep_identified(table(spark), model, 0.0)
    assert kept.schema == table(spark).schema and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in ROWS)
    assert language.identify(table(spark).limit(0), model).count() == 0
    empty = language.train(table(spark).limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(table(spark), empty).collect()} == {("und", 0.0)}
