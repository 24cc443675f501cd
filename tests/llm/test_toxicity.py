import itertools
import random

import numpy as np
from edges import ROWS, same, table

from assetloom.llm import toxicity


def test_marginals_against_all_labellings():
    chance = np.random.default_rng(1)
    chain = toxicity.Chain(chance.normal(size=2), chance.normal(size=(2, 2)), chance.normal(size=(len(toxicity.LEVELS) + 1, 2)))
    sizes = [1, 5, 3, 6]
    level = chance.integers(0, len(toxicity.LEVELS) + 1, sum(sizes))
    begins = np.cumsum([0, *sizes[:-1]])
    toxic, pairs = chain.marginals(level, begins)
    expected, steps = np.zeros(len(level)), np.zeros((2, 2))
    for b, n in zip(begins, sizes):
        total, own, own_steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            value = chain.first[y[0]] + sum(chain.emit[level[b + t], y[t]] for t in range(n)) + sum(chain.step[y[t - 1], y[t]] for t in range(1, n))
            weight = np.exp(value)
            total += weight
            own += weight * np.array(y)
            for t in range(1, n):
                own_steps[y[t - 1], y[t]] += weight
        expected[b : b + n] = own / total
        steps += own_steps / total
    assert np.allclose(toxic, expected) and np.allclose(pairs, steps)


def corpus(n, seed):
    pick = random.Random(seed)
    clean = [f"{a}{b}" for a in "the an of in er st".split() for b in "al or em ut ing ea".split()]
    rows = []
    for i in range(n):
        words = [pick.choice(clean) for _ in range(pick.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(pick.randint(1, 4)):
                words[pick.randrange(len(words))] = pick.choice(["Vilest", "grubby!", "zorkan" + pick.choice(clean)])
        rows.append((i, "é " + " ".join(words), int(toxic)))
    return rows


def test_held_out_documents_and_spans(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").where("doc_id < 600")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    right = [(got[i].score >= 0.5) == bool(toxic) for i, _, toxic in rows[600:]]
    assert np.mean(right) > 0.97
    for i, t, toxic in rows[600:]:
        for s in got[i].spans:
            marked = t[s.start : s.end].split()
            assert toxic and all(w.strip("!").lower() in ("vilest", "grubby") or w.startswith("zorkan") for w in marked)
    assert toxicity.keep_clean(docs, model, 0.5).count() == sum(r.score < 0.5 for r in got.values())


def test_edges(spark):
    rows = corpus(200, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.selectExpr("doc_id", "if(doc_id = 3, NULL, toxic) AS toxic").union(spark.createDataFrame([(None, 1), (10_000, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    got = toxicity.score_documents(table(spark), model).collect()
    assert same([(r.doc_id,) for r in got], [(r[0],) for r in ROWS]) and all(0 <= r.score < 0.5 and r.spans == [] for r in got)
    kept = toxicity.keep_clean(table(spark), model, 0.5)
    assert kept.schema == table(spark).schema and kept.count() == len(ROWS)
    assert toxicity.score_documents(table(spark).limit(0), model).count() == 0
    for only in (0, 1):
        one = toxicity.train(docs.select("doc_id", "text"), labels.where(f"toxic = {only}"))
        assert {r.score > 0.5 for r in toxicity.score_documents(table(spark), one).collect()} == {bool(only)}
    assert {r.score > 0.5 for r in toxicity.score_documents(table(spark), toxicity.train(docs.select("doc_id", "text"), labels.limit(0))).collect()} == {False}


def test_rare_toxic_word_in_many_labels(spark):
    pick = random.Random(3)
    words = [f"{a}{b}" for a in "the an of in er st".split() for b in "al or em ut ing ea".split()]
    rows = []
    for i in range(6_000):
        rare = " vilest" if i % 2 and i < 20 else ""  # 10 of 3,000 toxic documents
        rows.append((i, " ".join(pick.choice(words) for _ in range(12)) + (" grubby" if i % 2 and not rare else "") + rare, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    own = toxicity.tokenise(np.frombuffer(b"vilest", np.uint8), np.array([0, 6]))
    assert model.weights(own).max() > 0
