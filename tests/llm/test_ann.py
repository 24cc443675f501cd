import numpy as np

from assetloom.llm import ann


def brute(rows, size, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in own:
        if q % 20 == 0:
            score = sorted(((-float((own[q] * v).sum()), i) for i, v in own.items() if i != q))
            out[q] = [(i, -s) for s, i in score[:k]]
    return out


def recall(got, expected, k):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {q for q, near in expected.items() if near}
    hits = total = 0
    for q, near in expected.items():
        own = sorted(found.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(near) + 1)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in near})
        total += len(near)
    return hits / total


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 40)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 64)
    chance = np.random.default_rng(1)
    centre = chance.normal(size=(30, 16))
    vectors = (centre[chance.integers(0, 30, 2000)] + 0.6 * chance.normal(size=(2000, 16))) * chance.uniform(0.2, 2, (2000, 1))
    vectors[100:700] = vectors[100]  # one vector that many rows share
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, "vec_id % 20 = 0", 20).collect()
    expected = brute(rows, 16, 20)
    assert recall(got, expected, 20) > 0.9
    exact = {(q, i): s for q, near in expected.items() for i, s in near}
    assert all(abs(r.score - exact.get((r.query_id, r.vec_id), r.score)) < 1e-9 for r in got)
    same = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 200]
    assert same == [i for i, _ in expected[200]]  # ties go to the smaller ids


def test_far_lists_send_what_reaches_the_bar(spark, monkeypatch):
    scores = np.array([[5.0, 1.0, 4.0, 3.0], [5.0, 1.0, 4.0, 3.0], [1.0, 2.0, 3.0, 4.0]])
    asking, found = ann.reaching(scores, 3, np.array([-np.inf, 4.0, 9.0]))
    assert list(zip(asking.tolist(), found.tolist())) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 2)]

    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    chance = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(chance.normal(size=(600, 8)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = []
    for lists in (1, 1_000):
        monkeypatch.setattr(ann, "NEAR_LISTS", lists)
        found.append(sorted(tuple(r) for r in ann.nearest(frame, "vec_id % 20 = 0", 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 30 * 5


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (40, [-1.0, 0.0]), (9, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, list int, entry long")
    assert recall(ann.nearest(frame, "vec_id % 20 = 0", 3).collect(), brute(rows, 2, 3), 3) == 1
    assert recall(ann.nearest(frame, "vec_id % 20 = 0", 20).collect(), brute(rows, 2, 20), 20) == 1
    assert ann.nearest(frame.limit(0), "vec_id % 20 = 0").count() == 0
    assert ann.nearest(frame.where("vec_id = 0"), "vec_id % 20 = 0").count() == 0


def test_thousands_of_lists():
    chance = np.random.default_rng(2)
    centre = chance.normal(size=(10, 64))
    vectors = centre[chance.integers(0, 10, 30_000)] + 1.5 * chance.normal(size=(30_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    points = ann.lift(vectors, 1 + 1e-12)
    index = ann.build(points, 3_000)
    assert len(index.centroids) > 2_000
    gap = np.sqrt(np.maximum(0, ann._square(points[:2_000], index.centroids)))
    dealt = [own for at in range(0, len(points), 1024) for own in index.lists(points[at : at + 1024])]
    for own, far in zip(dealt, gap):
        near = [i for i in np.argsort(far) if far[i] <= ann.COPY_RATIO * far.min()][: ann.COPIES]
        assert set(own) == set(near)
    sizes = np.bincount(np.concatenate(dealt), minlength=len(index.centroids))
    queries, wide = np.arange(0, 2_000, 20), 0
    for q, own in zip(queries, index.probes(points[queries], sizes, 21)):
        within = set(np.flatnonzero(gap[q] <= ann.QUERY_RATIO * gap[q].min()))
        assert within <= set(own)
        wide += len(within) > 128
    assert wide
