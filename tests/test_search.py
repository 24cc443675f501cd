import random

import pandas as pd
import pytest
from brute import partial, ratio

from assetloom.operators import matching, ranking, search
from assetloom.operators.columns import asset_keys, purchase_keys
from assetloom.operators.search import Rule, nearest

WORDS = ["red", "blue", "small", "hot", "widget", "bolt", "ring", "econ", "large brass"]


@pytest.fixture(autouse=True)
def many_small_groups(monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", (17, 16_384))
    monkeypatch.setattr(search, "CHUNK_ROWS", (29, 8_192))
    monkeypatch.setattr(search, "FEW_SHARDS", 1)
    monkeypatch.setattr(search, "ROUND_ENDS", (1, 3))


def sentences(rnd, n):
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize(("scorer", "floor", "inclusive", "k"), [("ratio", 50, False, 1), ("ratio", 80, False, 5), ("partial", 80, True, 1)])
def test_matches_brute_force(spark, scorer, floor, inclusive, k):
    rnd = random.Random(k)
    a, b = sentences(rnd, 60), sentences(rnd, 70)
    queries = spark.createDataFrame(list(enumerate(a)), "qid long, qtext string")
    targets = spark.createDataFrame([(i + 1000, i, t) for i, t in enumerate(b)], "tid long, tpos long, ttext string")
    got = {}
    for r in nearest(queries, targets, Rule(floor, inclusive, scorer), k).collect():
        got.setdefault(r.qid, []).append((round(-r.score, 6), r.tpos))
    score = ratio if scorer == "ratio" else partial
    for i, x in enumerate(a):
        want = sorted((round(-score(x, y), 6), j) for j, y in enumerate(b))
        want = [w for w in want if (-w[0] >= floor if inclusive else -w[0] > floor)][:k]
        assert sorted(got.get(i, [])) == want


def test_no_targets_and_no_queries(spark):
    empty_q = spark.createDataFrame([], "qid long, qtext string")
    empty_t = spark.createDataFrame([], "tid long, tpos long, ttext string")
    some = spark.createDataFrame([(1, "x")], "qid long, qtext string")
    assert nearest(some, empty_t, Rule(50)).count() == 0
    assert nearest(empty_q, empty_t, Rule(50)).count() == 0


@pytest.mark.parametrize("plain_rows", [1_000_000, 0])
def test_running_before_by_cells(spark, monkeypatch, plain_rows):
    """The plain window and the cell path agree, also when one group holds most rows."""
    monkeypatch.setattr(ranking, "PLAIN_WINDOW_ROWS", plain_rows)
    monkeypatch.setattr(ranking, "cell_width", lambda n: 5)
    rnd = random.Random(1)
    rows = [(rnd.choice("aaab"), rnd.choice([-2.0, -1.0]), i, rnd.randint(1, 4)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "g string, lvl double, pos long, n long")
    from pyspark.sql import functions as F

    ran = ranking.running_before(df, ["g"], "pos", F.col("n"), "before", 200, levels=["lvl"])
    got = {r.pos: (r.before, r.total) for r in ranking.over_group(ran, ["g"], F.sum("n"), "total", 200).collect()}
    for g in "ab":
        seen = 0
        members = sorted((r[1], r[2], r[3]) for r in rows if r[0] == g)
        for _, pos, n in members:
            assert got[pos] == (seen, sum(m[2] for m in members))
            seen += n


def test_dense_ids_with_equal_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ranking, "COPIES_PER_BLOCK", 7)
    rows = [("x", 1)] * 60 + [("y", i % 5) for i in range(40)] + [(None, 3)]
    df = spark.createDataFrame(rows, "name string, n int")
    out = ranking.dense_ids(df, [F.col("name").asc_nulls_last()], "id").orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, 102))
    assert [(r.name, r.n) for r in out] == sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))


def test_hot_key_and_pages_without_end(spark):
    """Two thousand lines of one vendor, product and date: ranks go by purchase, page after page."""
    lines = spark.range(1, 2001).selectExpr(
        "id AS purchase_id", "'ring' AS item", "'acme' AS vendor", "'' AS description", "CAST(1 AS DOUBLE) AS count", "TIMESTAMP '2024-01-01' AS date")
    assets = spark.createDataFrame([(1,), (1,), (2,)], "asset_id long").selectExpr(
        "asset_id", "'ring' AS product_name", "'acme' AS vendor_name", "'' AS description", "TIMESTAMP '2024-01-03 10:00:00' AS created_at")
    purchases, assets = purchase_keys(lines), asset_keys(assets)
    first = matching.rank_candidates(assets, purchases, 5)
    assert sorted((r.asset_id, r.rank, r.purchase_id) for r in first.collect()) == sorted((a, n, n) for a in (1, 1, 2) for n in range(1, 6))
    late = matching.rank_candidates(assets.where("asset_id = 2"), purchases, 100, page=15).collect()
    assert sorted((r.rank, r.purchase_id) for r in late) == [(n, n) for n in range(1501, 1601)]
    more = matching.rank_candidates(assets, purchases, 4, after=first).collect()
    assert sorted({(r.asset_id, r.rank, r.purchase_id) for r in more}) == [(a, n, n) for a in (1, 2) for n in range(6, 10)]


def test_few_windows_are_scored(monkeypatch):
    """Bounds leave few pairs of like names to the best-window score, and the hits stay those of brute force."""
    scored = []
    plain = search.SCORERS["partial"]
    monkeypatch.setitem(search.SCORERS, "partial", lambda a, b, ai, bi: scored.append(len(ai)) or plain(a, b, ai, bi))
    rnd = random.Random(2)
    q = pd.DataFrame({"qid": range(40), "qtext": [f"member#{rnd.randrange(900_000):09d}" for _ in range(40)], "want": 1})
    t = pd.DataFrame({"tid": range(400), "tpos": range(400), "ttext": [f"member member#{7 * i:09d} {i % 25}" for i in range(400)]})
    q = q.assign(**search.QUERY_DEFAULTS, least=-1.0, least_gap=search.NEVER, least_pos=search.NEVER)
    hits = search.score_group(q, t.assign(**search.TARGET_DEFAULTS), Rule(80, True, "partial"))
    got = {r.qid: (round(-r.score, 6), r.tpos) for r in hits.itertuples()}
    for i, x in enumerate(q["qtext"]):
        best = min((round(-partial(x, y), 6), j) for j, y in enumerate(t["ttext"]))
        assert got.get(i) == (best if best[0] <= -80 else None)
    assert sum(scored) < 40 * 400 / 4


@pytest.mark.parametrize("window_rows", [1, 1_024])
def test_best_windows_over_shards(spark, monkeypatch, window_rows):
    """Names with many ties, long names and names longer than all targets: the first target of the best score is found."""
    monkeypatch.setattr(search, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(search, "NEIGHBOURS", 3)
    monkeypatch.setattr(search, "BOUND_CELLS", 100)
    rnd = random.Random(window_rows)
    a = [f"person {rnd.randrange(400):05d}" for _ in range(50)] + sentences(rnd, 10) + ["x" * 90, "person 00001 " * 7, "p"]
    b = [f"a person {rnd.randrange(90):05d} {i % 7}" for i in range(60)] + ["person 00001", "p 1"] + sentences(rnd, 8) + ["large brass " * 8]
    queries = spark.createDataFrame(list(enumerate(a)), "qid long, qtext string")
    targets = spark.createDataFrame([(i + 1000, i, t) for i, t in enumerate(b)], "tid long, tpos long, ttext string")
    got = {r.qid: (round(r.score, 6), r.tpos, r.tid) for r in nearest(queries, targets, Rule(80.0, inclusive=True, scorer="partial")).collect()}
    for i, x in enumerate(a):
        score, minus = max((round(partial(x, y), 6), -j) for j, y in enumerate(b))
        assert got.get(i) == ((score, -minus, 1000 - minus) if score >= 80 else None)


def test_few_windows_are_scored(monkeypatch):
    """Numbered names against numbered staff: nearly all pairs are settled without trying their windows."""
    from assetloom.functions import similarity

    steps, slices = [], similarity.lcs_slices

    def counted(a, ai, codes, starts, lengths, running=False):
        steps.append(int(lengths.sum()))
        return slices(a, ai, codes, starts, lengths, running)

    monkeypatch.setattr(similarity, "lcs_slices", counted)
    monkeypatch.setattr(search, "lcs_slices", counted, raising=False)
    names = [f"supplier#{i * 37:09d}" for i in range(300)]
    staff = [f"supplier supplier#{i:09d} {i % 25}" for i in range(400)]
    inert = {**search.QUERY_DEFAULTS, "want": 1, "least": -1.0, "least_gap": search.NEVER, "least_pos": search.NEVER}
    q = pd.DataFrame({"qid": range(len(names)), "qtext": names}).assign(**{k: v for k, v in inert.items()})
    t = pd.DataFrame({"tid": range(len(staff)), "tpos": range(len(staff)), "ttext": staff}).assign(**search.TARGET_DEFAULTS)
    found = search.score_group(q, t, Rule(80.0, inclusive=True, scorer="partial")).set_index("qid")
    for i in range(0, len(names), 23):
        score, minus = max((round(partial(names[i], y), 6), -j) for j, y in enumerate(staff))
        assert (round(found.score[i], 6), found.tpos[i]) == (score, -minus)
    assert sum(steps) < 10 * len(names) * len(staff)
