import random

import pytest
from brute import assign_loop
from pyspark.sql import functions as F

from assetloom.operators import assign, matching, ranking, search
from assetloom.operators.columns import asset_keys, purchase_keys


def frames(spark, assets, purchases):
    a = spark.createDataFrame(assets, "asset_id long, product_name string, vendor_name string, description string")
    p = spark.createDataFrame(purchases, "purchase_id long, item string, vendor string, description string, count double")
    return asset_keys(a), purchase_keys(p)


def instance(seed, hot):
    rnd = random.Random(seed)
    items, vendors, texts = ["red ring", "blue ring", "hot widget", "old bolt", "zzz"], ["acme", "dell", ""], ["eco", "large thing", ""]
    assets = [(i + 1, rnd.choice(items), rnd.choice(vendors), rnd.choice(texts)) for i in range(30)]
    if hot:
        assets = [(a[0], items[0], vendors[0], a[3]) if rnd.random() < 0.7 else a for a in assets]
    stock = [0.0, 1.0, 1.0, 2.0, 2.5, None, -1.0, 7.0]
    purchases = [(i + 1, rnd.choice(items), rnd.choice(vendors), rnd.choice(texts), rnd.choice(stock)) for i in range(18)]
    return assets, purchases


@pytest.mark.parametrize(("seed", "hot", "plain_rows"), [(1, False, 1_000_000), (2, True, 1_000_000), (3, True, 0)])
def test_same_as_the_loop(spark, monkeypatch, seed, hot, plain_rows):
    """Small slices and pages, a hot key, and the path for groups too large for one window."""
    monkeypatch.setattr(assign, "SLICE", 3)
    monkeypatch.setattr(assign, "FIRST_PAGE", 2)
    monkeypatch.setattr(ranking, "PLAIN_WINDOW_ROWS", plain_rows)
    assets, purchases = instance(seed, hot)
    a, p = frames(spark, assets, purchases)
    got = {r.asset_id: (r.purchase_id, r.kind) for r in assign.auto_match(a, p).collect()}
    assert got == assign_loop(assets, purchases)


def test_earlier_fuzzy_choice_takes_a_later_exact_match(spark):
    assets = [(1, "red ring x", "acme", ""), (2, "red ring", "acme", ""), (3, "nothing", "like it", "qqqqqq")]
    purchases = [(1, "red ring", "acme", "", 1.0), (2, "red rings", "acme", "", 1.0)]
    a, p = frames(spark, assets, purchases)
    found = assign.auto_match(a, p)
    got = {r.asset_id: (r.purchase_id, r.kind) for r in found.collect()}
    assert got == assign_loop(assets, purchases)
    summary = assign.match_summary(a, p, found).first().asDict()
    assert (summary["total_assets"], summary["total_purchase_items"], summary["unmatched"]) == (3, 2, 3 - len(got))
    exact_only = assign.auto_match(a, p, fuzzy=False).collect()
    assert [(r.asset_id, r.purchase_id) for r in exact_only] == [(2, 1)]


def test_ranked_candidates_pages_and_hot_key(spark, monkeypatch):
    """Pages continue one list; the exact tier of a hot key comes from neighbouring date shards."""
    from datetime import datetime, timedelta

    from brute import ratio

    monkeypatch.setattr(search, "SHARD_ROWS", (9, 16_384))
    rnd = random.Random(5)
    base = datetime(2024, 1, 1)

    def row(i):
        hot = rnd.random() < 0.6
        return (i, "red ring" if hot else rnd.choice(["blue bolt", "old ring"]), "acme" if hot else "dell", rnd.choice(["eco", "std"]),
                base + timedelta(hours=rnd.randint(0, 900)))

    assets, lines = [row(i) for i in range(25)], [(*row(i), float(rnd.choice([0, 1, 2]))) for i in range(80)]
    a = asset_keys(spark.createDataFrame(assets, "asset_id long, product_name string, vendor_name string, description string, created_at timestamp"))
    p = purchase_keys(spark.createDataFrame(lines, "purchase_id long, item string, vendor string, description string, date timestamp, count double"))
    got = {}
    for page in (0, 1):
        for r in matching.rank_candidates(a, p, 4, page).collect():
            got.setdefault(r.asset_id, {})[r["rank"]] = (r.kind, r.fuzzy_score, r.date_discrepancy, r.purchase_id)
    for asset in assets:
        want = []
        for line in lines:
            if line[5] <= 0 or line[4] > asset[4]:
                continue
            gap = (asset[4] - line[4]).days
            score = round(ratio(" ".join(line[1:4]), " ".join(asset[1:4])), 2)
            if line[1:3] == asset[1:3]:
                want.append((0, 0, gap, line[0]))
            elif score > 45:
                want.append((1, -score, gap, line[0]))
        want = [("fuzzy" if t else "exact", -s if t else None, g, i) for t, s, g, i in sorted(want)[:8]]
        assert [v for _, v in sorted(got.get(asset[0], {}).items())] == want


def test_work_queue(spark):
    from datetime import datetime

    a = asset_keys(spark.createDataFrame(
        [(1, "a", "v", "", datetime(2024, 1, 1)), (2, "b", "v", "", datetime(2024, 1, 1)), (3, None, None, None, datetime(2024, 1, 1))],
        "asset_id long, product_name string, vendor_name string, description string, created_at timestamp"))
    p = purchase_keys(spark.createDataFrame(
        [(1, "b", "V", "", datetime(2023, 1, 1), 1.0), (2, "a", "v", "", datetime(2025, 1, 1), 1.0), (3, "", "", "", datetime(2023, 1, 1), 1.0)],
        "purchase_id long, item string, vendor string, description string, date timestamp, count double"))
    rows = matching.work_queue(a, p).orderBy("place").collect()
    assert [(r.asset_id, r.has_exact, r.previous_asset, r.next_asset) for r in rows] == [
        (2, True, None, 3), (3, True, 2, 1), (1, False, 3, None)]


def test_repeated_asset_ids(spark):
    assets = [(1, "red ring", "acme", ""), (1, "red ring", "acme", ""), (2, "red ring", "acme", "")]
    a, p = frames(spark, assets, [(7, "red ring", "acme", "", 2.0), (8, "red ring", "acme", "", 1.0)])
    a = ranking.dense_ids(a, [F.col("asset_id")], "row")
    matches = assign.auto_match(a, p, asset_order=("row",), row="row")
    got = assign.with_assignments(a, matches, "row").select("asset_id", "row", "purchase_assignment").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 7), (1, 2, 7), (2, 3, 8)]
    half = [(1, "x", "y", "", 2.5), (2, "x", "y", "", 2.5)]
    assert assign.match_summary(a, frames(spark, assets, half)[1], matches).first().total_purchase_items == 5


def test_only_contested_purchases_are_ranked(spark, monkeypatch):
    """Once placed, assets whose purchases nobody newly asks for are left out of the later rounds."""
    ranked, plain = [], assign.running_before
    monkeypatch.setattr(
        assign, "running_before", lambda df, *a, **k: (a[3] == "_ahead" and ranked.append(df.count()), plain(df, *a, **k))[1]
    )
    assets = [(1, "red ring x", "acme", ""), (2, "red ring", "acme", "")] + [(i, f"{i * 7919}", f"{i}", "") for i in range(3, 33)]
    purchases = [(1, "red ring", "acme", "", 1.0), (2, "red rings", "acme", "", 1.0)] + [(i, f"{i * 7919}", f"{i}", "", 1.0) for i in range(3, 33)]
    a, p = frames(spark, assets, purchases)
    got = {r.asset_id: (r.purchase_id, r.kind) for r in assign.auto_match(a, p).collect()}
    assert got == assign_loop(assets, purchases)
    assert len(ranked) > 1 and max(ranked[1:]) <= 4
