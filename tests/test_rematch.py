"""Matching again after changes equals matching all anew."""

import random

import pytest
from brute import assign_loop
from test_assign import frames, instance

from assetloom.operators import assign, rematch


def changed(seed, assets, purchases):
    rnd = random.Random(seed)
    assets, purchases = [a for a in assets if seed % 3 or rnd.random() > 0.05], list(purchases)
    for _ in range(2):
        k = rnd.randrange(len(purchases))
        what = rnd.choice(["more", "less", "gone", "text"])
        p = purchases[k]
        if what == "gone":
            purchases.pop(k)
        elif what == "text":
            purchases[k] = (p[0], "red ring", *p[2:])
        else:
            purchases[k] = (*p[:4], max(0.0, (p[4] or 0.0) + (2.0 if what == "more" else -1.0)))
    purchases.append((100 + seed, rnd.choice(["blue ring", "zzz"]), "acme", "eco", 2.0))
    return assets + [(90 + seed, "red ring", "acme", "eco")], purchases


@pytest.mark.parametrize("seed", [1, 3])
def test_same_as_matching_anew(spark, seed):
    assets, purchases = instance(seed, hot=seed > 1)
    a, p = frames(spark, assets, purchases)
    stored = spark.createDataFrame(assign.auto_match(a, p).collect(), "asset_id long, purchase_id long, kind string, fuzzy_score double")
    new_assets, new_purchases = changed(seed, assets, purchases)
    a2, p2 = frames(spark, new_assets, new_purchases)
    got = rematch.rematch(a2, p2, a, p, stored).collect()
    assert {r.asset_id: (r.purchase_id, r.kind) for r in got} == assign_loop(new_assets, new_purchases) and len(got) == len({r.asset_id for r in got})


def test_only_affected_assets_are_matched_again(spark, monkeypatch):
    assets, purchases = instance(2, hot=True)
    a, p = frames(spark, assets, purchases)
    stored = spark.createDataFrame(assign.auto_match(a, p).collect(), "asset_id long, purchase_id long, kind string, fuzzy_score double")
    asked = []
    real = assign.auto_match
    monkeypatch.setattr(rematch, "auto_match", lambda some, *rest: asked.append(some.count()) or real(some, *rest))
    same = rematch.rematch(a, p, a, p, stored).collect()
    assert asked == [] and sorted(map(tuple, same), key=str) == sorted(map(tuple, stored.collect()), key=str)
    more = [*assets, (50, "red ring", "acme", ""), (51, "old bolt", "dell", "eco")]
    a2, p2 = frames(spark, more, purchases)
    got = {r.asset_id: (r.purchase_id, r.kind) for r in rematch.rematch(a2, p2, a, p, stored).collect()}
    assert asked == [2] and got == assign_loop(more, purchases)
