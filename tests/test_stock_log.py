"""The event log with refusals against a plain replay."""

import random
from datetime import datetime, timedelta

import pytest

from assetloom.operators import assignments, ranking


def replay(events, stock):
    """One event after the other: ``events`` are (event_id, asset_id, purchase_id, ts)."""
    left, held, out = {p: n or 0 for p, n in stock}, {}, {}
    for event_id, asset, purchase, _ in sorted(events, key=lambda e: (e[3], e[0])):
        if held.get(asset) != purchase or purchase is None:
            if held.get(asset) is not None:
                left[held[asset]] += 1
            held[asset] = None
            if purchase is not None and left.get(purchase, 0) > 0:
                left[purchase] -= 1
                held[asset] = purchase
        if purchase is not None:
            out[event_id] = held[asset] == purchase
    return out


def log(seed, hot, n=400):
    rnd = random.Random(seed)
    base, events, at = datetime(2024, 1, 1), [], 0
    for i in range(n):
        at += rnd.choice((0, 1, 5)) if rnd.random() < 0.9 else 200
        asset = rnd.choice([None, *range(1, 25)]) if rnd.random() < 0.7 else 3
        purchase = 1 if rnd.random() < hot else rnd.choice([None, 2, 3, 4, 5, 6, 99])
        events.append((i, asset, purchase, base + timedelta(seconds=at)))
    rnd.shuffle(events)
    return events, [(1, 3), (2, 1), (3, 2), (4, 0), (5, None), (6, -1), (7, 5)]


def frames(spark, events, stock):
    return (
        spark.createDataFrame(events, "event_id long, asset_id long, purchase_id long, ts timestamp"),
        spark.createDataFrame(stock, "purchase_id long, count long"),
    )


@pytest.mark.parametrize(
    ("seed", "hot", "rounds", "plain_rows", "replay_rows"),
    [(1, 0.3, 4, 1_000_000, 1_000), (2, 0.7, 4, 1_000_000, 10), (4, 0.6, 2, 0, 30), (5, 0.6, 1, 0, 0)],
)
def test_same_as_the_replay(spark, monkeypatch, seed, hot, rounds, plain_rows, replay_rows):
    """Whole purchases, hot ones in stretches, hot assets, and the path for groups too large for one window."""
    monkeypatch.setattr(assignments, "REPLAY_ROWS", replay_rows)
    monkeypatch.setattr(assignments, "BOUND_ROUNDS", rounds)
    monkeypatch.setattr(ranking, "PLAIN_WINDOW_ROWS", plain_rows)
    monkeypatch.setattr(ranking, "cell_width", lambda n: 7)
    events, stock = log(seed, hot)
    got = assignments.assign_with_stock(*frames(spark, events, stock)).collect()
    assert {r.event_id: r.taken for r in got} == replay(events, stock) and len(got) == sum(e[2] is not None for e in events)


def test_empty_log(spark):
    events, stock = frames(spark, [], [(1, 2)])
    assert assignments.assign_with_stock(events, stock).count() == 0


def test_hot_purchase_is_many_stretches(spark, monkeypatch):
    """A third of all events name one purchase; rushes beyond its stock alternate with calm times."""
    rnd = random.Random(6)
    base, events = datetime(2024, 1, 1), []
    for wave in range(40):
        assets = rnd.sample(range(100), 9 if wave % 4 == 0 else 4)
        for k, asset in enumerate(assets):
            events.append((len(events), asset, 1, base + timedelta(seconds=1000 * wave + k)))
            if rnd.random() < 0.3:
                events.append((len(events), asset, 1, base + timedelta(seconds=1000 * wave + 40 + k)))
        for k, asset in enumerate(rnd.sample(assets, len(assets))):
            events.append((len(events), asset, rnd.choice((None, 2, 3)), base + timedelta(seconds=1000 * wave + 90 + 20 * k)))
    stock = [(1, 6), (2, 1000), (3, 1000)]
    seen = []
    real = assignments.contended_stretches
    monkeypatch.setattr(assignments, "contended_stretches", lambda rows: seen.append(real(rows)) or seen[-1])
    monkeypatch.setattr(assignments, "BOUND_ROUNDS", 1)
    monkeypatch.setattr(assignments, "REPLAY_ROWS", 100)
    got = assignments.assign_with_stock(*frames(spark, events, stock)).collect()
    assert {r.event_id: r.taken for r in got} == replay(events, stock)
    sizes = [r["count"] for r in seen[0].where("in_stretch").groupBy("purchase_id", "stretch").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 60
