"""Paged data source, stored tables, sub-resource parts, depreciation."""

import json
import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assetloom.functions import text as X
from assetloom.operators.depreciation import depreciation_schedule
from assetloom.sources import pages, readers, stored


def land(folder, number, page):
    folder.mkdir(exist_ok=True)
    (folder / f"assets_{number}.json").write_text(page if isinstance(page, str) else json.dumps(page))


def read(spark, folder, **options):
    pages.register(spark)
    reader = spark.read.format("pages").option("recordSchema", "id bigint, name string, ok boolean, tags array<string>, cost double")
    return reader.options(**options).load(str(folder))


def test_pages_stop_at_the_first_empty_one(spark, tmp_path):
    folder = tmp_path / "landed"
    for n in (1, 2, 3, 10, 11):
        records = [{"id": 100 * n + k, "name": f"n{k}", "ok": k == 1, "tags": ["a", str(n)], "cost": 1} for k in range(3)]
        land(folder, n, {"meta": {"page": n}, "assets": records, "other": [1]})
    land(folder, 12, {"assets": []})
    land(folder, 13, {"assets": [{"id": 1}]})
    for size in (1, 2, 64):
        df = read(spark, folder, pagesPerPartition=size, planners=3)
        assert df.rdd.getNumPartitions() == -(-5 // size)
        got = sorted(tuple(r) for r in df.collect())
        assert [r[:3] for r in got] == [(n, k, 100 * n + k) for n in (1, 2, 3, 10, 11) for k in range(3)]
        assert got[1] == (1, 1, 101, "n1", True, ["a", "1"], 1.0)


def test_odd_pages(spark, tmp_path):
    folder = tmp_path / "odd"
    land(folder, 1, {"rows": [{"id": "x", "name": {"a": [1]}, "ok": 1}, "no object", {"id": 2**70, "cost": 2.5}]})
    got = [tuple(r) for r in read(spark, folder).orderBy("row_in_page").collect()]
    assert got == [(1, 0, None, '{"a":[1]}', None, None, None), (1, 1, None, None, None, None, None), (1, 2, None, None, None, None, 2.5)]
    land(folder, 2, {"no": "list"})
    land(folder, 3, "not json")
    assert read(spark, folder, planners=1).count() == 3
    with pytest.raises(Exception, match="Expecting value"):
        read(spark, folder, planners=8).count()
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_stored_table_is_not_shuffled(spark, tmp_path):
    rows = [(i, f"v{i % 7}" if i % 5 else None, i / 2) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "id long, v string, x double")
    name = f"stored_test_{tmp_path.name.replace('-', '_')}"
    stored.create_stored(df, name, str(tmp_path / "t"), 4)
    assert sorted(map(tuple, stored.read_stored(spark, name).collect()), key=str) == sorted(rows, key=str)
    new = [(1, "v1", 0.5), (5, None, 2.5), (5, "", 2.5), (999, None, None), (999, None, None), (7, None, 3.5)]
    fresh = stored.unseen_rows(spark.createDataFrame(new, "id long, v string, x double"), spark.table(name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        # Between each scan of the stored table and its join lies no exchange.
        scans = list(re.finditer(r"\n([ :+|-]*)[^\n]*FileScan parquet [^\n]*", plan))
        assert len(scans) == 3
        for scan in scans:
            above = [line for line in plan[: scan.start()].split("\n") if line.strip()]
            depth, parents = len(scan[1]), []
            for line in reversed(above):
                own = len(re.match(r"[ :+|-]*", line)[0])
                if own < depth:
                    parents.append(line)
                    depth = own
            join = next(k for k, line in enumerate(parents) if "Join" in line)
            assert not any("Exchange" in line for line in parents[:join])
        wanted = sorted({(5, "", 2.5), (999, None, None), (7, None, 3.5)}, key=str)
        assert sorted((tuple(r) for r in fresh.select("id", "v", "x").collect()), key=str) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    whole = stored.append_stored(spark.createDataFrame(new, "id long, v string, x double"), name)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted({*rows, *new}, key=str)
    with pytest.raises(ValueError):
        stored.append_stored(spark.createDataFrame([(1, 2)], "id long, unknown long"), name)


def test_parts_of_a_hot_key(spark):
    """A third of all responses belong to one key: many bounded parts, nothing lost, and no single value."""
    rows = [(1 if i % 3 == 0 else i, "k", json.dumps({"n": i, "t": "x" * (i % 40)})) for i in range(900)] + [(2, "k", None), (None, "k", "[]")]
    responses = spark.createDataFrame(rows, "display_id long, kind string, payload string")
    got = readers.subresource_parts(responses, part_chars=500).collect()
    longest = max(len(r[2]) for r in rows if r[2])
    assert max(len(r.payload) for r in got) <= 500 + longest + 2 and sum(r.display_id == 1 for r in got) > 20
    seen = {}
    for r in sorted(got, key=lambda r: r.part):
        assert r.part == len({x.part for x in got if x.display_id == r.display_id and x.part <= r.part})
        seen.setdefault(r.display_id, []).extend(json.loads(r.payload))
    for key in {r[0] for r in rows}:
        assert seen.get(key, []) == [json.loads(p) for p in sorted(r[2] for r in rows if r[0] == key and r[2])]
    assets = spark.createDataFrame([(1,), (4,)], "display_id long")
    with pytest.raises(ValueError, match="subresource_parts"):
        readers.attach_subresources(assets, responses, ["k"], most_chars=1000)


def test_depreciation_ends_at_zero(spark):
    rows = [(1, 100.0, date(2024, 1, 31), 3), (2, 999.99, date(2024, 2, 1), 12), (3, None, date(2024, 1, 1), 3), (4, 5.0, None, 3),
            (5, 5.0, date(2024, 1, 1), None), (6, 5.0, date(2024, 1, 1), 0), (7, 0.01, date(2023, 11, 15), 7), (8, 10.0, date(2024, 5, 1), 1)]
    assets = spark.createDataFrame(rows, "asset_id long, cost double, date date, useful_life int")
    got = depreciation_schedule(assets).orderBy("asset_id", "period").collect()
    by = {k: [r for r in got if r.asset_id == k] for k in {r.asset_id for r in got}}
    assert {k: len(v) for k, v in by.items()} == {1: 4, 2: 12, 7: 8, 8: 1}
    for k, own in by.items():
        cost = Decimal(str(rows[k - 1][1]))
        assert own[-1].book_value == 0 and own[-1].accumulated == cost == sum(r.depreciation for r in own)
        assert all(a.book_value >= b.book_value for a, b in zip(own, own[1:]))
    assert [r.depreciation for r in by[1]] == [Decimal("1.08"), Decimal("33.33"), Decimal("33.33"), Decimal("32.26")]
    assert [str(r.month) for r in by[1]] == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    kept = depreciation_schedule(assets.withColumn("rest", F.lit(40)), salvage="rest").where("asset_id = 1").orderBy("period").collect()
    assert kept[-1].book_value == 40 and sum(r.depreciation for r in kept) == 60


def test_literals_as_python_writes_them(spark):
    values = [
        {"a": "it's", "b": 'say "x"', "c": "both ' and \"", "d": "tab\tnew\nline\r", "e": "\x00\x1f\x7f\xa0", "f": "日本🙂\U000e0001", "g": "a\\'b\\\\"},
        {"None": "True", "x": "None, True", "n": None, "t": True, "f": False, "num": -1.5e-07, "big": 10**20},
        {"l": [1, "a'b", None, [True]], "d": {"k": "v's", "n": None}, "tup": (1,), "e": [], "o": {}, "nested": {"a": {"b": ("x", 2)}}},
        {1: "one", True: "yes", 2.5: "f"},
        {"": "", " ": "  two  spaces ", "comma": "a, ]b", "brace": "{None}", "cn": "x" * 3000 + "'" * 3000},
        {},
    ]
    texts = [repr(v) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    query = df.select("i", X.dict_literal(F.col("t")).alias("m"))
    assert "Python" not in query._jdf.queryExecution().executedPlan().toString() and "EvalPython" not in query._jdf.queryExecution().toString()
    for value, row in zip(values, query.orderBy("i").collect()):
        assert set(row.m) == {str(k).lower() if isinstance(k, bool) else str(k) for k in value}
        for k, v in value.items():
            held = row.m[str(k).lower() if isinstance(k, bool) else str(k)]
            if v is None or isinstance(v, str):
                assert held == v
            else:
                assert json.loads(held) == json.loads(json.dumps(v))
