from datetime import datetime

import pytest

from assetloom.operators import assignments as A
from assetloom.operators import sync, views
from assetloom.session import CHECKPOINT_CONF, checkpoint_root


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_null_never_clears_and_twice_is_once(spark):
    stored = spark.createDataFrame([("1", "old", "keep"), ("2", "two", "x")], "department_id string, name string, extra string")
    source = spark.createDataFrame([(1, None), (1, "new"), (1, None), (3, "three")], "id long, name string").selectExpr("*", "monotonically_increasing_id() AS n")
    once = sync.push_entity("departments", stored, source, "n")
    assert rows(once, "department_id", "name", "extra") == [("1", "new", "keep"), ("2", "two", "x"), ("3", "three", None)]
    assert rows(sync.push_entity("departments", once, source, "n"), "department_id", "name", "extra") == rows(once, "department_id", "name", "extra")


def test_asset_type_note_clears(spark):
    stored = spark.createDataFrame([("1", "t", "note")], "asset_type_id string, name string, note string")
    source = spark.createDataFrame([(1, "t", None)], "id long, name string, description string")
    assert rows(sync.push_entity("asset_types", stored, source, "id"), "asset_type_id", "name", "note") == [("1", "t", None)]


def test_first_record_only(spark):
    stored = spark.createDataFrame([(10, "a", "x"), (5, "a", "y"), (7, "b", "z")], "rec long, k string, v string")
    source = spark.createDataFrame([("a", "new", 1)], "k string, v string, n int")
    assert rows(sync.upsert(stored, source, "k", "n", record="rec"), "rec", "k", "v") == [(10, "a", "x"), (5, "a", "new"), (7, "b", "z")]


def test_parents(spark):
    types = spark.createDataFrame([(7, None), (8, "7.0"), (9, "99")], "id long, parent_asset_type_id string")
    assert rows(sync.parent_links(types)) == [("8", "7")]


def test_links_last_row_wins_and_stubs(spark):
    assets = spark.createDataFrame(
        [(1, 10, 3.0, 7, None, 5, None), (2, 10, 3.0, 8, 4, 5, 6), (3, 11, None, 9, 4, 6, None), (4, None, 2.0, None, None, None, 1)],
        "row long, asset_id long, matched_employee_id double, department_id long, product_id long, vendor_id long, asset_type_id long",
    ).selectExpr("*", "asset_type_id AS purchase_assignment")
    links, entities = sync.build_links(
        assets, {"employee_id": spark.createDataFrame([("3", "Ann")], "employee_id string, name string"),
                 "vendor_id": spark.createDataFrame([("1", "v")], "vendor_id string, name string")}, "row")
    assert rows(links["asset_employee"]) == [(10, 3)]
    assert rows(links["employee_department"]) == [(3, 8)]
    assert rows(links["asset_product"]) == [(10, 4), (11, 4)]
    assert rows(links["product_asset_type"]) == [(4, 6)]
    assert rows(links["asset_purchase"]) == [(10, 6)]
    assert rows(entities["vendor_id"]) == [("1", "v"), ("5", None), ("6", None)]
    assert rows(entities["employee_id"]) == [("3", "Ann")]
    assert {r.relation: r.linked for r in sync.link_counts(assets).collect()}["asset_employee"] == 2
    assert rows(views.reverse(links["asset_product"], "asset_id", "product_id")) == [(4, 10), (4, 11)]
    assert rows(views.reverse_counts(links["asset_product"], "asset_id", "product_id")) == [(4, 2)]
    types = views.through(links["asset_product"], links["product_asset_type"], "product_id", "asset_id", "asset_type_id")
    assert rows(types) == [(10, 6), (11, 6)]


def test_event_log(spark):
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    events = spark.createDataFrame(
        [(1, 100, t[0]), (1, 200, t[1]), (2, 100, t[0]), (2, None, t[2]), (3, 200, t[4]), (3, 100, t[3]), (4, 999, t[0])],
        "asset_id long, purchase_id long, ts timestamp")
    saved = A.current_assignments(events)
    assert rows(saved) == [(1, 200), (3, 200), (4, 999)]
    purchases = spark.createDataFrame([(100, 1, "v", "i", t[0]), (200, 1, "v", "j", None)], "purchase_id long, count long, vendor string, item string, date timestamp")
    assets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "asset_id long, name string")
    replayed, stock = A.replay(assets, purchases, saved)
    assert rows(replayed, "asset_id", "purchase_assignment") == [(1, 200), (2, None), (3, 200)]
    assert rows(stock, "purchase_id", "remaining_count") == [(100, 1), (200, -1)]
    assert rows(A.over_allocated(stock), "purchase_id") == [(200,)]
    assert rows(A.assignment_summary(assets, saved)) == [(3, 3, 0)]
    assert rows(A.assignment_list(assets, stock, saved), "asset_id", "purchase_date", "remaining_count") == [("1", "", "-1"), ("3", "", "-1")]
    assert rows(A.dangling_assignments(assets, purchases, saved)) == [(4, 999)]
    new = spark.createDataFrame([(1, 5), (9, 9)], "asset_id long, purchase_id long")
    assert rows(A.merge_maps(saved, new, "asset_id", "purchase_id")) == [(1, 5), (3, 200), (4, 999), (9, 9)]


def test_checkpoint_folder(spark):
    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default):
            assert key == CHECKPOINT_CONF
            return self.folder

    class Session:
        class sparkContext:
            master, applicationId = "yarn", "app"

        def __init__(self, folder):
            self.conf = Conf(folder)

    assert checkpoint_root(Session("hdfs:///steps/")) == "hdfs:///steps"
    with pytest.raises(RuntimeError):
        checkpoint_root(Session(None))
    assert checkpoint_root(spark) == checkpoint_root(spark)
