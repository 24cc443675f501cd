import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assetloom.functions import text as X
from assetloom.functions import values as V
from assetloom.operators import columns as C
from assetloom.operators import employees, enrich, standardise
from assetloom.sources import readers, writers


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def apply(spark, values, fn, kind="string"):
    return [r.o for r in one_column(spark, values, kind).select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


def test_dict_literals(spark):
    texts = [
        "{'cost_12': 10.5, 'os_3': None, 'owner_4': \"O'Neil\", 'ok_5': True}",
        "{'note': 'was: None, then', 'x': None}",
        "{'path': 'a\\\\b', 'nb': 'x\\xa0y'}",
        "{'t': (1, 2), 'n': {'a': [1, None]}}",
        "{1: False}",
        '{"k": 69}',
        "nan",
        "[1]",
        "{'open': ",
        None,
    ]
    assert apply(spark, texts, X.dict_literal) == [
        {"cost_12": "10.5", "os_3": None, "owner_4": "O'Neil", "ok_5": "true"},
        {"note": "was: None, then", "x": None},
        {"path": "a\\b", "nb": "x\xa0y"},
        {"t": "[1,2]", "n": '{"a":[1,null]}'},
        {"1": "false"},
        {"k": "69"},
        {}, {}, {}, {},
    ]


def test_flatten_and_suffixes(spark):
    df = spark.createDataFrame(
        [(1, "{'memory_1': 8, 'memory_2': 16, 'os_9': 'mac'}"), (2, None), (3, "nan")], "address_2 int, type_fields string"
    )
    flat = C.flatten_bag(df)
    assert flat.columns == ["address_2", "memory_1", "memory_2", "os_9"]
    clean = C.strip_suffixes(flat)
    assert clean.columns == ["address", "memory", "memory.1", "os"]
    assert [tuple(r) for r in clean.orderBy("address").collect()] == [(1, "8", "16", "mac"), (2, None, None, None), (3, None, None, None)]
    assert C.flatten_bag(df, keys=["os_9"]).columns == ["address_2", "os_9"]
    with pytest.raises(ValueError):
        C.flatten_bag(df.withColumn("os_9", F.lit(1)))


def test_consolidate(spark):
    df = spark.createDataFrame([(1.0, None, "a", "b"), (None, None, None, "b"), (2.0, 5.0, None, None)], "`x` double, `x.1` double, `t` string, `t.1` string")
    values = lambda d, c: [r[0] for r in d.select(C.col(c)).collect()]
    assert values(C.consolidate(df, "x", "sum"), "x") == [1.0, None, 7.0]
    assert values(C.consolidate(df, "x", "max"), "x") == [1.0, None, 5.0]
    assert values(C.consolidate(df, "t", "max"), "t") == ["a", "b", None]
    assert C.consolidate(df, "t", "first_non_null").columns == ["x", "x.1", "t"]
    assert C.consolidate(df, "none", "sum").columns == df.columns
    with pytest.raises(ValueError):
        C.consolidate(df, "x", "mean")


def test_types_and_numbers(spark):
    assert apply(spark, ["7", "7.0", "1.5", "x", "", None, "9007199254740993", " 3 "], V.to_long) == [7, 7, None, None, None, None, 9007199254740993, 3]
    assert apply(spark, ["2.9", "x", None, "-1.5"], V.to_count) == [2, 0, 0, -1]
    assert apply(spark, [7.0, 12.5, None], V.id_text, "double") == ["7", None, None]
    assert apply(spark, ["7.0", "12"], V.before_dot) == ["7", "12"]
    assert apply(spark, [0.5, 2.5, 1299.99, None, -0.4], V.whole_text, "double") == ["0", "2", "1300", "", "-0"]
    assert apply(spark, ["Active", "Odd", None], lambda c: V.map_value(c, {"Active": "A"})) == ["A", "Odd", None]


def test_dates(spark):
    iso = ["2024-01-05", "2024-01-07T23:30:00-02:00", "2024-01-07T10:00:00Z", "2024-01-07 10:00:00.123", "2024-1-5", "2024-01-07 noon", "junk", "2024", None]
    assert apply(spark, iso, V.iso_to_utc_date) == [
        "2024-01-05", "2024-01-08", "2024-01-07", "2024-01-07", "2024-01-05", "2024-01-07", None, None, None]
    assert apply(spark, ["2024-01-05", "2024-01-07T10:00:00Z", "junk", None], V.normalise_date) == ["2024-01-05", "2024-01-07", None, None]
    days = spark.createDataFrame(
        [(datetime(2024, 1, 2, 1), datetime(2024, 1, 1, 23)), (datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)), (datetime(2024, 1, 3), datetime(2024, 1, 1))],
        "a timestamp, b timestamp")
    assert [r.d for r in days.select(V.whole_days(F.col("a"), F.col("b")).alias("d")).collect()] == [0, -1, 2]


def test_texts(spark):
    assert apply(spark, ["<b>Ann</b>\tLee ", "a<x\ny>b", " É  x\x1f", None], X.clean_text) == ["ann lee", "a<x y>b", "é x", ""]
    assert apply(spark, ["  Ann\t", None], X.strip) == ["Ann", ""]
    assert apply(spark, [' "a ""b" '], X.clean_quotes) == ["a b"]
    assert apply(spark, ["Sure:\n{'a': 1,\n'b': {}}\nbye", None], X.first_braces) == ["{'a': 1,\n'b': {}}", None]
    with pytest.raises(Exception, match="no {...} block"):
        apply(spark, ["nothing"], X.first_braces)
    address = "{'line1': '1 A St', 'city': '', 'state': None, 'country': 'US'}"
    assert apply(spark, [address, "bad", None], X.address_line) == ["1 A St, US", "", ""]


def test_match_keys_need_their_columns(spark):
    df = spark.createDataFrame([("Acme", "Ring", None, "3.7")], "`vendor_name ` string, product_name string, description string, count string")
    row = C.purchase_keys(df, typed_count=True).first()
    assert (row.vendor_lower, row.item_lower, row.composite_index, row.remaining_count) == ("acme", "ring", "ring acme ", 3)
    with pytest.raises(KeyError):
        C.purchase_keys(df.drop("count"))
    with pytest.raises(KeyError):
        C.purchase_keys(df.drop("vendor_name "))
    assert C.only_category(df, "product_name", "RING").count() == 1
    assert C.snake_names(df.toDF("A b", "C-d", "E", "f")).columns == ["a_b", "c_d", "e", "f"]


def test_joins_keep_duplicates_and_skip_missing(spark):
    assets = spark.createDataFrame([(1, "mac-1", None), (2, "pc", "mac-1"), (3, None, None)], "id long, name string, hostname string")
    devices = spark.createDataFrame(
        [("mac-1", "mac", "1", "ann", "x"), ("mac-1", "mac", "2", "bob", "y"), (None, "p", "3", "c", "z")],
        "name string, platform string, version string, last_logged_username string, last_connect string")
    rows = enrich.add_devices(assets, devices).collect()
    assert sorted((r.id, r.version or "") for r in rows) == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (3, "")]
    assert sorted((r.id, r.version or "") for r in enrich.add_devices(assets, devices, null_safe=True).collect())[-1] == (3, "3")
    assert enrich.add_devices(assets, None) is assets
    assert enrich.add_vendors(assets, devices) is assets
    with pytest.raises(ValueError):
        enrich.add_devices(assets.withColumn("version", F.lit(1)), devices)
    people = spark.createDataFrame([(1, "Ann", "Lee"), (2, "Bo", None)], "id long, first_name string, last_name string")
    named = enrich.add_requesters(assets.withColumnRenamed("id", "user_id"), people).orderBy("user_id").collect()
    assert [r.requester_name for r in named] == ["Ann Lee", None, None]
    assert [(r.name, r.copies) for r in enrich.duplicate_keys(devices, "name").collect()] == [("mac-1", 2)]


def test_mapping_and_counts(spark):
    df = spark.createDataFrame([("dell inc",), ("hp",), ("odd",), (None,), ("hp",)], "v string")
    mapping = spark.createDataFrame([("dell inc", "Dell"), ("odd", None)], "raw string, canonical string")
    assert sorted(str(r.v) for r in standardise.apply_mapping(df, "v", mapping).collect()) == ["Dell", "None", "hp", "hp", "odd"]
    counts = standardise.combine_counts(standardise.value_counts(df, "v"), standardise.value_counts(df, "v"))
    assert {r.value: r["count"] for r in counts.collect()} == {"dell inc": 2, "hp": 4, "odd": 2}


def test_employees(spark):
    rows = [(" Ann ", None, "a@x", "Active"), (None, None, "n@x", "Active"), ("Bo", "B", None, "Inactive"), ("Cy", "Adams", " c@x", "Active"), ("Di", "Adams", None, "Active")]
    df = spark.createDataFrame(rows, "first_name string, last_name string, work_email string, status string")
    for c in ("employee_type", "title", "position_start_date", "department", "termination_date"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = employees.active_employees(df).orderBy("employee_id").collect()
    assert [(r.employee_id, r.full_name, r.work_email) for r in out] == [(1, "Ann ", "a@x"), (2, "Cy Adams", "c@x"), (3, "Di Adams", "")]
    with pytest.raises(KeyError):
        employees.clean_names(df.drop("work_email"))


def test_purchase_numbers_without_dates_keep_source_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "item string").coalesce(1)
    assert [r.item for r in employees.number_purchases(df).orderBy("purchase_id").collect()] == ["b", "a", "c"]


def test_files(spark, tmp_path):
    assert readers.read_optional_csv(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "v.csv").write_text('ID,Name,Address\n1,"Say ""hi""","{\'line1\': \'a\'}"\nx,B,\n')
    rows = readers.read_optional_csv(spark, str(tmp_path / "v.csv"), "id BIGINT, name STRING, address STRING").collect()
    assert [tuple(r) for r in rows] == [(1, 'Say "hi"', "{'line1': 'a'}"), (None, "B", None)]
    assert readers.read_entity(spark, "vendors", str(tmp_path / "v.csv")).columns == ["ID", "Name", "Address"]

    for page, body in {1: {"meta": {"n": 1}, "assets": [{"id": 1, "name": "a"}, {"id": 2}]}, 2: {"assets": [{"id": 3}]}, 3: {"assets": []}, 4: {"assets": [{"id": 9}]}}.items():
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "pages" / f"page-{page}.json").write_text(json.dumps(body, indent=1))
    got = readers.read_pages(spark, str(tmp_path / "pages"), "id BIGINT, name STRING").orderBy("page", "row_in_page").collect()
    assert [(r.page, r.id, r.name) for r in got] == [(1, 1, "a"), (1, 2, None), (2, 3, None)]

    for indent in (None, 4):
        (tmp_path / f"map{indent}.json").write_text(json.dumps({"1": 7, "2": 8}, indent=indent))
        assert sorted(tuple(r) for r in readers.read_json_map(spark, str(tmp_path / f"map{indent}.json")).collect()) == [("1", 7), ("2", 8)]
    assert readers.read_json_map(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "m.txt").write_text("{'dell inc': 'Dell',\n \"o'neil\": \"O'Neil\"}")
    assert sorted(tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "m.txt")).collect()) == [("dell inc", "Dell"), ("o'neil", "O'Neil")]

    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.read_or_build(spark, str(tmp_path / "copy"), build).count() == 3
    assert built == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1299.99, None), (2.0, 0.5, 3.0)], "a double, b double, c double")
    out = writers.legacy_floats(df)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "1300", ""), (2, "0", "3")]
    writers.write_clean_csv(df, str(tmp_path / "out"), legacy_format=True)
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 2
    old, new = df.select("a"), df.select("a", "b")
    assert writers.merge_append(None, None) is None
    assert writers.merge_append(old, None) is old
    assert writers.merge_append(old, new).count() == 4 and writers.merge_append(None, new).count() == 2
    entries = spark.createDataFrame([("k", 1, 1), ("k", 5, 2), ("j", 2, 1)], "k string, v long, n long")
    writers.write_json_map(writers.last_per_key(entries, "k", "v", "n"), str(tmp_path / "map"), "k", "v")
    assert sorted(tuple(r) for r in readers.read_json_map(spark, str(tmp_path / "map")).collect()) == [("j", 2), ("k", 5)]
    writers.write_mapping(spark.createDataFrame([("a", "A")], "raw string, canonical string"), str(tmp_path / "mapping"))
    assert [tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "mapping")).collect()] == [("a", "A")]


def test_subresources(spark):
    assets = spark.createDataFrame([(1,), (2,)], "display_id long")
    answers = [(1, "requests", '{"b":2}'), (1, "requests", '{"a":1}'), (1, "other", "{}"), (2, "contracts", None)]
    responses = spark.createDataFrame(answers, "display_id long, kind string, payload string")
    rows = readers.attach_subresources(assets, responses, ["requests", "contracts"]).orderBy("display_id").collect()
    assert [tuple(r) for r in rows] == [(1, '[{"a":1},{"b":2}]', "null"), (2, "null", "null")]


def test_maps_and_mappings_keep_every_value(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a\\"b": 9007199254740993,\n "n": null, "f": 2.5, "s": "7"}')
    got = {r.key: r.value for r in readers.read_json_map(spark, str(tmp_path / "m.json")).collect()}
    assert got == {'a"b': 9007199254740993, "n": None, "f": None, "s": 7}
    pairs = [("dell inc", "Dell"), ("o'neil {x}", "O'Neil"), ('q"q', "Q")]
    writers.write_mapping(spark.createDataFrame(pairs, "raw string, canonical string"), str(tmp_path / "map"))
    assert sorted(tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "map")).collect()) == sorted(pairs)


def test_incomplete_copy_is_built_again(spark, tmp_path):
    path = str(tmp_path / "copy")
    assert readers.read_or_build(spark, path, lambda: spark.range(3)).count() == 3
    assert readers.read_or_build(spark, path, lambda: spark.range(5)).count() == 3
    (tmp_path / "copy" / "_SUCCESS").unlink()
    assert readers.read_or_build(spark, path, lambda: spark.range(5)).count() == 5


def test_bag_numbers_fold_as_numbers(spark):
    rows = [(1, "{'memory_1': 8, 'memory_2': 16, 'os_1': 'x', 'os_2': 'y'}"), (2, "{'memory_1': 9, 'os_2': 'z'}"), (3, None)]
    bags = spark.createDataFrame(rows, "id long, type_fields string")
    flat = C.strip_suffixes(C.flatten_bag(bags))
    folded = C.consolidate(C.consolidate(flat, "memory", "max"), "os", "max")
    assert sorted((r.id, r.memory, r.os) for r in folded.collect()) == [(1, 16.0, "x"), (2, 9.0, "z"), (3, None, None)]
    long = C.bag_rows(bags, "id").collect()
    assert len(long) == 6 and (1, "memory_2", "16") in {tuple(r) for r in long}


def test_dates_do_not_depend_on_the_zone(spark):
    texts = spark.createDataFrame([("2024-01-05T00:30:00Z",), ("2024-01-05 23:30:00",), ("2024-01-05T00:30:00+05:30",)], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in texts.select(V.iso_to_utc_date(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-01-05", "2024-01-05", "2024-01-04"]


def test_line_breaks_in_csv_values(spark, tmp_path):
    (tmp_path / "v.csv").write_text('ID,Name,Address\n1,"A, first","12 High Street\nTown"\n2,B,"\r\nend\n"\n', newline="")
    expected = [(1, "A, first", "12 High Street\nTown"), (2, "B", "\r\nend\n")]
    assert [(int(r.ID), r.Name, r.Address) for r in readers.read_entity(spark, "vendors", str(tmp_path / "v.csv")).collect()] == expected
    values = ["a\nb", "\nfirst", "last\n", "a\r\nb", "a\rb", ' "quoted"\n, too ', "plain"]
    rows = [(i, v) for i, v in enumerate(values)]
    writers.write_csv(spark.createDataFrame(rows, "id long, name string"), str(tmp_path / "out"))
    back = readers.read_optional_csv(spark, str(tmp_path / "out"), "id BIGINT, name STRING")
    assert sorted((r.id, r.name) for r in back.collect()) == rows
