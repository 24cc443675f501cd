"""CSV records with line breaks, split over many small file ranges, against the one-task reader and Python's own."""

import csv
import random

import pytest

from assetloom.sources import csv_records, readers

VALUES = ["", "a", "two words", "x,y", "line\nbreak", "\n\nthree\n", 'say "hi"', '"', '"",\n"', "tail\n", "a,\"b\n\",c", "ü🙂", "5\" pipe, long", "z" * 90]


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(["id", "first", "second"])
        writer.writerows(rows)


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows_of(df):
    return sorted((r.id, r.first or "", r.second or "") for r in df.collect())


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n")])
def test_same_records_as_python(spark, tmp_path, small_ranges, seed, end):
    pick = random.Random(seed)
    expected = []
    for k in range(2):
        rows = [(1000 * k + i, pick.choice(VALUES), pick.choice(VALUES)) for i in range(400)]
        write(tmp_path / f"part{k}.csv", rows, end)
        expected += rows
    df = readers.read_csv(spark, str(tmp_path), "id bigint, first string, second string")
    assert rows_of(df) == sorted(expected)
    assert csv_records.records(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    if end == "\n":
        one_task = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
        assert rows_of(one_task.selectExpr("bigint(id) AS id", "first", "second")) == sorted(expected)


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line of text\n" * 600
    rows = [(1, long, "x"), (2, "plain", long + '"'), (3, "", "end")]
    write(tmp_path / "long.csv", rows)
    assert rows_of(readers.read_csv(spark, str(tmp_path), "id bigint")) == rows


def test_without_line_breaks_files_are_split_as_lines(spark, tmp_path, small_ranges):
    rows = [(i, "a,b", 'c "d"') for i in range(2000)]
    write(tmp_path / "flat.csv", rows)
    assert csv_records.records(spark, str(tmp_path)) is None
    df = readers.read_csv(spark, str(tmp_path), "id bigint")
    assert rows_of(df) == rows and df.rdd.getNumPartitions() > 8


def test_literal_quotes_do_not_open_a_value(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('id,first,second\n1,5" pipe,ok\n2,"a\nb",3" x\n3,""quoted"" not,y\n')
    got = rows_of(readers.read_csv(spark, str(tmp_path), "id bigint"))
    assert [r[0] for r in got] == [1, 2, 3] and got[0][1:] == ('5" pipe', "ok") and got[1][1:] == ("a\nb", '3" x')


def test_open_quote_raises(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id,first,second\n1,"never closed,2\n3,4,5\n')
    with pytest.raises(ValueError, match="no end"):
        readers.read_csv(spark, str(tmp_path), "id bigint")
