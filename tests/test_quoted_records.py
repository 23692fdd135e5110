"""Quoted line breaks in files of many splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from brightledger.sources.delimited import read_delimited
from brightledger.sources.records import quoted_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(path, rows, delimiter=",", encoding="utf-8", end="\n"):
    with open(path, "w", newline="", encoding=encoding) as out:
        csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
    return str(path)


def _cells(n, seed):
    rng = random.Random(seed)
    words = ["plain", 'with "quotes"', "two\nlines", "\n\n", "a;b,c", "", "tail\n", 'q"\n"q', "é" * 40]
    return [(i, rng.choice(words) + rng.choice(["", "x" * rng.randint(0, 300)]), rng.random() if i % 9 else None) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_splits(small_splits, tmp_path, end):
    spark = small_splits
    rows = _cells(700, 4)
    # One record over dozens of splits.
    rows.insert(350, (10_000, "long\n" * 12_000, 1.5))
    path = _write(tmp_path / "many.csv", [("id", "text", "share"), *rows], end=end)
    records = quoted_records(spark, path)
    assert records.select("at").distinct().count() > 20
    table = read_delimited(spark, path, multiline=True)
    assert table.frame.dtypes == [("id", "int"), ("text", "string"), ("share", "double")]
    got = {r.id: (r.text or "", r.share) for r in table.frame.collect()}
    want = {i: (t, s) for i, t, s in rows}
    assert len(got) == len(rows) and got == want


def test_several_files_and_kinds(small_splits, tmp_path):
    spark = small_splits
    one, two = _cells(200, 5), [(i, t, s) for i, t, s in _cells(200, 6)]
    _write(tmp_path / "a.csv", [("id", "text", "share"), *one])
    _write(tmp_path / "b.csv", [("text", "id", "share"), *[(t, i + 500, s) for i, t, s in two]], delimiter=";", encoding="latin-1")
    frame = read_delimited(spark, str(tmp_path), multiline=True).frame
    assert frame.count() == 400 and frame.agg(F.sum("id")).first()[0] == sum(range(200)) + sum(range(500, 700))
    assert {r.id - 500: r.text or "" for r in frame.filter("id >= 500").collect()} == {i: t for i, t, _ in two}


def test_quoted_header_and_types(spark, tmp_path):
    rows = [("a\nb", "n", "big", "day", "flag", "none"), ("x", "1", "30000000000", "2024-01-05", "true", ""), ("", "2", "4", "2024-02-06", "FALSE", "")]
    frame = read_delimited(spark, _write(tmp_path / "h.csv", rows), multiline=True).frame
    assert frame.dtypes == [("a\nb", "string"), ("n", "int"), ("big", "bigint"), ("day", "timestamp"), ("flag", "boolean"), ("none", "string")]
    assert [r.n for r in frame.orderBy("n").collect()] == [1, 2]
    assert read_delimited(spark, _write(tmp_path / "e.csv", rows[:1]), multiline=True).warnings == ["a header but no data rows"]
    typed = read_delimited(spark, _write(tmp_path / "t.csv", [("k", "v"), ("1", "p\nq")]), multiline=True, schema="k long, v string")
    assert typed.frame.collect() == [(1, "p\nq")]


def test_quoted_line_break_query_writes_a_file_a_task(spark, tmp_path):
    """Few tasks that each write much would read much, too."""
    from queries.intake import io1_quoted_line_breaks

    docs = spark.createDataFrame([(i, f'one "{i}"\ntwo, three\n', "en" if i % 2 else None) for i in range(60)], "doc_id long, text string, lang string")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    seen = []
    try:
        import queries.intake as intake

        kept = intake.read_delimited
        intake.read_delimited = lambda spark, path, **more: seen.append(spark.read.text(path).inputFiles()) or kept(spark, path, **more)
        rows = io1_quoted_line_breaks(spark, str(tmp_path)).collect()
    finally:
        intake.read_delimited = kept
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["row_count"] for r in rows) == 60 and sum(r["breaks"] for r in rows) == 60
    assert len(seen[0]) > 2
