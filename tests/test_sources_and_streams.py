from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brightledger.session import work_folder
from brightledger.sources.datasets import incremental_ingest, read_dataset, sample_rows, write_dataset
from brightledger.sources.delimited import UnreadableFile, read_delimited, separator_of, unique_headers
from brightledger.sources.files import list_files, split_files, validate_files
from brightledger.streaming.ingest import file_stream, ingest_new_files, keep_totals, monthly_stream, months_of
from tests.conftest import as_dicts


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    path = write(tmp_path / "a.csv", sep.join([" id ", "name"]) + "\n" + sep.join(["1", '"x y"']) + "\n" + sep.join(["2", "z"]) + "\n")
    table = read_delimited(spark, path)
    assert table.separator == sep and table.frame.columns == ["id", "name"] and table.warnings == []
    assert [tuple(r) for r in table.frame.orderBy("id").collect()] == [(1, "x y"), (2, "z")]


def test_latin1_and_bom(spark, tmp_path):
    latin = read_delimited(spark, write(tmp_path / "l.csv", "stadt,n\nKöln,1\n".encode("latin-1")))
    assert latin.encoding == "ISO-8859-1" and latin.frame.first()["stadt"] == "Köln" and latin.warnings
    bom = read_delimited(spark, write(tmp_path / "b.csv", "\ufeffstadt,n\nKöln,1\n"))
    assert bom.frame.columns == ["stadt", "n"] and bom.frame.first()["stadt"] == "Köln"


def test_repeated_headers(spark, tmp_path):
    table = read_delimited(spark, write(tmp_path / "d.csv", "a,b,a,a\n1,2,3,4\n"))
    assert table.frame.columns == ["a", "b", "a.1", "a.2"] and table.duplicate_columns == ["a"]
    assert tuple(table.frame.first()) == (1, 2, 3, 4)
    assert unique_headers(["x", "x.1", "x"]) == (["x", "x.1", "x.2"], ["x"])


def test_header_only_and_empty(spark, tmp_path):
    assert read_delimited(spark, write(tmp_path / "h.csv", "a,b\n")).warnings == ["a header but no data rows"]
    with pytest.raises(UnreadableFile):
        read_delimited(spark, write(tmp_path / "e.csv", ""))


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert read_delimited(spark, path, multiline=True).frame.count() == 2


def test_single_column():
    assert separator_of("name") == "," and separator_of('"a;b",c') == "," and separator_of("a;b,c;d") == ";"


def test_dataset_round_trip(spark, tmp_path):
    df = spark.range(5).select("id", F.lit(None).alias("nothing"), F.expr("parse_json('[1]')").alias("v"))
    write_dataset(df, str(tmp_path), "d")
    back = read_dataset(spark, str(tmp_path), "d")
    assert dict(back.dtypes) == {"id": "bigint", "nothing": "string", "v": "string"} and back.count() == 5
    with pytest.raises(Exception, match="exist"):
        write_dataset(df, str(tmp_path), "d")
    assert sample_rows(back, 0).count() == 1 and sample_rows(spark.range(900), 700).count() == 500


def test_file_verdicts(spark, tmp_path):
    for name, size in {"a.csv": 10, "b.XLSX": 10, "c.xls": 10, "d.pdf": 10, "noext": 10, "e.csv": 0, "f.csv": 3000}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    verdicts = validate_files(list_files(spark, str(tmp_path / "*")), 2000 / 1024 / 1024)
    accepted, rejected = split_files(verdicts)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in as_dicts(accepted)) == ["a.csv", "b.XLSX"]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in as_dicts(rejected)} == {
        "c.xls": "legacy_format", "d.pdf": "unsupported_type", "noext": "no_extension", "e.csv": "empty", "f.csv": "too_big",
    }


def test_incremental_ingest(spark):
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    listing = spark.createDataFrame([("a", t[2]), ("b", t[1]), ("c", t[0]), ("d", t[4])], "item_id string, modified_at timestamp")
    state = spark.createDataFrame([("a", t[1]), ("b", t[1])], "item_id string, synced_modified_at timestamp")
    out = incremental_ingest(listing, state, lambda items: items.select("item_id", F.when(F.col("item_id") == "d", "broken").alias("error")))
    got = {r["item_id"]: (r["action"], r["status"], r["synced_modified_at"]) for r in as_dicts(out)}
    assert got == {"a": ("sync", "synced", t[2]), "b": ("skip", "synced", t[1]), "c": ("sync", "synced", t[0]), "d": ("sync", "error", None)}


def test_stream_takes_in_only_new_files(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = spark.range(10).select("id", F.lit("a").alias("k"))
    first.write.parquet(f"{source}/one.parquet")
    schema = first.schema

    def run():
        ingest_new_files(file_stream(spark, f"{source}/*", schema), target, progress).awaitTermination()
        return spark.read.parquet(target).count()

    assert run() == 10 and run() == 10
    spark.range(5).select("id", F.lit("b").alias("k")).write.parquet(f"{source}/two.parquet")
    assert run() == 15


def test_monthly_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 5), 1.0), (datetime(2024, 1, 6), 2.0), (datetime(2024, 2, 1), 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    df.write.parquet(str(tmp_path / "in"))
    days = monthly_stream(file_stream(spark, str(tmp_path / "in"), df.schema), "ts", "v")
    keep_totals(days, str(tmp_path / "days"), str(tmp_path / "p")).awaitTermination()
    assert {r["period"]: r["value"] for r in as_dicts(months_of(spark.read.parquet(str(tmp_path / "days"))))} == {"2024-01": 3.0, "2024-02": 4.0}


def test_later_batches_replace_the_totals_of_their_days(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "days", "p"))
    shape = "ts timestamp_ntz, v double"
    for n, rows in enumerate([[(datetime(2024, 1, 30), 1.0), (datetime(2024, 1, 31), 2.0)], [(datetime(2024, 1, 31), 4.0), (datetime(2024, 2, 1), 8.0)]]):
        spark.createDataFrame(rows, shape).write.parquet(f"{source}/{n}.parquet")
        stream = file_stream(spark, f"{source}/*", spark.read.parquet(f"{source}/0.parquet").schema)
        keep_totals(monthly_stream(stream, "ts", "v"), target, progress).awaitTermination()
    days = spark.read.parquet(target)
    assert days.filter("day = DATE '2024-01-30'").count() == 1 and days.filter("day = DATE '2024-01-31'").count() == 2
    assert {r["period"]: (r["value"], r["row_count"]) for r in as_dicts(months_of(days))} == {"2024-01": (7.0, 3), "2024-02": (8.0, 1)}


def test_work_folder_follows_the_session(spark):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "/shared/place/" if key == "spark.checkpoint.dir" else default

    assert work_folder(Session, "x").startswith("/shared/place/x-")
    assert work_folder(spark, "x") != work_folder(spark, "x")


def test_a_folder_of_different_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name\n1;Größe\n".encode())
    (tmp_path / "b.csv").write_bytes("name,id\nMaß,2\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfid|name|more\n3|x|y\n")
    (tmp_path / "d.csv").write_bytes(b"")
    table = read_delimited(spark, str(tmp_path))
    assert sorted((r["id"], r["name"], r["more"]) for r in table.frame.collect()) == [(1, "Größe", None), (2, "Maß", None), (3, "x", "y")]
    assert len(table.warnings) == 3 and table.encoding == "ISO-8859-1, UTF-8"


def test_a_long_header(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(600)] + ["dup", "dup"]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * 602) + "\n")
    table = read_delimited(spark, str(tmp_path))
    assert table.duplicate_columns == ["dup"] and table.frame.columns[-2:] == ["dup", "dup.1"] and len(table.frame.columns) == 602
