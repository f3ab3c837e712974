from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowlens.session import clear_scratch, scratch_path, shared_folder, stage_table
from rowlens.sources.dates import parse_date, parse_date_columns
from rowlens.sources.sinks import read_results, write_cleaned, write_results
from rowlens.sources.tables import LoadError, infer_types, load_csv, load_parquet


def put(tmp_path, text: str, name: str = "t.csv", encoding: str = "utf-8") -> str:
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_and_missing_values(spark, tmp_path):
    path = put(
        tmp_path,
        " id ,price,flag,name,order_date,void\n"
        "1,2.5,True,Zoë,2024-01-05,\n2,NA,False,n/a,2024-02-01,\n3,7,True,\"a, \"\"b\"\"\",,\n",
    )
    df = load_csv(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "price": "double", "flag": "boolean", "name": "string",
        "order_date": "timestamp_ntz", "void": "double",
    }
    assert rows(df, "id", "price", "name") == [(1, 2.5, "Zoë"), (2, None, None), (3, 7.0, 'a, "b"')]


def test_latin1(spark, tmp_path):
    df = load_csv(spark, put(tmp_path, "name,näme\ncafé,ü\n", encoding="latin1"), stage=True)
    assert df.columns == ["name", "näme"] and rows(df) == [("café", "ü")]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, 'a,b\n"x\ny",1\n"p ""q"" r",2\n')
    assert rows(load_csv(spark, path)) == [('p "q" r', 2), ("x\ny", 1)]
    assert rows(load_csv(spark, path, multiline=True)) == [('p "q" r', 2), ("x\ny", 1)]


def test_ragged_rows(spark, tmp_path):
    """Extra fields are an error that shows a row; missing ones are null."""
    with pytest.raises(LoadError, match="2 row.s. .* 3,4,5"):
        load_csv(spark, put(tmp_path, "a,b\n1,2\n3,4,5\n6,7,8,9\n"))
    with pytest.raises(LoadError, match="more fields"):
        load_csv(spark, put(tmp_path, 'a,b\n"x\ny",1,2\n', "m.csv"))
    fine = put(tmp_path, 'a,b\n"1,2",3\n4\n', "f.csv")
    assert rows(load_csv(spark, fine)) == [("1,2", 3), ("4", None)]


def test_headers_stay_unique(spark, tmp_path):
    df = load_csv(spark, put(tmp_path, " a,a,b\n1,2,3\n"))
    assert df.columns == ["a", "a_2", "b"] and rows(df) == [(1, 2, 3)]


def test_infinite_numbers_as_text(spark):
    df = spark.createDataFrame([("1.5", "inf"), ("-Infinity", "x")], "a string, b string")
    assert dict(infer_types(df).dtypes) == {"a": "double", "b": "string"}
    assert rows(infer_types(df), "a") == [(-float("inf"),), (1.5,)]


@pytest.mark.parametrize("text", ["a,b\n", ""])
def test_no_rows_is_an_error(spark, tmp_path, text):
    with pytest.raises(LoadError):
        load_csv(spark, put(tmp_path, text))


def test_bad_paths(spark, tmp_path):
    with pytest.raises(LoadError, match="not a .csv"):
        load_csv(spark, put(tmp_path, "a\n1\n", "t.txt"))
    with pytest.raises(LoadError, match="no such file"):
        load_csv(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(LoadError, match="no such file"):
        load_parquet(spark, str(tmp_path / "missing.parquet"))


def test_mixed_numbers_stay_text(spark):
    df = spark.createDataFrame([("1", "1", "12345678901234567890"), ("x", "2.5", "1")], "a string, b string, c string")
    assert dict(infer_types(df).dtypes) == {"a": "string", "b": "double", "c": "double"}


def test_date_forms(spark):
    texts = {
        "2024-01-05": datetime(2024, 1, 5), "2024-01-05 10:30:00": datetime(2024, 1, 5, 10, 30),
        "2024-01-05T10:30:00": datetime(2024, 1, 5, 10, 30), "2024/01/05": datetime(2024, 1, 5),
        "01/05/2024": datetime(2024, 1, 5), "25/01/2024": datetime(2024, 1, 25),
        "25-01-2024": datetime(2024, 1, 25), "5 Jan 2024": datetime(2024, 1, 5), "2024-01": datetime(2024, 1, 1),
        "January 5, 2024": datetime(2024, 1, 5), "1/25/2024 9:05": datetime(2024, 1, 25, 9, 5),
        "Jan 2024": datetime(2024, 1, 1), "15-Jan-2024": datetime(2024, 1, 15),
        "01/15/24": datetime(2024, 1, 15), "01/15/85": datetime(1985, 1, 15), "2024.01.15": datetime(2024, 1, 15),
        "15.01.2024": datetime(2024, 1, 15), "20240115": datetime(2024, 1, 15),
        "01/15/2024 3:30 PM": datetime(2024, 1, 15, 15, 30), "January 15 2024": datetime(2024, 1, 15),
        "3/2024": datetime(2024, 3, 1), "2024Q3": datetime(2024, 7, 1), "31/02/2024": None, "soon": None, "5": None, "1234567": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", parse_date(df.t)).collect()} == texts


def test_further_spellings(spark):
    day = datetime(2024, 1, 15)
    texts = {
        "15-Jan-24": day, "JAN 2024": datetime(2024, 1, 1), "jan 15, 2024": day, "Mon, 15 Jan 2024": day,
        "Monday, January 15, 2024": day, "15/01/2024 3:30 PM": day.replace(hour=15, minute=30), "01-15-24": day,
        "15 Jan 2024 10:30": day.replace(hour=10, minute=30), "Jan 15, 2024 12:05 AM": day.replace(minute=5),
        "20240115T103000": day.replace(hour=10, minute=30), "2024-01-15 10:30 AM": day.replace(hour=10, minute=30),
        "1/15/2024 15:04:05.123": datetime(2024, 1, 15, 15, 4, 5, 123000), "Sept 5, 2024": datetime(2024, 9, 5),
        "2024-Jan-15": day, "Jan 15th, 2024": day, "1/15/2024 13:00 PM": None, "1/15/2024 25:00": None,
        "12.5": None, "1,234": None, "x" * 100 + " 2024": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", parse_date(df.t)).collect()} == texts


@pytest.mark.parametrize(("values", "second"), [
    (["25/01/2024", "03/04/2024"], datetime(2024, 4, 3)), (["01/25/2024", "03/04/2024"], datetime(2024, 3, 4)),
    (["03.04.24 10:00", "03/04/2024", "Tue, 25-01-2024"], datetime(2024, 4, 3)),
    (["25/01/2024", "03/04/2024", "01/25/2024"], datetime(2024, 3, 4)), (["x", "03/04/2024"] * 5, None),
])
def test_one_order_of_day_and_month_in_a_column(spark, tmp_path, values, second):
    """Values that can only be read one way settle the others, in a table and in a file."""
    df = spark.createDataFrame([(v,) for v in values], "day string").repartition(3)
    path = put(tmp_path, "".join(f"\"{v}\"\n" for v in ["day", *values]))
    for found in (parse_date_columns(df), load_csv(spark, path)):
        got = {r["day"] for r in found.collect()}
        assert (second in got) if second else got == {"x", "03/04/2024"}


def test_four_fifths_of_the_values_must_be_dates(spark):
    good = [("2024-01-05", "2024-01-05", "2024-01-05")] * 8
    data = good + [("x", "x", None), ("y", "2024-01-06", None), ("2024-01-07", "2024-01-07", "z")]
    df = spark.createDataFrame(data, "day string, quarter string, note string")
    kinds = dict(parse_date_columns(df).dtypes)
    assert kinds == {"day": "timestamp_ntz", "quarter": "timestamp_ntz", "note": "string"}
    worse = df.unionByName(spark.createDataFrame([("x", "x", "x")], df.schema))
    assert dict(parse_date_columns(worse).dtypes)["day"] == "string"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "c")], "k int, t string")
    assert rows(load_csv(spark, write_cleaned(df, str(tmp_path / "out.csv")))) == [(1, 'a "q", b'), (2, "c")]
    with pytest.raises(ValueError):
        write_cleaned(df, str(tmp_path / "x"), "xlsx")
    for run in ("r1", "r2", "r1"):
        paths = write_results({"kinds": df}, str(tmp_path), run)
    assert rows(spark.read.parquet(paths["kinds"]).groupBy("run_id").count()) == [("r1", 2), ("r2", 2)]


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A failure between two tables, and one between the commit and the last move."""
    from rowlens.sources import sinks

    folder = str(tmp_path / "results")
    old = {name: spark.createDataFrame([(1, "old")], "k int, t string") for name in ("a", "b")}
    new = {name: spark.createDataFrame([(2, "new")], "k int, t string") for name in ("a", "b")}
    write_results(old, folder, "run 1/x")
    write_results(old, folder, "other")
    broken = new["b"].withColumn("t", F.raise_error(F.lit("no table")))
    with pytest.raises(Exception, match="no table"):
        write_results({"a": new["a"], "b": broken}, folder, "run 1/x")

    def seen(reader):
        return {name: sorted((r["run_id"], r["t"]) for r in reader(name).collect()) for name in ("a", "b")}

    def committed(name):
        return read_results(spark, folder, name)

    before = {name: [("other", "old"), ("run 1/x", "old")] for name in ("a", "b")}
    assert seen(committed) == seen(lambda name: spark.read.parquet(f"{folder}/{name}")) == before
    publish, moved = sinks._publish, []

    def stopped(files, path, table, run_id, attempt):
        if moved:
            raise OSError("stopped")
        moved.append(table)
        publish(files, path, table, run_id, attempt)

    monkeypatch.setattr(sinks, "_publish", stopped)
    with pytest.raises(OSError, match="stopped"):
        write_results(new, folder, "run 1/x")
    after = {name: [("other", "old"), ("run 1/x", "new")] for name in ("a", "b")}
    assert seen(committed) == after
    monkeypatch.setattr(sinks, "_publish", publish)
    write_results(new, folder, "run 1/x")
    assert seen(committed) == seen(lambda name: spark.read.parquet(f"{folder}/{name}")) == after
    with pytest.raises(FileNotFoundError):
        read_results(spark, folder, "none")


def test_scratch_is_cleared(spark):
    import os

    staged = stage_table(spark.range(10), "gone")
    place = staged.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place)
    clear_scratch(spark)
    assert not os.path.exists(place)


def test_staged_table_lies_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured.rstrip("/")
    assert scratch_path(spark, "x").startswith(folder)
    staged = stage_table(spark.range(10))
    assert folder in staged.inputFiles()[0] and staged.count() == 10
