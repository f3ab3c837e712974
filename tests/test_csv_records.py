"""CSV files with line breaks inside values, read by small byte ranges, against Python's csv module."""

from __future__ import annotations

import csv
import io
import random
from contextlib import contextmanager

import pytest

from rowlens.sources.records import Borders, csv_records, find_borders, text_lines
from rowlens.sources.tables import LoadError, load_csv

PIECES = ["x", '"', "\n", "\r\n", ",", "é", "日本", " ", "a\nb", '""', "1", "", "\n\n", "word"]


@contextmanager
def settings(spark, **conf):
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_ranges(spark, size):
    return settings(
        spark, **{"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    )


def written(path, rows, ending="\n", encoding="utf-8"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))
    return str(path)


def some_rows(seed, n):
    pick = random.Random(seed)
    return [
        (f"k{k}", "".join(pick.choice(PIECES) for _ in range(pick.randrange(9))).replace("\r\n", "\n").strip() or "v",
         "z" + "".join(pick.choice(PIECES) for _ in range(pick.randrange(5))).replace("\r\n", "\n") + "z")
        for k in range(n)
    ]


@pytest.mark.parametrize(("size", "ending"), [(40, "\n"), (97, "\r\n"), (700, "\n"), (1 << 20, "\r\n")])
def test_any_ranges_give_the_same_rows(spark, tmp_path, size, ending):
    rows = some_rows(size, 300)
    path = written(tmp_path / "t.csv", [("key", "first\nname", "last")] + rows, ending)
    with small_ranges(spark, size):
        lines = text_lines(spark, path)
        borders = find_borders(lines)
        assert borders.broken
        if size < 1000:
            assert lines.rdd.getNumPartitions() > 8 and borders.crossed
        found = load_csv(spark, path)
        assert found.columns == ["key", "first\nname", "last"]
        got = sorted(map(tuple, found.collect()))
    assert got == sorted(rows)


def test_a_value_longer_than_ranges(spark, tmp_path):
    rows = [("a", "\n".join(["long"] * 500)), ("b", "short"), ("c", "\n" * 400 + "end")]
    path = written(tmp_path / "t.csv", [("k", "v")] + rows)
    with small_ranges(spark, 100):
        assert sorted(map(tuple, load_csv(spark, path).collect())) == rows


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "all.csv"
    folder.mkdir()
    rows = some_rows(5, 90)
    for k in range(3):
        written(folder / f"{k}.csv", [("key", "a", "b")] + rows[k::3])
    with small_ranges(spark, 120):
        assert sorted(map(tuple, load_csv(spark, str(folder)).collect())) == sorted(rows)


def test_no_breaks_no_python(spark, tmp_path):
    path = written(tmp_path / "t.csv", [("a", "b")] + [(f"x{k}", "p, q") for k in range(20)])
    assert find_borders(text_lines(spark, path)).broken is False
    plan = load_csv(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan


def test_unbalanced_quote_at_the_end(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"open\nto the end\n')
    with small_ranges(spark, 20):
        got = sorted(map(tuple, load_csv(spark, str(path)).collect()))
    assert got[0] == (1, "x\ny") and got[1][0] == 2 and got[1][1].strip().endswith("end")


def test_latin1_blank_lines_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('\n\nnäme,b\n\n"caf\né",1\n   \n"x",\n"only"\n'.encode("latin1"))
    with small_ranges(spark, 8):
        found = load_csv(spark, str(path))
        assert found.columns == ["näme", "b"]
        got = sorted(map(tuple, found.collect()), key=str)
    assert got == [("caf\né", 1), ("only", None), ("x", None)]
    wide = tmp_path / "w.csv"
    wide.write_text('a,b\n"x\ny",1\n"p\nq",1,2\n')
    with small_ranges(spark, 8), pytest.raises(LoadError, match="1 row.s. .* more fields"):
        load_csv(spark, str(wide))


def test_lone_carriage_returns_are_read_whole(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\r"x\ny",1\rz,2\r', newline="")
    assert find_borders(text_lines(spark, str(path))).lone_returns
    assert sorted(map(tuple, load_csv(spark, str(path)).collect())) == [("x\ny", 1), ("z", 2)]


def test_other_ranges_than_counted_are_refused(spark, tmp_path):
    path = written(tmp_path / "t.csv", [("a", "b")] + some_rows(1, 50)[:50])
    lines = text_lines(spark, path)
    with pytest.raises(Exception, match="other byte ranges"):
        csv_records(lines, Borders(broken=True, starts={})).count()
