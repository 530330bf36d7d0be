"""Types told from CSV files, and malformed records."""

from __future__ import annotations

import datetime

import pytest

from conftest import rows
from regioflux.sources.typed_csv import column_types, read_typed_csv


@pytest.mark.parametrize(
    ("texts", "wanted"),
    [
        (["1", "-20", None], "bigint"),
        (["1", "9223372036854775807"], "bigint"),
        (["1", "9223372036854775808"], "string"),
        (["1", "2.5", ".5", "3e4", "7."], "double"),
        (["1234567890123456", "2.5"], "string"),
        (["123456789012345", "2.5"], "double"),
        (["01", "02"], "string"),
        (["0", "10"], "bigint"),
        (["0.5", "00.5"], "double"),
        (["true", "FALSE"], "boolean"),
        (["true", "1"], "string"),
        (["2020-02-29", "2021-01-01"], "date"),
        (["2021-02-29"], "string"),
        (["2020-02-29", "2021-01-01 10:20:30"], "timestamp_ntz"),
        (["2020-02-29", "5"], "string"),
        (["1d", "2f"], "string"),
        (["NaN"], "string"),
        ([None, None], "string"),
        ([], "string"),
        (["1\n", " 2"], "string"),
    ],
)
def test_least_type_that_loses_nothing(spark, texts, wanted):
    df = spark.createDataFrame([(t,) for t in texts], "`a.b` string")
    assert column_types(df) == {"a.b": wanted}


def test_files_with_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Code,Wild fires & smoke,Day\n01,1,2020-01-02\n02,NA,2020-01-03\n')
    (tmp_path / "b.csv").write_text('Code,Wild fires & smoke,Day\n"10, ""x""",2.5,\n11,3\n12,4,2020-01-04,more\n')
    found = read_typed_csv(spark, str(tmp_path))
    assert found.types == {"Code": "string", "Wild.fires...smoke": "double", "Day": "date"}
    day = lambda d: datetime.date(2020, 1, d)
    assert rows(found.rows) == [("01", 1.0, day(2)), ("02", None, day(3)), ('10, "x"', 2.5, None)]
    assert rows(found.malformed) == [("11,3",), ("12,4,2020-01-04,more",)]
    # Any choice of columns leaves the malformed records out.
    assert rows(found.rows, "Code") == [("01",), ("02",), ('10, "x"',)]
    assert found.rows.count() == 3 and found.malformed.count() == 2


def test_a_rare_text_in_a_late_file_decides(spark, tmp_path):
    spark.range(10_000).selectExpr("cast(id as string) as value").repartition(4).write.text(str(tmp_path / "t"))
    assert read_typed_csv(spark, str(tmp_path / "t"), ["n"]).types == {"n": "bigint"}
    (tmp_path / "t" / "zz.txt").write_text("n/a\n")
    assert read_typed_csv(spark, str(tmp_path / "t"), ["n"]).types == {"n": "string"}
    assert read_typed_csv(spark, str(tmp_path / "t"), ["n"], missing="n/a").types == {"n": "bigint"}


def test_lines_with_breaks_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"two\nlines"\n')
    found = read_typed_csv(spark, str(tmp_path), multi_line=True)
    assert rows(found.rows) == [(1, "two\nlines")] and found.types == {"k": "bigint", "t": "string"}
    (tmp_path / "b.csv").write_text("t,k\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_typed_csv(spark, str(tmp_path), multi_line=True).rows.collect()
    with pytest.raises(ValueError):
        read_typed_csv(spark, str(tmp_path), ["_malformed"])
