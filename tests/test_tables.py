"""Table reshaping, joins, groups and checks of a table."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from regioflux.operators import groups, profile, tables


def test_rename_by_name_and_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert tables.rename(df, {"a": "x", 3: "z"}).columns == ["x", "b", "z"]


def test_token_and_numbers(spark):
    df = spark.createDataFrame([("-", "1", 5), ("y", "-", 6), ("z", "x", 7)], "a string, b string, n int")
    clean = tables.token_to_null(df)
    assert rows(clean) == [(None, "1", 5), ("y", None, 6), ("z", "x", 7)]
    assert rows(tables.to_numbers(clean.na.drop("any"), ["b"])) == [("z", None, 7)]


def test_split_exact(spark):
    df = spark.createDataFrame([(1, "3.5, -7"), (2, None)], "i int, Source string")
    split = tables.split_exact(df, "Source", ["lat", "lon"])
    assert split.columns == ["i", "lat", "lon"]
    assert rows(split) == [(1, "3.5", " -7"), (2, None, None)]
    assert rows(tables.points_from_text(df)) == [(1, 3.5, -7.0), (2, None, None)]
    with pytest.raises(PySparkException, match="expected 2 pieces"):
        bad = spark.createDataFrame([("1,2,3",)], "Source string")
        tables.split_exact(bad, "Source", ["lat", "lon"]).collect()


def test_points_off_the_globe_are_kept(spark):
    df = spark.createDataFrame([("91,10",), ("10,-181",)], "Source string")
    assert rows(tables.points_from_text(df)) == [(10.0, -181.0), (91.0, 10.0)]


def test_stacking(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert rows(tables.stack([a, b], strict=True)) == [(1, "x"), (2, "y")]
    c = spark.createDataFrame([(3,)], "n int")
    assert rows(tables.stack([a, c])) == [(1, "x"), (3, None)]
    with pytest.raises(PySparkException):
        tables.stack([a, c], strict=True).collect()


def test_unpivot_keeps_missing_and_reverses_a_pivot(spark):
    wide = spark.createDataFrame([("a", 1, None), ("b", 3, 4)], "k string, x int, y int")
    long = tables.unpivot(wide, ["k"], "name", "value")
    assert rows(long) == [("a", "x", 1), ("a", "y", None), ("b", "x", 3), ("b", "y", 4)]
    back = long.groupBy("k").pivot("name", ["x", "y"]).agg(F.max("value"))
    assert rows(back) == rows(wide)


def test_left_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "r string, m int")
    joined = tables.left_join(left, right, {"k": "r"})
    assert joined.columns == ["k", "n", "m"]
    assert rows(joined) == [(None, 2, 20), ("a", 1, 10), ("c", 3, None)]


def test_natural_left_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "i int, k string, v int")
    right = spark.createDataFrame([("a", 1, 9)], "k string, i int, w int")
    assert rows(tables.natural_left_join(left, right), "i", "k", "v", "w") == [(1, "a", 5, 9), (2, "b", 6, None)]
    with pytest.raises(ValueError):
        tables.natural_left_join(left, spark.range(1))


def test_expand_left_join_equals_left_join(spark):
    regions = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    events = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("c", "y"), (None, "z")], "k string, e string"
    )
    found = tables.expand_left_join(regions, events, "k")
    assert found.columns == ["k", "n", "e"]
    assert rows(found) == rows(regions.join(events, "k", "left"))


def test_keep_regions_by_values_or_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(tables.keep_regions(df, "k", ["b"])) == [("b",)]
    many = spark.createDataFrame([("b",), ("b",)], "r string")
    assert rows(tables.keep_regions(df, "k", many)) == [("b",)]


def test_incidents(spark):
    data = [
        (1, "TX", 2009, "Fire", "A"), (2, "TX", 2010, "Fire", "A"), (2, "TX", 2010, "Flood", "B"),
        (3, "PR", 2011, "Fire", "C"), (4, None, 2012, "Fire", "D"), (5, "TX", None, "Fire", "E"),
    ]
    df = spark.createDataFrame(
        data, "disasterNumber int, STUSPS string, fyDeclared int, incidentType string, designatedArea string"
    )
    recent = groups.recent_incidents(df, 2010)
    assert rows(groups.incident_totals(recent, ["PR"])) == [(None, 1.0), ("TX", 2.0)]
    counts = [tuple(r) for r in groups.incident_counts(recent).collect()]
    assert counts == [("PR", "Fire", 1), ("TX", "Fire", 1), ("TX", "Flood", 1), (None, "Fire", 1)]
    wide = groups.count_wide(recent, "STUSPS", "incidentType", ["Fire", "Flood"])
    assert rows(wide) == [(None, 1, 0), ("PR", 1, 0), ("TX", 1, 1)]
    assert groups.count_wide(recent, "STUSPS", "incidentType").columns == ["STUSPS", "Fire", "Flood"]
    assert rows(groups.count_wide(recent, "STUSPS", "incidentType", ["Fire"], rest="other")) == [(None, 1, 0), ("PR", 1, 0), ("TX", 1, 1)]
    with pytest.raises(PySparkException, match="unlisted value of incidentType: Flood"):
        groups.count_wide(recent, "STUSPS", "incidentType", ["Fire"]).collect()
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError, match="more than 1 values"):
            groups.count_wide(recent, "STUSPS", "incidentType")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_group_measures(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", None, 2), ("b", None, 1)], "k string, x double, w int")
    assert rows(groups.group_totals(df, ["k"], {"s": "x", "t": "w"})) == [("a", 1.0, 4), ("b", 0.0, 1)]
    assert rows(groups.group_mean(df, "k", "x", "m")) == [("a", 1.0), ("b", None)]
    weighted = groups.group_weighted(df, ["k"], "x", "w", ("m", "t", "n"))
    assert rows(weighted) == [("a", 1.0, 4, 2), ("b", None, 1, 1)]


def test_numeric_summary(spark):
    df = spark.createDataFrame(
        [(float(v), None) for v in (1, 2, 3, 4, 10)] + [(None, 7), (float("nan"), 7)], "x double, y int"
    )
    found = {r["field"]: r for r in profile.numeric_summary(df, ["x", "y"]).collect()}
    x = found["x"]
    assert (x["min"], x["q1"], x["median"], x["mean"], x["q3"], x["max"]) == (1, 2, 3, 4, 4, 10)
    assert (x["n"], x["missing"]) == (5, 2)
    assert (found["y"]["q1"], found["y"]["n"], found["y"]["missing"]) == (7, 2, 5)


def test_numeric_summary_interpolates_and_survives_emptiness(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    found = {r["field"]: r for r in profile.numeric_summary(df, ["x", "y"]).collect()}
    assert (found["x"]["q1"], found["x"]["median"], found["x"]["q3"]) == (1.25, 1.5, 1.75)
    assert (found["y"]["min"], found["y"]["mean"], found["y"]["n"], found["y"]["missing"]) == (None, None, 0, 2)


def test_levels_and_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "s string, n int")
    assert rows(profile.level_counts(df, ["s"])) == [("s", None, 1), ("s", "a", 2)]
    assert profile.missing_counts(df).collect()[0].asDict() == {"s": 1, "n": 1, "any_missing": True}
    assert profile.missing_counts(df.where("false")).collect()[0].asDict() == {
        "s": 0, "n": 0, "any_missing": False,
    }


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", None)] * 8 + [("b", 1)] * 2 + [("c", 2)], "s string, n int")
    for chunk in (1, 3, 7, 10000):
        assert rows(profile.repeated_rows(df, chunk)) == [("a", None)] * 7 + [("b", 1)]
    assert profile.repeated_rows(df.where("s = 'c'")).count() == 0
