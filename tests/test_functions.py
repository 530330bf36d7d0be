"""Missing-value rules, text cleaning and classes, each with hand-computed results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from regioflux.functions import classes, missing, text
from regioflux.functions.regions import FIFTY_STATES, MAP_STATES, RUST_BELT, SURVEY_STATES


def values(spark, *items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")


def applied(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_membership_is_never_missing(spark):
    df = values(spark, "a", "b", None)
    assert applied(df, missing.in_set(F.col("x"), ["a"])) == [True, False, False]
    assert applied(df, missing.not_in(F.col("x"), ["a"])) == [False, True, True]


def test_negated_membership_is_pushed_below_an_aggregate(spark, tmp_path):
    values(spark, "a", "b", None).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.groupBy("x").count().where(missing.not_in(F.col("x"), ["a"]))
    text_ = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_.index("Aggregate") < text_.index("Filter")


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "k string, x double")
    assert rows(df.groupBy("k").agg(missing.sum0(F.col("x")).alias("s"))) == [("a", 0.0), ("b", 2.0)]
    assert df.where("false").agg(missing.sum0(F.col("x"))).collect()[0][0] == 0


def test_nan_is_missing(spark):
    df = values(spark, float("nan"), 80.0, None, kind="double")
    assert applied(missing.nan_free(df), F.col("x")) == [None, 80.0, None]


def test_weighted_mean(spark):
    data = [
        ("plain", 10.0, 1), ("plain", 20.0, 3),
        ("no value", None, 5), ("no value", 4.0, 1),
        ("no weight", 1.0, None), ("no weight", 2.0, 1),
        ("weight missing beside value", None, None), ("weight missing beside value", 6.0, 2),
        ("zero weight", 3.0, 0),
        ("empty", None, 2),
    ]
    df = spark.createDataFrame(data, "k string, x double, w int")
    found = dict(rows(df.groupBy("k").agg(missing.weighted_mean(F.col("x"), F.col("w")))))
    assert found == {
        "plain": 17.5,
        "no value": 4.0,
        "no weight": None,
        "weight missing beside value": 6.0,
        "zero weight": None,
        "empty": None,
    }


def test_lenient_numbers(spark):
    df = values(spark, " 12 ", "1e3", "-.5", "5d", "5f", "abc", "", None, "NaN", "0x1A", "3.", "1,2")
    wanted = [12.0, 1000.0, -0.5, None, None, None, None, None, None, None, 3.0, None]
    assert applied(df, text.to_number(F.col("x"))) == wanted


def test_clean_count(spark):
    df = values(spark, "\t1,234,567 \r\n", "N/A", " NA ", "", "12", "+/-5")
    assert applied(df, text.clean_count(F.col("x"))) == [1234567.0, None, None, None, 12.0, None]


def test_paste_prints_missing_values(spark):
    df = values(spark, "a", None)
    assert applied(df, text.paste(F.col("x"), F.lit("TX"), sep=", ")) == ["a, TX", "NA, TX"]


def test_suffixes(spark):
    names = ("Cook County", "Orleans Parish", "Sitka City and Borough", "Nome Census Area", "County Line")
    df = values(spark, *names, "Anchorage Municipality", "Kings County County")
    kept = ["Cook", "Orleans", "Sitka City and", "Nome", "County Line", "Anchorage", "Kings County"]
    assert applied(df, text.strip_suffixes(F.col("x"))) == kept
    kept[2] = "Sitka"
    assert applied(df, text.strip_suffixes(F.col("x"), longest_first=True)) == kept


def test_codes_and_number_labels(spark):
    df = values(spark, "1001", "36061", "123456", None)
    assert applied(df, text.pad_code(F.col("x"), 5)) == ["01001", "36061", "123456", None]
    numbers = values(spark, 1234567.0, 2.5, -3.0, None, kind="double")
    assert applied(numbers, text.number_text(F.col("x"))) == ["1234567", "2.5", "-3", None]
    assert applied(numbers, text.thousands(F.col("x")))[0] == "1,234,567"


def test_header_names():
    given = ["Name", "Economic & Productivity Losses", "2020", "a b", "a.b", "", "_x", ".5", ".ok"]
    assert text.sanitize_names(given) == [
        "Name", "Economic...Productivity.Losses", "X2020", "a.b", "a.b.1", "X", "X_x", "X.5", ".ok",
    ]


def test_percentile_rating_edges(spark):
    df = values(spark, 0.0, 19.99, 20.0, 40.0, 60.0, 80.0, 100.0, None, kind="double")
    wanted = ["Very Low", "Very Low", "Low", "Moderate", "High", "Very High", "Very High", None]
    assert applied(df, classes.percentile_rating(F.col("x"))) == wanted


def test_threshold_rating_edges(spark):
    df = values(spark, 0, 100, 101, 500, 501, 1000, 1001, 2000, 2001, None, kind="int")
    wanted = ["Very Low", "Very Low", "Low", "Low", "Moderate", "Moderate", "High", "High", "Very High", None]
    assert applied(df, classes.threshold_rating(F.col("x"))) == wanted


def test_bins_are_left_closed(spark):
    df = values(spark, -10001.0, -10000.0, -1000.0, 999.0, 1000.0, 10000.0, None, kind="double")
    assert applied(df, classes.bin_index(F.col("x"))) == [1, 2, 3, 3, 4, 5, None]
    labels = applied(df, classes.bin_label(F.col("x")))
    assert labels[0] == "Less than -10,000"
    assert labels[-2:] == ["10,000 or more", None]


def test_levels(spark):
    df = values(spark, "Very Low", "High", "No Rating", None)
    assert applied(df, classes.ordinal(F.col("x"))) == [1, 4, None, None]
    assert applied(df, classes.ordinal(F.col("x"), reverse=True)) == [5, 2, None, None]
    assert applied(df, classes.factor(F.col("x"))) == ["Very Low", "High", None, None]


@pytest.mark.parametrize(
    ("regions", "size"), [(FIFTY_STATES, 50), (MAP_STATES, 51), (SURVEY_STATES, 52), (RUST_BELT, 7)]
)
def test_region_sets(regions, size):
    assert len(set(regions)) == len(regions) == size
