"""Ranks against the built-in window functions and against hand-computed cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from regioflux.operators import ranks


def builtin(df, column, key="i"):
    present = df.where(F.col(column).isNotNull())
    ranked = present.select(
        key, (F.percent_rank().over(Window.orderBy(column)) * 100.0).alias("p")
    )
    return df.select(key).join(ranked, key, "left")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shape", ["ties", "spread", "hot"])
def test_equals_builtin_percent_rank(spark, seed, shape):
    rng = random.Random(seed)
    draw = {
        "ties": lambda: rng.choice([None, 1.0, 2.0, 3.0]),
        "spread": lambda: rng.choice([None, rng.gauss(0, 1e6)]),
        "hot": lambda: 7.0 if rng.random() < 0.4 else rng.uniform(-10, 10),
    }[shape]
    df = spark.createDataFrame([(i, draw()) for i in range(500)], "i int, x double")
    assert rows(ranks.add_percent_rank(df, "x", "p"), "i", "p") == rows(builtin(df, "x"), "i", "p")


def test_several_columns_at_once(spark):
    rng = random.Random(5)
    data = [(f"r{i}", rng.randint(0, 20), rng.choice([None, rng.randint(0, 5)])) for i in range(200)]
    df = spark.createDataFrame(data, "i string, a long, b long")
    found = ranks.add_percent_ranks(df, "i", ["a", "b"])
    assert found.columns == ["i", "a", "b", "a_percentile", "b_percentile"]
    for c in ("a", "b"):
        assert rows(found, "i", f"{c}_percentile") == rows(builtin(df, c), "i", "p")


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ([5.0], [None]),
        ([None, None], [None, None]),
        ([3.0, 3.0, 3.0], [0.0, 0.0, 0.0]),
        ([1.0, None, 2.0, float("nan")], [0.0, None, 100.0, None]),
        ([], []),
    ],
)
def test_small_cases(spark, given, wanted):
    df = spark.createDataFrame(list(enumerate(given)), "i int, x double")
    assert [p for _, p in rows(ranks.add_percent_rank(df, "x", "p"), "i", "p")] == wanted


def test_long_integers_keep_their_order(spark):
    big = 2**53
    df = spark.createDataFrame([(0, big), (1, big + 1), (2, big + 2)], "i int, x long")
    assert rows(ranks.add_percent_rank(df, "x", "p"), "i", "p") == [(0, 0.0), (1, 50.0), (2, 100.0)]


def test_top_with_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 4), ("e", 1), ("f", None)], "k string, x int")
    assert rows(ranks.top_with_ties(df, "x", 2), "k") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(ranks.top_with_ties(df, "x", 4), "k") == [("a",), ("b",), ("c",), ("d",)]
    assert ranks.top_with_ties(df, "x", 5).count() == 5
    assert ranks.top_with_ties(df, "x", 6).count() == 6
    assert ranks.top_with_ties(df.where("false"), "x", 6).count() == 0


def test_top_per_group(spark):
    df = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 0, "c"), ("h", 9, "z")], "g string, x int, k string")
    order = [F.desc_nulls_last("x"), F.asc("k")]
    assert rows(ranks.top_per_group(df, "g", order, 2)) == [("g", 1, "a"), ("g", 1, "b"), ("h", 9, "z")]
    assert rows(ranks.top_per_group(df, "g", order, 1)) == [("g", 1, "a"), ("h", 9, "z")]


def test_head_and_tail(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", None), ("e", 0)], "k string, x int")
    keys = ["k"]
    assert [r["k"] for r in ranks.head(df, "x", keys, 2).collect()] == ["b", "c"]
    assert [r["k"] for r in ranks.tail(df, "x", keys, 3).collect()] == ["a", "e", "d"]
    assert [r["k"] for r in ranks.sorted_desc(df, "x", keys).collect()] == ["b", "c", "a", "e", "d"]


def test_repeated_key_is_an_error(spark):
    df = spark.createDataFrame([("k", 1), ("k", 5), ("m", 3)], "key string, x int")
    with pytest.raises(Exception, match="repeated key: k"):
        ranks.add_percent_ranks(df, "key", ["x"]).collect()


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_levels_hold_the_bins():
    assert ranks._levels(32) == [32] and ranks._levels(512) == [512]
    assert ranks._levels(513) == [23, 23] and ranks._levels(512**2) == [512, 512]
    for bins in (4, 600, 40_000, 300_000, 10**7):
        levels = ranks._levels(bins)
        assert max(levels) <= ranks.WIDEST and levels[0] ** len(levels) >= bins


def test_bins_of_several_levels_are_even_and_ordered(many_partitions, monkeypatch):
    """A million values bunched at one end: no bin holds more than a few times the mean, whatever the number of levels."""
    n = 1_000_000
    skewed = many_partitions.range(n).select(F.exp(F.col("id") / 1e5).alias("x"))
    hist = ranks.histogram(skewed, ["x"])
    for widest, fewest in ((512, 500), (32, 500), (8, 450)):
        monkeypatch.setattr(ranks, "WIDEST", widest)
        found = ranks.binned(hist, ["x"]).groupBy("bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        held = found.orderBy("bin").collect()
        assert len(held) >= fewest and sum(r.n for r in held) == n
        assert max(r.n for r in held) < 3 * n / len(held)
        assert all(a.high < b.low for a, b in zip(held, held[1:]))


@pytest.mark.parametrize("widest", [2, 6])
def test_ranks_do_not_depend_on_levels(spark, monkeypatch, widest):
    monkeypatch.setattr(ranks, "WIDEST", widest)
    rng = random.Random(widest)
    data = [(f"r{i}", rng.choice([None, 7.0, 7.0, rng.gauss(0, 1e6)]), rng.choice([None, float(rng.randint(0, 5))])) for i in range(300)]
    df = spark.createDataFrame(data, "i string, a double, b double")
    found = ranks.add_percent_ranks(df, "i", ["a", "b"])
    for c in ("a", "b"):
        assert rows(found, "i", f"{c}_percentile") == rows(builtin(df, c), "i", "p")
        assert rows(ranks.add_percent_rank(df, c, "p"), "i", "p") == rows(builtin(df, c), "i", "p")
