"""Ranking without a single-task sort.

The rank of a row depends only on the histogram of the ranked column. So rows are first reduced to
(value, copies), which also folds a value held by many rows into one; the values are then cut into
ordered bins, and a running total inside each bin plus the total of the lower bins gives the number of rows
below each value. The cuts steer only the balance of the bins, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioflux.functions.missing import drop_nan

#: Cuts found in one pass. More bins than this are cut in several levels.
WIDEST = 512


def _bins(df: DataFrame) -> int:
    # A few bins per task even out what hashing the bins to tasks leaves uneven.
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _levels(bins: int) -> list[int]:
    """Bins of each level: as few levels as hold the given number, all of about the same width."""
    depth = 1
    while WIDEST**depth < bins:
        depth += 1
    width = math.ceil(round(bins ** (1 / depth), 9))
    return [width] * depth


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row (keep..., field, value) per row and listed column; NaN reads as missing.

    Several columns share the widest of their types, one column keeps its own.
    """
    floating = (T.DoubleType, T.FloatType)
    pairs = []
    for name in columns:
        value = df[f"`{name}`"]
        if isinstance(df.schema[name].dataType, floating):
            value = drop_nan(value)
        pairs.append(F.struct(F.lit(name).alias("field"), value.alias("value")))
    if len(pairs) == 1:
        return df.select(*keep, pairs[0].alias("p")).select(*keep, "p.field", "p.value")
    return df.select(*keep, F.inline(F.array(*pairs)))


def _keys(columns: Sequence[str]) -> list[str]:
    """The field is a key only among several columns. As a constant it would get in the way of sharing shuffles."""
    return ["field"] if len(columns) > 1 else []


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, copies); the row with a null value counts the missing ones."""
    counted = long_values(df, columns).groupBy(*_keys(columns), "value").agg(F.count("*").alias("copies"))
    return counted if len(columns) > 1 else counted.withColumn("field", F.lit(columns[0]))


def _place(cuts: Column) -> Column:
    """The number of cuts below the value, which grows with it; cuts may repeat."""
    # A number that cannot be null spares later joins a null filter, which would sink under the
    # histogram and evaluate the cuts once per row instead of once per value.
    return F.coalesce(F.array_position(F.sort_array(F.array_append(cuts, F.col("value"))), F.col("value")) - 1, F.lit(0))


def binned(hist: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The histogram's values that are not missing with their bin: ordered bins of about equally many values, a few for each shuffle partition.

    The first level's cuts come from the quantiles of each column, those of a further level from the quantiles inside each bin of the level
    before, so that no aggregate holds more than WIDEST cuts, however many partitions there are.
    """
    hist = hist.where(F.col("value").isNotNull())
    keys = _keys(columns)
    first, *further = _levels(_bins(hist))
    quantiles = lambda value, width: F.percentile_approx(value, [i / width for i in range(1, width)], max(1000, 4 * width))

    def cuts(name: str) -> Column:
        # The test on copies is always true. It keeps the column, so that this subquery and the
        # ranking below share one shuffle of the histogram.
        return quantiles(F.when((F.col("field") == name) & (F.col("copies") > 0), F.col("value")), first)

    entries = [part for name in columns for part in (F.lit(name), cuts(name))]
    by_field = hist.agg(F.create_map(*entries).alias("cuts")).scalar()
    placed = hist.withColumn("bin", _place(by_field[F.col("field")]))
    for width in further:
        inner = placed.groupBy(*keys, "bin").agg(quantiles(F.col("value"), width).alias("cuts"))
        # As many cuts as there are bins on this level, a few for each shuffle partition and ranked column.
        placed = placed.join(F.broadcast(inner), [*keys, "bin"])
        placed = placed.withColumn("bin", F.col("bin") * width + _place(F.col("cuts"))).drop("cuts")
    return placed


def cumulate(hist: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, copies, below, total) from a histogram; missing values are left out."""
    keys = _keys(columns)
    placed = binned(hist, columns).repartition(*keys, "bin")

    ordered = Window.partitionBy(*keys).orderBy("bin")
    offsets = (
        placed.groupBy(*keys, "bin")
        .agg(F.sum("copies").alias("held"), F.max("value").alias("last"))
        # Always true. It keeps the value, so that the totals and the running sums share the shuffle.
        .where(F.col("last").isNotNull())
        .select(
            *keys,
            "bin",
            (F.sum("held").over(ordered) - F.col("held")).alias("offset"),
            F.sum("held").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    inside = Window.partitionBy(*keys, "bin").orderBy("value")
    running = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("running", running)
        # One row per bin and field: a few per shuffle partition and ranked column.
        .join(F.broadcast(offsets), [*keys, "bin"])
        .select(
            "field",
            "value",
            "copies",
            (F.col("offset") + F.col("running") - F.col("copies")).alias("below"),
            "total",
        )
    )


def _percent(scale: float) -> Column:
    """(rank - 1) / (n - 1), undefined for a single value."""
    return F.try_divide(F.col("below"), F.col("total") - 1) * scale


def add_percent_rank(df: DataFrame, column: str, name: str, scale: float = 100.0) -> DataFrame:
    """Adds the percent rank of a column over the whole table, ties sharing the lowest rank.

    Missing values get no rank and do not count. Works on any rows; no key is needed.
    """
    ranks = cumulate(histogram(df, [column]), [column]).select(
        F.col("value").alias("_value"), _percent(scale).alias(name)
    )
    return df.join(ranks, df[f"`{column}`"] == ranks["_value"], "left").drop("_value")


def add_percent_ranks(
    df: DataFrame, key: str, columns: Sequence[str], suffix: str = "_percentile", scale: float = 100.0
) -> DataFrame:
    """Percent ranks of several columns in one set of shuffles; key must identify the rows, a repeated one is an error.

    The table is read three times.
    """
    ranks = cumulate(histogram(df, columns), columns).select(
        "field", "value", _percent(scale).alias("pct")
    )
    scored = long_values(df, columns, [key]).join(ranks, ["field", "value"], "left")
    repeated = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("double")
    wide = scored.groupBy(key).agg(
        *[
            F.when(F.count_if(F.col("field") == c) > 1, repeated)
            .otherwise(F.max(F.when(F.col("field") == c, F.col("pct"))))
            .alias(c + suffix)
            for c in columns
        ]
    )
    return df.join(wide, key, "left")


def top_with_ties(df: DataFrame, column: str, n: int) -> DataFrame:
    """All rows among the n largest values, ties at the limit included.

    A row qualifies if and only if it reaches the n-th largest value, so a filter replaces the rank
    and no task has to hold the ties. Missing values count as smallest.
    """
    best = df.select(column).orderBy(F.desc_nulls_last(column)).limit(n)
    limit = best.agg(F.struct(F.min(column).alias("low"), F.count(column).alias("found"))).scalar()
    value = df[column]
    chosen = (value >= limit["low"]) | (value.isNull() & (limit["found"] < n))
    return df.where(chosen)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """Exactly n rows per group (all if fewer) in the given order.

    Each map task already cuts its groups to n rows, so a hot group sends little through the shuffle.
    """
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= n).drop("_position")


def sorted_desc(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *[F.asc_nulls_last(k) for k in keys])


def head(df: DataFrame, column: str, keys: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows of the descending order; equal values stand in key order."""
    return sorted_desc(df, column, keys).limit(n)


def tail(df: DataFrame, column: str, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Last n rows of the descending order, still in that order."""
    last = df.orderBy(F.asc_nulls_first(column), *[F.desc_nulls_first(k) for k in keys]).limit(n)
    return sorted_desc(last, column, keys)
