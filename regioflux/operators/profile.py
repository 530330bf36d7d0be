"""Checks of a table: column summaries, missing values, repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioflux.operators.ranks import cumulate, histogram, long_values

QUARTERS = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
COPIES_PER_ROW = 10000


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, min, q1, median, mean, q3, max, n, missing) with exact, interpolated quartiles.

    Quartiles come from the cumulated histogram: only the values at the needed positions, at most two per
    quartile, reach the final step.
    """
    hist = histogram(df, columns)
    totals = hist.groupBy("field").agg(
        F.try_divide(
            F.sum(F.col("value").cast("double") * F.col("copies")),
            F.sum(F.when(F.col("value").isNotNull(), F.col("copies"))),
        ).alias("mean"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("copies")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("copies")).otherwise(0)).alias("missing"),
    )
    ranked = cumulate(hist, columns)
    value = F.col("value").cast("double")
    held_to = F.col("below") + F.col("copies")

    def holds(position: Column) -> Column:
        return (F.col("below") <= position) & (position < held_to)

    def place(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(p)

    needed = F.lit(False)
    picks = []
    for name, p in QUARTERS.items():
        low, high = F.floor(place(p)), F.ceil(place(p))
        needed = needed | holds(low) | holds(high)
        picks += [
            F.max(F.when(holds(low), value)).alias(f"{name}_low"),
            F.max(F.when(holds(high), value)).alias(f"{name}_high"),
        ]
    at = ranked.where(needed).groupBy("field").agg(F.max("total").alias("total"), *picks)
    quarters = at.select(
        "field",
        *[
            (
                F.col(f"{name}_low")
                + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place(p) - F.floor(place(p)))
            ).alias(name)
            for name, p in QUARTERS.items()
        ],
    )
    return totals.join(quarters, "field", "left").select(
        "field", "min", "q1", "median", "mean", "q3", "max", "n", "missing"
    )


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, level, n) for text columns; missing values form a level of their own."""
    long = long_values(df, columns).withColumnRenamed("value", "level")
    return long.groupBy("field", "level").agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: the missing values of each column and whether there are any."""
    holes = {c: df[f"`{c}`"].isNull() for c in df.columns}
    some = F.lit(False)
    for hole in holes.values():
        some = some | hole
    return df.agg(
        *[F.count_if(hole).alias(c) for c, hole in holes.items()],
        F.coalesce(F.bool_or(some), F.lit(False)).alias("any_missing"),
    )


def repeated_rows(df: DataFrame, chunk: int = COPIES_PER_ROW) -> DataFrame:
    """The second and later copies of every row.

    Equal rows are folded into a count first. The copies come back in two steps, chunks and then rows,
    with a shuffle of the chunks between, so that even a row with very many copies is spread out.
    """
    columns = [f"`{c}`" for c in df.columns]
    extra = df.groupBy(*columns).agg((F.count("*") - 1).alias("_extra")).where("_extra > 0")
    chunks = extra.select(
        *columns,
        "_extra",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_extra") - 1) / chunk))).alias(
            "_chunk"
        ),
    ).repartition(*columns, "_chunk")
    left = F.least(F.lit(chunk), F.col("_extra") - F.col("_chunk") * chunk).cast("int")
    return chunks.select(*columns, F.explode(F.array_repeat(F.lit(0), left)).alias("_copy")).drop(
        "_copy"
    )
