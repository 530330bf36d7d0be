"""Grouped measures. All of them combine map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioflux.functions.missing import not_in, sum0, weighted_mean


def group_totals(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Null-safe sums {result: column} over one key, all in the same pass."""
    return df.groupBy(*keys).agg(*[sum0(df[c]).alias(name) for name, c in sums.items()])


def group_mean(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(df[column]).alias(name))


def group_weighted(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, names: Sequence[str]
) -> DataFrame:
    """Weighted mean, weight total and row count; names gives the three result columns."""
    mean, total, rows = names
    return df.groupBy(*keys).agg(
        weighted_mean(df[value], df[weight]).alias(mean),
        sum0(df[weight]).alias(total),
        F.count(F.lit(1)).alias(rows),
    )


def recent_incidents(df: DataFrame, since: int) -> DataFrame:
    """Incident rows from the given fiscal year on, each with the constant weight 1."""
    return df.where(df["fyDeclared"] >= since).withColumn("incidentNumber", F.lit(1.0))


def incident_totals(incidents: DataFrame, dropped: Sequence[str]) -> DataFrame:
    """Number of declared areas per state without the dropped codes; a missing code is kept."""
    totals = incidents.groupBy("STUSPS").agg(sum0(F.col("incidentNumber")).alias("TotalDisasters"))
    return totals.where(not_in(totals["STUSPS"], dropped))


def incident_counts(incidents: DataFrame) -> DataFrame:
    """Rows per state and type, ordered by state, then most frequent first."""
    counts = incidents.groupBy("STUSPS", "incidentType").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(
        F.asc_nulls_last("STUSPS"), F.desc_nulls_last("n"), F.asc_nulls_last("incidentType")
    )


def count_wide(
    df: DataFrame,
    key: str,
    column: str,
    values: Mapping[str, str] | Sequence[str] | None = None,
    sums: Mapping[str, str] | None = None,
    rest: str | None = None,
) -> DataFrame:
    """Rows per key with one count column per value, 0 where there is none.

    values is a list, or {value: column name}; without it all values that occur get a column, and more of them than
    spark.sql.pivotMaxValues are an error, as for a pivot. A value that is not listed is
    counted in the column named by rest, and is an error if there is none. sums {result: column} adds null-safe totals to the
    same pass. Conditional counts need one shuffle, a pivot two.
    """
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        values = sorted(r[0] for r in df.select(column).distinct().na.drop().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values (spark.sql.pivotMaxValues)")
    labels = values if isinstance(values, Mapping) else {v: v for v in values}
    other = not_in(df[column], list(labels)) & df[column].isNotNull()
    if rest is None:
        unlisted = F.raise_error(F.concat(F.lit(f"unlisted value of {column}: "), df[column].cast("string")))
        df = df.withColumn(column, F.when(other, unlisted.cast(df.schema[column].dataType)).otherwise(df[column]))
    counts: list[Column] = [
        F.count_if(F.col(column) == value).alias(name) for value, name in labels.items()
    ]
    totals = [sum0(df[c]).alias(name) for name, c in (sums or {}).items()]
    if rest is not None:
        counts.append(F.count_if(other).alias(rest))
    return df.groupBy(key).agg(*totals, *counts)
