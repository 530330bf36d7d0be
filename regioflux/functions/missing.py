"""Rules for missing values.

The analyses follow the conventions of statistical data frames, which differ from SQL: a negated
membership test keeps missing values, a sum over nothing is zero, a missing weight spoils its group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_nan(x: Column) -> Column:
    """NaN becomes null. Spark orders NaN above every number, so it must not reach a comparison."""
    return F.when(~F.isnan(x), x)


def nan_free(df: DataFrame) -> DataFrame:
    """Applies drop_nan to every floating-point column; use it where data enters."""
    floating = (T.DoubleType, T.FloatType)
    fixes = {
        f.name: drop_nan(df[f"`{f.name}`"]) for f in df.schema if isinstance(f.dataType, floating)
    }
    return df.withColumns(fixes) if fixes else df


def in_set(x: Column, values: Iterable) -> Column:
    """Membership that is never null."""
    return F.coalesce(x.isin(*values), F.lit(False))


def not_in(x: Column, values: Iterable) -> Column:
    """Negated membership; a missing x is not in the set and stays."""
    return ~in_set(x, values)


def sum0(x: Column) -> Column:
    """Sum over the present values, zero if there is none."""
    return F.coalesce(F.sum(x), F.lit(0))


def weighted_mean(x: Column, weight: Column) -> Column:
    """sum(x*w) / sum(w) over rows with x; null if one of those rows has no weight, or on zero weight."""
    no_weight = F.count_if(x.isNotNull() & weight.isNull())
    product = F.sum(x.cast("double") * weight.cast("double"))
    total = F.sum(F.when(x.isNotNull(), weight.cast("double")))
    return F.when(no_weight == 0, F.try_divide(product, total))


def fill0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))
