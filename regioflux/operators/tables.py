"""Reshaping and cleaning of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioflux.functions.missing import in_set
from regioflux.functions.text import to_number


def named(df: DataFrame, column: str) -> Column:
    """A column by its exact name, also one that holds dots."""
    return df[f"`{column}`"]


def rename(df: DataFrame, names: Mapping[str | int, str]) -> DataFrame:
    """Old name, or position counted from 1, to new name."""
    old = {(df.columns[k - 1] if isinstance(k, int) else k): v for k, v in names.items()}
    return df.withColumnsRenamed(old)


def all_but(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def token_to_null(df: DataFrame, token: str = "-") -> DataFrame:
    """The token becomes null in every text column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(named(df, c), F.lit(token)) for c in text})


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(named(df, c)) for c in columns})


def split_exact(df: DataFrame, column: str, names: Sequence[str], delim: str = ",") -> DataFrame:
    """Splits a text column into exactly len(names) columns and drops it; another count is an error."""
    source = named(df, column)
    pieces = F.split(source, f"\\Q{delim}\\E", -1)
    problem = F.raise_error(
        F.concat(F.lit(f"expected {len(names)} pieces in {column}: "), source)
    ).cast("array<string>")
    checked = F.when(source.isNull() | (F.size(pieces) == len(names)), pieces).otherwise(problem)
    parts = {name: F.get(checked, F.lit(i)) for i, name in enumerate(names)}
    kept: list[Column] = []
    for c in df.columns:
        if c == column:
            kept += [value.alias(name) for name, value in parts.items()]
        else:
            kept.append(named(df, c))
    return df.select(*kept)


def points_from_text(df: DataFrame, column: str = "Source") -> DataFrame:
    """'lat,lon' text to two double columns, as they are: values beyond the globe are kept."""
    split = split_exact(df, column, ["lat", "lon"])
    return split.withColumns({"lat": to_number(split["lat"]), "lon": to_number(split["lon"])})


def keep_regions(df: DataFrame, column: str, regions: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose region is in the set, given as values or, for long sets, as a one-column table."""
    if isinstance(regions, DataFrame):
        wanted = regions.select(regions[regions.columns[0]].alias("_region"))
        return df.join(wanted, df[column] == wanted["_region"], "left_semi")
    return df.where(in_set(df[column], regions))


def stack(tables: Sequence[DataFrame], strict: bool = False) -> DataFrame:
    """Union all by column name. Lenient: a column absent from a table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), tables)


def unpivot(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Every non-key column to rows; rows with a missing value stay."""
    return df.unpivot(list(keys), all_but(df, keys), name, value)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, "left")


def left_join(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left join on differently named keys {left: right}; missing keys match each other.

    The key columns of the right table are dropped.
    """
    held = right.withColumnsRenamed({r: f"_key_{r}" for r in keys.values()})
    matched = reduce(
        lambda a, b: a & b,
        [left[l].eqNullSafe(held[f"_key_{r}"]) for l, r in keys.items()],
    )
    return left.join(held, matched, "left").drop(*[f"_key_{r}" for r in keys.values()])


def expand_left_join(regions: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Left join of few regions with many events per region; a region without events gives one row.

    As a plain left join every event would be shuffled to the task of its region, and a join cannot
    split the many side when it is the nullable one. So matches are an inner join, which broadcasts the regions
    if they are small and can split hot regions otherwise, and the rest an anti join on the distinct keys.
    """
    extra = [f for f in events.schema if f.name != key]
    matches = regions.join(events, key, "inner").select(
        *[regions[c] for c in regions.columns], *[events[f.name] for f in extra]
    )
    present = events.select(key).where(F.col(key).isNotNull()).distinct()
    unmatched = regions.join(present, key, "left_anti").select(
        *regions.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    )
    return matches.unionByName(unmatched)
