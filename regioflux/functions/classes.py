"""Ordered classes: ratings from percentiles or thresholds, factor levels, fixed-break bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RATING_LEVELS = ("Very Low", "Low", "Moderate", "High", "Very High")
PERCENTILE_CUTS = (20, 40, 60, 80)
DISASTER_CUTS = (100, 500, 1000, 2000)
NET_BREAKS = (-10000, -1000, 1000, 10000)


def factor(x: Column, levels: Sequence[str] = RATING_LEVELS) -> Column:
    """Keeps the declared levels; any other text becomes null."""
    return F.when(x.isin(*levels), x)


def ordinal(x: Column, levels: Sequence[str] = RATING_LEVELS, reverse: bool = False) -> Column:
    """Position of the level from 1; null for a value outside the levels."""
    position = F.nullif(F.array_position(F.array(*map(F.lit, levels)), x), F.lit(0)).cast("int")
    return F.lit(len(levels) + 1) - position if reverse else position


def percentile_rating(
    p: Column, cuts: Sequence[float] = PERCENTILE_CUTS, labels: Sequence[str] = RATING_LEVELS
) -> Column:
    """The highest class whose lower cut is reached; a missing percentile stays missing."""
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for cut, label in sorted(zip(cuts, labels[1:]), reverse=True):
        chain = chain.when(p >= cut, label)
    return chain.otherwise(labels[0])


def threshold_rating(
    x: Column, cuts: Sequence[float] = DISASTER_CUTS, labels: Sequence[str] = RATING_LEVELS
) -> Column:
    """Classes over (low, high] intervals; a missing value stays missing."""
    chain = F.when(x.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        chain = chain.when(x <= cut, label)
    return chain.otherwise(labels[-1])


def bin_index(x: Column, breaks: Sequence[float] = NET_BREAKS) -> Column:
    """Index from 1 of the left-closed interval that holds x."""
    chain = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, limit in enumerate(breaks, start=1):
        chain = chain.when(x < limit, i)
    return chain.otherwise(len(breaks) + 1)


def bin_labels(breaks: Sequence[float] = NET_BREAKS) -> list[str]:
    inner = [f"{low:,} to {high:,}" for low, high in zip(breaks, breaks[1:])]
    return [f"Less than {breaks[0]:,}", *inner, f"{breaks[-1]:,} or more"]


def bin_label(x: Column, breaks: Sequence[float] = NET_BREAKS) -> Column:
    # Not element_at: in ANSI mode it takes a null index for a position if the array holds no null.
    return F.get(F.array(*map(F.lit, bin_labels(breaks))), bin_index(x, breaks) - 1)
