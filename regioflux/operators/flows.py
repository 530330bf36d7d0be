"""Origin-destination flows: tables of (current_state, origin_state, year, migrants)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioflux.functions.missing import fill0, in_set, sum0
from regioflux.operators.ranks import top_per_group
from regioflux.operators.tables import left_join


def between_regions(flows: DataFrame) -> DataFrame:
    """Without flows that stay in their region."""
    return flows.where(flows["origin_state"] != flows["current_state"])


def arrivals(flows: DataFrame, by: Sequence[str] = (), name: str = "inflow") -> DataFrame:
    keys = [*by, F.col("current_state").alias("state")]
    return flows.groupBy(*keys).agg(sum0(F.col("migrants")).alias(name))


def departures(flows: DataFrame, by: Sequence[str] = (), name: str = "outflow") -> DataFrame:
    keys = [*by, F.col("origin_state").alias("state")]
    return flows.groupBy(*keys).agg(sum0(F.col("migrants")).alias(name))


def net_of(inflow: DataFrame, outflow: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full join of two separately computed totals; a side that is absent counts as 0."""
    values = [c for c in inflow.columns + outflow.columns if c not in on]
    joined = inflow.join(outflow, list(on), "full")
    filled = joined.withColumns({c: fill0(joined[c]) for c in values})
    return filled.withColumn("net_migration", F.col(values[0]) - F.col(values[1]))


def balance(
    flows: DataFrame,
    by: Sequence[str] = (),
    regions: Sequence[str] | None = None,
    names: Sequence[str] = ("inflow", "outflow"),
) -> DataFrame:
    """Inflow, outflow and net per region without self flows, from a single read of the flows.

    Each flow counts once at both of its ends, so one grouping gives what two groupings and a
    full join would. With regions, only those ends are kept.
    """
    moved = between_regions(flows)
    if regions is not None:
        moved = moved.where(
            in_set(moved["current_state"], regions) | in_set(moved["origin_state"], regions)
        )
    nothing = F.lit(None).cast(moved.schema["migrants"].dataType)

    def end(state: str, arrived: Column, left: Column) -> Column:
        return F.struct(F.col(state).alias("state"), arrived.alias("arrived"), left.alias("left"))

    ends = moved.select(
        *by,
        F.inline(
            F.array(
                end("current_state", F.col("migrants"), nothing),
                end("origin_state", nothing, F.col("migrants")),
            )
        ),
    )
    if regions is not None:
        ends = ends.where(in_set(ends["state"], regions))
    inflow, outflow = names
    totals = ends.groupBy(*by, "state").agg(
        sum0(F.col("arrived")).alias(inflow), sum0(F.col("left")).alias(outflow)
    )
    return totals.withColumn("net_migration", F.col(inflow) - F.col(outflow))


def inflow_change(flows: DataFrame, first: int, last: int) -> DataFrame:
    """Inflow of two years side by side and their difference, missing where a year is absent."""
    moved = between_regions(flows).where(F.col("year").isin(first, last))

    def inflow_in(year: int) -> Column:
        that_year = F.col("year") == year
        return F.when(F.count_if(that_year) > 0, sum0(F.when(that_year, F.col("migrants"))))

    wide = moved.groupBy("current_state").agg(
        inflow_in(first).alias(f"inflow_{first}"), inflow_in(last).alias(f"inflow_{last}")
    )
    return wide.withColumn("change", F.col(f"inflow_{last}") - F.col(f"inflow_{first}"))


def focus_rows(flows: DataFrame, focus: Sequence[str]) -> DataFrame:
    """All rows that touch a focus region, self flows included."""
    return flows.where(in_set(flows["current_state"], focus) | in_set(flows["origin_state"], focus))


def focus_flows(flows: DataFrame, focus: Sequence[str]) -> DataFrame:
    """Totals per origin and destination that touch a focus region, labelled by direction.

    A flow between two focus regions is labelled Inflow only.
    """
    pairs = (
        between_regions(focus_rows(flows, focus))
        .groupBy("origin_state", "current_state")
        .agg(sum0(F.col("migrants")).alias("migrants"))
    )
    label = F.when(in_set(pairs["current_state"], focus), "Inflow").when(
        in_set(pairs["origin_state"], focus), "Outflow"
    )
    return pairs.withColumn("flow_type", label)


def top_focus_flows(flows: DataFrame, focus: Sequence[str], n: int = 15) -> DataFrame:
    order = [F.desc_nulls_last("migrants"), F.asc("origin_state"), F.asc("current_state")]
    return top_per_group(focus_flows(flows, focus), "flow_type", order, n)


def with_coordinates(flows: DataFrame, points: DataFrame) -> DataFrame:
    """Adds both end points from points(NAME, lon, lat) and drops flows with an unknown end."""
    for end, side in (("origin_state", "from"), ("current_state", "to")):
        named = points.select(
            "NAME", F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}")
        )
        flows = left_join(flows, named, {end: "NAME"})
    return flows.na.drop("any", subset=["lon_from", "lon_to", "lat_from", "lat_to"])
