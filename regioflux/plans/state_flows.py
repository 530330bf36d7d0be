"""State workbooks to net migration, changes, top flows and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.regions import FOCUS_STATES, MAP_STATES, RUST_BELT, SURVEY_STATES
from regioflux.operators import flows as fl
from regioflux.operators.geometry import centroids
from regioflux.operators.layers import diverging, flow_lines
from regioflux.operators.matrix import flows_from_cells
from regioflux.operators.ranks import sorted_desc, top_with_ties
from regioflux.operators.tables import keep_regions, left_join, rename
from regioflux.sources.workbook import assign_years, list_workbooks, workbook_cells


def read_state_flows(
    spark: SparkSession, folder: str, years: Sequence[int], regions: Sequence[str] = SURVEY_STATES
) -> DataFrame:
    """Flows from one workbook per year; the first sheet of each is read."""
    files = assign_years(list_workbooks(spark, folder), years)
    return flows_from_cells(workbook_cells(files, first_sheet=True), regions)


def region_points(regions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(NAME, lon, lat) from regions(geo_id, NAME)."""
    found = centroids(vertices).select("geo_id", "lon", "lat")
    return regions.select("geo_id", "NAME").join(found, "geo_id", "left").drop("geo_id")


def analyse(
    flows: DataFrame,
    regions: DataFrame,
    vertices: DataFrame,
    first: int,
    last: int,
    rust_belt: Sequence[str] = RUST_BELT,
    focus: Sequence[str] = FOCUS_STATES,
    mapped: Sequence[str] = MAP_STATES,
) -> dict[str, DataFrame]:
    net = fl.balance(flows)
    points = region_points(regions, vertices)
    top_focus = fl.top_focus_flows(flows, focus)
    layer = left_join(keep_regions(regions, "NAME", mapped), net, {"NAME": "state"})
    return {
        # With the flows within a state, unlike the other totals.
        "top_destinations": sorted_desc(
            rename(fl.arrivals(flows), {"state": "current_state"}), "inflow", ["current_state"]
        ),
        "inflow_change": sorted_desc(
            fl.inflow_change(flows, first, last), "change", ["current_state"]
        ),
        "net_migration": sorted_desc(net, "net_migration", ["state"]),
        "rust_belt_net": fl.balance(flows, ["year"], rust_belt, ("total_in", "total_out")),
        "top_states": sorted_desc(top_with_ties(net, "net_migration", 5), "net_migration", ["state"]),
        "top_focus_flows": top_focus,
        "flow_lines": flow_lines(fl.with_coordinates(top_focus, points)),
        "focus_points": points.where(F.col("NAME").isin(*focus)),
        "net_layer": diverging(layer, "net_migration", "fill"),
        "rust_belt_layer": diverging(keep_regions(layer, "NAME", rust_belt), "net_migration", "fill"),
    }
