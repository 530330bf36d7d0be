"""County workbook to county totals, extremes and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from regioflux.functions.classes import bin_index, bin_label
from regioflux.functions.missing import not_in
from regioflux.functions.regions import OFF_MAP_STATES, RUST_BELT
from regioflux.functions.text import number_text, strip_suffixes
from regioflux.operators.groups import group_totals
from regioflux.operators.layers import popup
from regioflux.operators.matrix import county_pairs
from regioflux.operators.ranks import head, tail
from regioflux.operators.tables import keep_regions, left_join
from regioflux.sources.workbook import list_workbooks, workbook_cells

COUNTY = ["state_from", "county_from"]


def read_county_pairs(spark: SparkSession, workbook: str) -> DataFrame:
    """Every sheet of one workbook."""
    return county_pairs(workbook_cells(list_workbooks(spark, workbook)))


def county_totals(pairs: DataFrame) -> DataFrame:
    sums = {"c_inflow": "inflow", "c_outflow": "outflow", "net": "net_migration"}
    return group_totals(pairs, COUNTY, sums)


def county_layer(counties: DataFrame, totals: DataFrame, longest_first: bool = False) -> DataFrame:
    """Counties (STATE_NAME, NAME, ...) with their net migration; counties without data stay."""
    short = strip_suffixes(totals["county_from"], longest_first=longest_first)
    net = totals.select("state_from", short.alias("county_from"), "net")
    return left_join(counties, net, {"STATE_NAME": "state_from", "NAME": "county_from"})


def binned_layer(layer: DataFrame, off_map: Sequence[str] = OFF_MAP_STATES) -> DataFrame:
    """Five net-migration classes and popup texts, without the states off the map."""
    net = layer["net"]
    return layer.where(not_in(layer["STATE_NAME"], off_map)).withColumns(
        {
            "bin": bin_index(net),
            "bin_label": bin_label(net),
            "popup": popup(
                ("STATE_NAME", layer["STATE_NAME"]),
                ("County", layer["NAME"]),
                ("Net Migration", number_text(net)),
            ),
        }
    )


def analyse(
    pairs: DataFrame, counties: DataFrame, rust_belt: Sequence[str] = RUST_BELT
) -> dict[str, DataFrame]:
    totals = county_totals(pairs)
    rust = keep_regions(totals, "state_from", rust_belt)
    return {
        "totals": totals,
        "top_in": head(totals, "c_inflow", COUNTY),
        "top_out": head(totals, "c_outflow", COUNTY),
        "top_net": head(totals, "net", COUNTY),
        "rust_belt_top": head(rust, "net", COUNTY),
        "rust_belt_bottom": tail(rust, "net", COUNTY),
        "county_layer": binned_layer(county_layer(counties, totals)),
        "rust_belt_layer": binned_layer(
            county_layer(keep_regions(counties, "STATE_NAME", rust_belt), rust)
        ),
    }
