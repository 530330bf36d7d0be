"""Queries on county pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.text import strip_suffixes
from regioflux.operators.matrix import county_pairs
from regioflux.operators.ranks import head, sorted_desc, tail
from regioflux.operators.tables import keep_regions, to_numbers, token_to_null
from regioflux.plans import county_flows as plan
from regioflux.workload import fixtures as fx
from regioflux.workload.flow_queries import RUST_SQL
from regioflux.workload.registry import query


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The clean pairs straight from the records, without the detour over cells."""
    records = token_to_null(fx.county_records(spark, sf)).na.drop("any")
    return to_numbers(records, ("inflow", "outflow", "net_migration"))


@query("SELECT * FROM county_pairs", ("county_pairs",))
def county_clean(spark: SparkSession, sf: str) -> DataFrame:
    return county_pairs(fx.county_cells(spark, sf))


@query("SELECT * FROM county_totals", ("county_totals",))
def county_totals(spark: SparkSession, sf: str) -> DataFrame:
    return plan.county_totals(_pairs(spark, sf))


@query(
    "SELECT * FROM county_totals ORDER BY c_inflow DESC, state_from, county_from LIMIT 10",
    ("county_totals",),
)
def county_top10(spark: SparkSession, sf: str) -> DataFrame:
    return head(plan.county_totals(_pairs(spark, sf)), "c_inflow", plan.COUNTY)


@query(
    f"""SELECT * FROM county_totals WHERE state_from IN {RUST_SQL}
    ORDER BY net, state_from DESC, county_from DESC LIMIT 10""",
    ("county_totals",),
)
def county_bottom10(spark: SparkSession, sf: str) -> DataFrame:
    rust = keep_regions(plan.county_totals(_pairs(spark, sf)), "state_from", fx.RUST_NATIONS)
    return tail(rust, "net", plan.COUNTY)


@query(
    f"SELECT state_from, county_from, net FROM county_totals WHERE state_from IN {RUST_SQL}",
    ("county_totals",),
)
def rust_belt_counties(spark: SparkSession, sf: str) -> DataFrame:
    rust = keep_regions(_pairs(spark, sf), "state_from", fx.RUST_NATIONS)
    totals = plan.county_totals(rust).select("state_from", "county_from", "net")
    return sorted_desc(totals, "net", plan.COUNTY)


SHORT_NAME = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(county_from, ' County$', ''), ' Parish$', ''), ' Borough$', ''),
    ' Census Area$', ''), ' Municipality$', ''), ' City and Borough$', '')"""


@query(
    f"""SELECT DISTINCT state_from, county_from, {SHORT_NAME} AS short_name,
        regexp_replace(county_from,
            '( City and Borough| Census Area| Municipality| Borough| Parish| County)$', '') AS bare_name
    FROM county_pairs""",
    ("county_pairs",),
)
def county_name_norm(spark: SparkSession, sf: str) -> DataFrame:
    names = _pairs(spark, sf).select("state_from", "county_from").distinct()
    name = F.col("county_from")
    return names.withColumns(
        {"short_name": strip_suffixes(name), "bare_name": strip_suffixes(name, longest_first=True)}
    )


LAYER_SQL = f"""SELECT b.state_name AS "STATE_NAME", b.name AS "NAME", t.net
    FROM (SELECT DISTINCT n_name AS state_name, c_mktsegment AS name
          FROM customer JOIN nation ON c_nationkey = n_nationkey) b
    LEFT JOIN (SELECT state_from, {SHORT_NAME} AS short, net FROM county_totals) t
        ON b.state_name = t.state_from AND b.name = t.short"""


@query(LAYER_SQL, ("county_totals",))
def county_layer(spark: SparkSession, sf: str) -> DataFrame:
    totals = plan.county_totals(_pairs(spark, sf))
    return plan.county_layer(fx.county_boundaries(spark, sf), totals)


@query(
    f"""SELECT *, CAST(CASE WHEN net IS NULL THEN NULL WHEN net < -10000 THEN 1 WHEN net < -1000 THEN 2
            WHEN net < 1000 THEN 3 WHEN net < 10000 THEN 4 ELSE 5 END AS INTEGER) AS bin,
        CASE WHEN net IS NULL THEN NULL WHEN net < -10000 THEN 'Less than -10,000'
            WHEN net < -1000 THEN '-10,000 to -1,000' WHEN net < 1000 THEN '-1,000 to 1,000'
            WHEN net < 10000 THEN '1,000 to 10,000' ELSE '10,000 or more' END AS bin_label,
        'STATE_NAME: ' || "STATE_NAME" || '<br>County: ' || "NAME" || '<br>Net Migration: '
            || coalesce(CAST(CAST(net AS BIGINT) AS VARCHAR), 'NA') AS popup
    FROM ({LAYER_SQL}) WHERE "STATE_NAME" NOT IN ('NATION_0', 'NATION_24')""",
    ("county_totals",),
)
def net_bins(spark: SparkSession, sf: str) -> DataFrame:
    totals = plan.county_totals(_pairs(spark, sf))
    layer = plan.county_layer(fx.county_boundaries(spark, sf), totals)
    return plan.binned_layer(layer, fx.OFF_MAP_NATIONS)
