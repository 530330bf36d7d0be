"""The analyses' input tables, derived from the TPC-H-like test tables.

Joins carry no broadcast hints: Catalyst broadcasts a side only below its size threshold, and the adaptive
planner splits hot keys of the larger joins. fixture_sql.py holds the same derivations in SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regioflux.functions.text import COUNTY_SUFFIXES
from regioflux.plans.state_flows import region_points
from regioflux.workload.xlsx_writer import workbook_bytes

NATIONS = tuple(f"NATION_{i}" for i in range(25))
RUST_NATIONS = ("NATION_2", "NATION_5", "NATION_7", "NATION_11", "NATION_13", "NATION_17", "NATION_23")
FOCUS_NATIONS = ("NATION_3", "NATION_8", "NATION_21")
OFF_MAP_NATIONS = ("NATION_0", "NATION_24")
PRIORITIES = {
    "1-URGENT": "n_urgent",
    "2-HIGH": "n_high",
    "3-MEDIUM": "n_medium",
    "4-NOT SPECIFIED": "n_not_specified",
    "5-LOW": "n_low",
}
INDICATORS = ("Temperature", "Droughts", "Storms", "Wildfires", "Flooding")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bought_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation and segment of the buyer."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_suppkey",
        "l_returnflag",
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("quantity"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return lines.join(buyers, lines["l_orderkey"] == buyers["o_orderkey"]).select(
        F.col("c_nationkey").alias("dest"),
        F.col("c_mktsegment").alias("segment"),
        "year",
        "l_returnflag",
        "quantity",
        "l_suppkey",
    )


def keyed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with destination (buyer) and origin (seller) nation keys."""
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("orig"))
    lines = bought_lines(spark, sf_dir)
    return lines.join(sellers, lines["l_suppkey"] == sellers["s_suppkey"]).drop("l_suppkey", "s_suppkey")


def nation_names(spark: SparkSession, sf_dir: str, key: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(key), F.col("n_name").alias(name)
    )


def flow_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: current_state, origin_state, year, migrants."""
    return (
        keyed_flows(spark, sf_dir)
        .join(nation_names(spark, sf_dir, "dest", "current_state"), "dest")
        .join(nation_names(spark, sf_dir, "orig", "origin_state"), "orig")
        .select("current_state", "origin_state", "year", F.col("quantity").alias("migrants"))
    )


def _cell(row: Column, col: Column, value: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("value"))


def state_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows laid out as published yearly workbooks: headings, filler, margins, totals."""
    # The condition holds for every pair. It keeps the columns of all uses below the same, so that they
    # share one shuffle.
    sums = (
        keyed_flows(spark, sf_dir)
        .groupBy("year", "dest", "orig")
        .agg(F.sum("quantity").alias("total"))
        .where((F.col("total") > 0) & F.col("dest").isNotNull() & F.col("orig").isNotNull())
    )
    first_row = 12
    estimate_col = F.col("orig") * 2 + 2
    text = F.concat(F.lit(" "), F.format_number("total", 0))
    body = sums.select(
        "year",
        F.inline(
            F.array(
                _cell(
                    F.col("dest") + first_row,
                    estimate_col,
                    F.when(F.col("dest") == F.col("orig"), "N/A").otherwise(text),
                ),
                _cell(
                    F.col("dest") + first_row,
                    estimate_col + 1,
                    F.concat(F.lit("+/-"), (F.col("total") % 100).cast("int").cast("string")),
                ),
            )
        ),
    )
    labels = (
        sums.groupBy("year", "dest")
        .agg(F.sum("total").alias("all"))
        .join(nation_names(spark, sf_dir, "dest", "name"), "dest")
        .select(
            "year",
            F.inline(
                F.array(
                    _cell(
                        F.col("dest") + first_row,
                        F.lit(1),
                        F.concat(F.lit("  "), F.col("name"), F.lit("\t")),
                    )
                )
            ),
        )
    )
    heads = (
        sums.groupBy("year", "orig")
        .agg(F.sum("total").alias("all"))
        .join(nation_names(spark, sf_dir, "orig", "name"), "orig")
        .select(
            "year",
            F.inline(
                F.array(
                    _cell(F.lit(7), estimate_col, F.concat(F.col("name"), F.lit(" "))),
                    _cell(F.lit(8), estimate_col, F.lit("Estimate")),
                    _cell(F.lit(8), estimate_col + 1, F.lit("MOE")),
                    _cell(F.lit(first_row + 25), estimate_col, F.format_number("all", 0)),
                    _cell(F.lit(first_row + 26), estimate_col, F.col("name")),
                )
            ),
        )
    )
    filler = (
        sums.groupBy("year")
        .agg(F.sum("total").alias("all"))
        .select(
            "year",
            F.inline(
                F.array(
                    _cell(F.lit(1), F.lit(1), F.lit("Table 1. Flows by current and previous residence")),
                    _cell(F.lit(6), F.lit(1), F.lit("Current residence in")),
                    _cell(F.lit(first_row + 25), F.lit(1), F.lit("Total")),
                    _cell(F.lit(first_row + 26), F.lit(1), F.lit("Current residence in")),
                )
            ),
        )
    )
    cells = body.unionByName(labels).unionByName(heads).unionByName(filler)
    return cells.select(
        F.concat(F.lit("flows_"), F.col("year").cast("string"), F.lit(".xlsx")).alias("file"),
        F.lit("Table").alias("sheet"),
        "year",
        "row",
        "col",
        "value",
    )


def workbooks(cells: DataFrame) -> DataFrame:
    """(file, year, content): the cells of each file written as one workbook."""

    def write(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [key[0]], "year": [key[1]], "content": [workbook_bytes(cells)]})

    needed = cells.select("file", "year", "sheet", "row", "col", "value")
    return needed.groupBy("file", "year").applyInPandas(
        write, "file string, year int, content binary"
    )


def county_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County pairs as text, with '-' in place of some inflows."""
    sums = (
        keyed_flows(spark, sf_dir)
        .groupBy("dest", "segment", "orig")
        .agg(
            F.sum("quantity").cast("bigint").alias("arrived"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("quantity")).otherwise(0.0))
            .cast("bigint")
            .alias("left"),
        )
    )
    suffix = F.get(F.array(*map(F.lit, COUNTY_SUFFIXES)), F.col("dest") % len(COUNTY_SUFFIXES))
    return (
        sums.join(nation_names(spark, sf_dir, "dest", "state_from"), "dest")
        .join(nation_names(spark, sf_dir, "orig", "state_to"), "orig")
        .select(
            "state_from",
            F.concat("segment", suffix).alias("county_from"),
            "state_to",
            F.concat("state_to", F.lit(" County")).alias("county_to"),
            F.when(F.col("arrived") % 11 == 0, "-")
            .otherwise(F.col("arrived").cast("string"))
            .alias("inflow"),
            F.col("left").cast("string").alias("outflow"),
            (F.col("arrived") - F.col("left")).cast("string").alias("net_migration"),
        )
    )


def county_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county pairs laid out as a workbook with one sheet per state and three head rows."""
    order = Window.partitionBy("state_from").orderBy("county_from", "state_to")
    placed = county_records(spark, sf_dir).withColumn("row", F.row_number().over(order) + 3)
    row = F.col("row")
    columns = {
        1: F.lit("code"),
        5: F.col("state_from"),
        6: F.col("county_from"),
        7: F.col("state_to"),
        8: F.col("county_to"),
        9: F.col("inflow"),
        10: F.lit("margin"),
        11: F.col("outflow"),
        12: F.lit("margin"),
        13: F.col("net_migration"),
    }
    record = F.array(*[_cell(row, F.lit(col), value) for col, value in columns.items()])
    # Texts above the data in the data columns, which must not reach the result.
    head = F.array(
        *[_cell(F.lit(r), F.lit(c), F.lit(f"head {r}")) for r in (1, 2, 3) for c in (5, 6, 9)]
    )
    return placed.select(
        F.lit("counties.xlsx").alias("file"),
        F.col("state_from").alias("sheet"),
        F.lit(None).cast("int").alias("year"),
        F.inline(F.when(row == 4, F.concat(head, record)).otherwise(record)),
    )


def county_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(STATE_NAME, NAME): every nation and market segment that has customers."""
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("NAME"))
        .distinct()
        .join(nation_names(spark, sf_dir, "key", "STATE_NAME"), "key")
        .select("STATE_NAME", "NAME")
    )


def disasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """disasterNumber, STUSPS, fyDeclared, incidentType, designatedArea; some codes are missing."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(nation_names(spark, sf_dir, "c_nationkey", "name"), "c_nationkey")
        .select(
            F.floor(F.col("o_orderkey") / 10).alias("disasterNumber"),
            F.when(F.col("o_orderkey") % 97 != 0, F.col("name")).alias("STUSPS"),
            F.year("o_orderdate").alias("fyDeclared"),
            F.col("o_orderpriority").alias("incidentType"),
            F.col("c_mktsegment").alias("designatedArea"),
        )
    )


ORDER_FIELDS = ("order_key", "clerk_code", "status", "price", "placed", "open", "note")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): orders as CSV records without a header; some have a field too many or too few."""
    key = F.col("o_orderkey")
    fields = (
        key,
        F.lpad((key % 1000).cast("string"), 5, "0"),
        F.when(key % 7 != 0, F.col("o_orderstatus")),
        F.when(key % 5 == 0, F.floor("o_totalprice").cast("string")).otherwise(F.col("o_totalprice").cast("string")),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(key % 11 != 0, F.col("o_orderstatus") == "O"),
        F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('", twice')),
    )
    record = F.struct(*(f.alias(name) for f, name in zip(fields, ORDER_FIELDS)))
    line = F.to_csv(record, {"nullValue": "NA", "escape": '"'})
    shaped = F.when(key % 97 == 0, F.concat(line, F.lit(",surplus"))).when(key % 89 == 0, F.concat(key.cast("string"), F.lit(",00000"))).otherwise(line)
    return table(spark, sf_dir, "orders").select(shaped.alias("line"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo_id, STUSPS): one per nation."""
    return nation_names(spark, sf_dir, "geo_id", "STUSPS")


def tract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STATE, GEOID_County, CVI_Score in whole cents; negative scores and all of nation 24 are missing."""
    present = (F.col("c_acctbal") >= 0) & (F.col("c_nationkey") != 24)
    return (
        table(spark, sf_dir, "customer")
        .join(nation_names(spark, sf_dir, "c_nationkey", "STATE"), "c_nationkey")
        .select(
            "STATE",
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias(
                "GEOID_County"
            ),
            F.when(present, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("CVI_Score"),
        )
    )


def score_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(GEOID, NAME): county codes of customers, without those of nation 7."""
    return (
        table(spark, sf_dir, "customer")
        .select("c_nationkey", "c_mktsegment")
        .distinct()
        .where(F.col("c_nationkey") != 7)
        .select(
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("GEOID"),
            F.col("c_mktsegment").alias("NAME"),
        )
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, Source 'lat,lon' and five whole-number indicators per nation."""
    quantity = F.col("quantity").cast("bigint")
    lines = (
        bought_lines(spark, sf_dir)
        .groupBy("dest")
        .agg(
            *[
                F.sum(F.when(F.col("l_returnflag") == flag, quantity)).alias(name)
                for flag, name in (("A", "Temperature"), ("R", "Droughts"), ("N", "Storms"))
            ]
        )
    )
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    counts = (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .groupBy("c_nationkey")
        .agg(
            F.count_if(F.col("o_orderstatus") == "F").alias("fires"),
            F.count_if(F.col("o_orderstatus") == "O").alias("Flooding"),
        )
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("n_nationkey")
    lat = (F.floor(key / 5) + 0.5).cast("double").cast("string")
    lon = (key % 5 + 0.5).cast("double").cast("string")
    return (
        nations.join(lines, key == F.col("dest"), "left")
        .join(counts, key == F.col("c_nationkey"), "left")
        .select(
            F.col("n_name").alias("Name"),
            F.concat(lat, F.lit(","), lon).alias("Source"),
            "Temperature",
            "Droughts",
            "Storms",
            F.when(key % 10 != 3, F.col("fires")).alias("Wildfires"),
            "Flooding",
        )
    )


def social_indicators(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Name and whole-number indicators per nation: (economy, society), the first without nation 9."""
    customers = table(spark, sf_dir, "customer").join(nation_names(spark, sf_dir, "c_nationkey", "Name"), "c_nationkey")
    sums = customers.groupBy("Name").agg(
        F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("Economic_Productivity_Losses"),
        F.count_if(F.col("c_custkey") % 3 == 0).alias("Housing_Type_Transportation"),
        F.nullif(F.count_if(F.col("c_acctbal") < 0) % 7, F.lit(0)).cast("bigint").alias("Socioeconomic_Stressors"),
    )
    economy = sums.where("Name <> 'NATION_9'").select("Name", "Economic_Productivity_Losses")
    return economy, sums.select("Name", "Housing_Type_Transportation", "Socioeconomic_Stressors")


def risk_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One county per part, with missing scores, missing populations and an unknown rating text."""
    key = F.col("p_partkey")
    levels = ("Very Low", "Low", "Moderate", "High", "Very High", "No Rating")
    return table(spark, sf_dir, "part").select(
        F.lpad(key.cast("string"), 12, "0").alias("STCOFIPS"),
        F.col("p_name").alias("COUNTY"),
        F.concat(F.lit("NATION_"), (key % 25).cast("string")).alias("STATEABBRV"),
        F.lpad((key % 25).cast("string"), 2, "0").alias("STATEFIPS"),
        F.when(key % 17 != 0, F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("RISK_SCORE"),
        F.when(key % 401 != 0, F.col("p_size").cast("bigint")).alias("POPULATION"),
        F.get(F.array(*map(F.lit, levels)), F.col("p_size") % 6).alias("RISK_RATNG"),
    )


def doubled_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk counties with copies of every fiftieth."""
    counties = risk_counties(spark, sf_dir)
    return counties.unionByName(counties.where(F.col("STCOFIPS").cast("bigint") % 50 == 0))


def _squares(keys: DataFrame, key: str, width: int) -> DataFrame:
    """A closed unit square per key on a grid of the given width, counted counter-clockwise."""
    x = (F.col(key) % width).cast("double")
    y = F.floor(F.col(key) / width).cast("double")
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    vertex = [
        F.struct(F.lit(i).alias("seq"), (x + dx).alias("x"), (y + dy).alias("y"))
        for i, (dx, dy) in enumerate(corners)
    ]
    return keys.select(
        F.col(key).cast("bigint").alias("geo_id"),
        F.lit(0).alias("part"),
        F.lit(0).alias("ring"),
        F.inline(F.array(*vertex)),
    )


def state_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per nation on a 5 by 5 grid."""
    return _squares(table(spark, sf_dir, "nation"), "n_nationkey", 5)


def parcel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per customer on a grid 100 wide."""
    return _squares(table(spark, sf_dir, "customer"), "c_custkey", 100)


def parcel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo_id, n_name): the nation of each parcel."""
    customers = table(spark, sf_dir, "customer")
    return customers.join(nation_names(spark, sf_dir, "c_nationkey", "n_name"), "c_nationkey").select(
        F.col("c_custkey").alias("geo_id"), "n_name"
    )


def damaged_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with defects: open, flat, without coordinate, short or with a repeated vertex."""
    key, seq = F.col("geo_id"), F.col("seq")
    kept = parcel_vertices(spark, sf_dir).where(
        ~((key % 7 == 3) & (seq == 4)) & ~((key % 17 == 6) & (seq >= 2))
    )
    return kept.withColumns(
        {
            "x": F.when((key % 13 == 4) & (seq == 1), F.lit(None)).otherwise(
                F.when((key % 19 == 5) & (seq == 2), F.col("x") - 1).otherwise(F.col("x"))
            ),
            "y": F.when(key % 11 == 5, F.lit(0.0)).otherwise(F.col("y")),
        }
    )


def twisted_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of eight corners: notched squares, some with two corners swapped, a notch that reaches the other side, or one pulled beyond it."""
    key = F.col("geo_id")
    depth = F.when(key % 13 == 4, 1.0).when(key % 17 == 6, 1.5).otherwise(0.5)
    notch = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.75, 1.0), (0.5, None), (0.25, 1.0), (0.0, 1.0), (0.0, 0.0)]
    swap = (key % 23 == 7) & F.col("seq").isin(1, 2)
    corners = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(x).alias("dx"), (F.lit(y) if y is not None else 1 - depth).alias("dy")) for i, (x, y) in enumerate(notch)))
    base = parcel_vertices(spark, sf_dir).where("seq = 0").select("geo_id", "part", "ring", "x", "y", F.inline(corners))
    placed = base.select("geo_id", "part", "ring", F.when(swap, 3 - F.col("seq")).otherwise(F.col("seq")).alias("seq"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return placed


def staggered_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels in rows laid like bricks, turned and sheared: corners of one row lie inside the edges of the next."""
    x = F.col("x") + (F.floor(F.col("geo_id") / 100) % 2) * 0.5
    return parcel_vertices(spark, sf_dir).withColumns({"x": x * 3 + F.col("y"), "y": F.col("y") * 5 - x})


def state_points(spark: SparkSession, sf_dir: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """(NAME, lon, lat) of nation centroids, some removed on request."""
    regions = nation_names(spark, sf_dir, "geo_id", "NAME")
    points = region_points(regions, state_vertices(spark, sf_dir))
    return points.where(~F.col("NAME").isin(*dropped)) if dropped else points

