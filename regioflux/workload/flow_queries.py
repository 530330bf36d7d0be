"""Queries on state flows and their workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.text import clean_count
from regioflux.operators import flows as fl
from regioflux.operators import matrix
from regioflux.operators.layers import flow_lines
from regioflux.operators.ranks import sorted_desc, top_with_ties
from regioflux.operators.tables import keep_regions, rename, stack
from regioflux.sources.workbook import assign_years, workbook_cells
from regioflux.workload import fixtures as fx
from regioflux.workload.registry import query


@query("SELECT * FROM net", ("net",))
def state_net(spark: SparkSession, sf: str) -> DataFrame:
    return sorted_desc(fl.balance(fx.flow_long(spark, sf)), "net_migration", ["state"])


@query("SELECT * FROM net", ("net",))
def state_net_full_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same result from two totals and a full join."""
    moved = fl.between_regions(fx.flow_long(spark, sf))
    return fl.net_of(fl.arrivals(moved), fl.departures(moved), ["state"])


@query(
    "SELECT current_state, sum(migrants) AS inflow FROM flow_long GROUP BY 1",
    ("flow_long",),
)
def top_destinations(spark: SparkSession, sf: str) -> DataFrame:
    totals = rename(fl.arrivals(fx.flow_long(spark, sf)), {"state": "current_state"})
    return sorted_desc(totals, "inflow", ["current_state"])


@query(
    """SELECT current_state AS state, sum(migrants) AS inflow FROM flow_long
    WHERE origin_state <> current_state GROUP BY 1""",
    ("flow_long",),
)
def state_inflow(spark: SparkSession, sf: str) -> DataFrame:
    return fl.arrivals(fl.between_regions(fx.flow_long(spark, sf)))


@query(
    """SELECT origin_state AS state, sum(migrants) AS outflow FROM flow_long
    WHERE origin_state <> current_state GROUP BY 1""",
    ("flow_long",),
)
def state_outflow(spark: SparkSession, sf: str) -> DataFrame:
    return fl.departures(fl.between_regions(fx.flow_long(spark, sf)))


@query(
    """SELECT *, inflow_2000 - inflow_1996 AS change FROM (
        SELECT current_state, sum(migrants) FILTER (year = 1996) AS inflow_1996,
               sum(migrants) FILTER (year = 2000) AS inflow_2000
        FROM flow_long WHERE origin_state <> current_state AND year IN (1996, 2000) GROUP BY 1)""",
    ("flow_long",),
)
def inflow_change(spark: SparkSession, sf: str) -> DataFrame:
    change = fl.inflow_change(fx.flow_long(spark, sf), 1996, 2000)
    return sorted_desc(change, "change", ["current_state"])


RUST_SQL = "('NATION_2','NATION_5','NATION_7','NATION_11','NATION_13','NATION_17','NATION_23')"


@query(
    f"""SELECT coalesce(i.year, o.year) AS year, coalesce(i.state, o.state) AS state,
           coalesce(total_in, 0) AS total_in, coalesce(total_out, 0) AS total_out,
           coalesce(total_in, 0) - coalesce(total_out, 0) AS net_migration
    FROM (SELECT year, current_state AS state, sum(migrants) AS total_in FROM flow_long
          WHERE current_state IN {RUST_SQL} AND origin_state <> current_state GROUP BY 1, 2) i
    FULL JOIN (SELECT year, origin_state AS state, sum(migrants) AS total_out FROM flow_long
               WHERE origin_state IN {RUST_SQL} AND origin_state <> current_state GROUP BY 1, 2) o
        ON i.year = o.year AND i.state = o.state""",
    ("flow_long",),
)
def subset_net_by_year(spark: SparkSession, sf: str) -> DataFrame:
    names = ("total_in", "total_out")
    return fl.balance(fx.flow_long(spark, sf), ["year"], fx.RUST_NATIONS, names)


@query(
    """SELECT state, net_thousands FROM (
        SELECT state, CAST(floor(net_migration / 1000) AS BIGINT) AS net_thousands FROM net)
    QUALIFY rank() OVER (ORDER BY net_thousands DESC) <= 5""",
    ("net",),
)
def top_states(spark: SparkSession, sf: str) -> DataFrame:
    net = fl.balance(fx.flow_long(spark, sf)).select(
        "state", F.floor(F.col("net_migration") / 1000).alias("net_thousands")
    )
    return sorted_desc(top_with_ties(net, "net_thousands", 5), "net_thousands", ["state"])


@query(
    """SELECT * FROM flow_long
    WHERE current_state IN ('NATION_3', 'NATION_8', 'NATION_21')
       OR origin_state IN ('NATION_3', 'NATION_8', 'NATION_21')""",
    ("flow_long",),
)
def focus_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fl.focus_rows(fx.flow_long(spark, sf), fx.FOCUS_NATIONS)


@query("SELECT * FROM focus_flows", ("focus_flows",))
def focus_flows(spark: SparkSession, sf: str) -> DataFrame:
    return fl.focus_flows(fx.flow_long(spark, sf), fx.FOCUS_NATIONS)


@query("SELECT * FROM top_focus", ("top_focus",))
def top_focus_flows(spark: SparkSession, sf: str) -> DataFrame:
    return fl.top_focus_flows(fx.flow_long(spark, sf), fx.FOCUS_NATIONS)


def _located(spark: SparkSession, sf: str) -> DataFrame:
    points = fx.state_points(spark, sf, ("NATION_4", "NATION_9"))
    top = fl.top_focus_flows(fx.flow_long(spark, sf), fx.FOCUS_NATIONS)
    return fl.with_coordinates(top, points)


LOCATED_SQL = """SELECT t.*, f.lon AS lon_from, f.lat AS lat_from, d.lon AS lon_to, d.lat AS lat_to
    FROM top_focus t JOIN points f ON origin_state = f.name JOIN points d ON current_state = d.name"""


@query(LOCATED_SQL, ("top_focus", "points"))
def top_flow_coords(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf)


@query(
    f"""SELECT *, (migrants - min(migrants) OVER ()) / (max(migrants) OVER () - min(migrants) OVER ())
        * (CAST(3.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) + CAST(0.8 AS DOUBLE) AS line_width
    FROM ({LOCATED_SQL})""",
    ("top_focus", "points"),
)
def flow_line_layer(spark: SparkSession, sf: str) -> DataFrame:
    return flow_lines(_located(spark, sf))


@query(
    "SELECT name, lon, lat FROM points WHERE name IN ('NATION_3', 'NATION_8', 'NATION_21')"
    " AND name IN (SELECT current_state FROM flow_long)",
    ("points", "flow_long"),
)
def focus_points(spark: SparkSession, sf: str) -> DataFrame:
    """Focus regions with flows, as points."""
    points = rename(fx.state_points(spark, sf, ("NATION_4", "NATION_9")), {"NAME": "name"})
    reached = fx.flow_long(spark, sf).select("current_state").distinct()
    return keep_regions(keep_regions(points, "name", reached), "name", fx.FOCUS_NATIONS)


CELLS_SQL = """
    cells AS (
        SELECT 'flows_' || year || '.xlsx' AS file, 'Table' AS sheet, year, "row", col, value FROM (
            SELECT year, dest + 12 AS "row", 2 + 2 * orig AS col,
                   CASE WHEN dest = orig THEN 'N/A'
                        ELSE ' ' || format('{:,}', CAST(total AS BIGINT)) END AS value FROM pair_year
            UNION ALL SELECT year, dest + 12, 3 + 2 * orig, '+/-' || CAST(total AS BIGINT) % 100
            FROM pair_year
            UNION ALL SELECT DISTINCT year, dest + 12, 1, '  ' || n_name || chr(9)
            FROM pair_year JOIN nation ON dest = n_nationkey
            UNION ALL SELECT year, unnest([7, 8, 8, 37, 38]),
                unnest([2 + 2 * orig, 2 + 2 * orig, 3 + 2 * orig, 2 + 2 * orig, 2 + 2 * orig]),
                unnest([n_name || ' ', 'Estimate', 'MOE', format('{:,}', CAST(s AS BIGINT)), n_name])
            FROM (SELECT year, orig, sum(total) AS s FROM pair_year GROUP BY 1, 2)
            JOIN nation ON orig = n_nationkey
            UNION ALL SELECT year, unnest([1, 6, 37, 38]), 1,
                unnest(['Table 1. Flows by current and previous residence', 'Current residence in',
                        'Total', 'Current residence in'])
            FROM (SELECT DISTINCT year FROM pair_year)))
"""


def _cells_oracle(select: str) -> str:
    """The oracle select over the cell table; continues the WITH clause of the fixtures."""
    return f", {CELLS_SQL} {select}"


@query(
    _cells_oracle("""SELECT file, sheet, year, CAST("row" AS INTEGER) AS "row",
        CAST(col AS INTEGER) AS col, value FROM cells"""),
    ("pair_year",),
)
def cells_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks written from the cell table and scanned back."""
    return workbook_cells(fx.workbooks(fx.state_cells(spark, sf)), first_sheet=True)


@query(
    _cells_oracle("""SELECT file, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, value,
        TRY_CAST(nullif(replace(trim(value, ' ' || chr(9)), ',', ''), 'N/A') AS DOUBLE) AS migrants
        FROM cells WHERE "row" >= 12 AND col >= 2"""),
    ("pair_year",),
)
def flow_clean(spark: SparkSession, sf: str) -> DataFrame:
    body = fx.state_cells(spark, sf).where((F.col("row") >= 12) & (F.col("col") >= 2))
    return body.select("file", "row", "col", "value", clean_count(F.col("value")).alias("migrants"))


@query(
    """SELECT d.n_name AS current_state, o.n_name AS origin_state, r.year,
        CASE WHEN r.dest <> h.orig THEN total END AS migrants
    FROM (SELECT DISTINCT year, dest FROM pair_year) r JOIN (SELECT DISTINCT year, orig FROM pair_year) h ON h.year = r.year
    LEFT JOIN pair_year p ON p.year = r.year AND p.dest = r.dest AND p.orig = h.orig
    JOIN nation d ON r.dest = d.n_nationkey JOIN nation o ON h.orig = o.n_nationkey""",
    ("pair_year",),
)
def matrix_header(spark: SparkSession, sf: str) -> DataFrame:
    """A flow for every label and heading of a sheet, missing where the sheet has no cell."""
    cells = fx.state_cells(spark, sf)
    return matrix.flows_from_cells(cells, fx.NATIONS)


@query(
    """SELECT r.n_name AS current_state, o.n_name AS origin_state, r.year,
        CASE WHEN r.dest <> o.n_nationkey THEN total END AS migrants
    FROM (SELECT DISTINCT year, dest, n_name FROM pair_year JOIN nation ON dest = n_nationkey) r
    CROSS JOIN nation o
    LEFT JOIN pair_year p ON p.year = r.year AND p.dest = r.dest AND p.orig = o.n_nationkey""",
    ("pair_year",),
)
def matrix_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.state_cells(spark, sf)
    wide = matrix.matrix_from_cells(cells, fx.NATIONS)
    return matrix.flows_from_matrix(wide)


@query(
    """SELECT current_state, origin_state, year, migrants,
        CASE WHEN year % 2 = 0 THEN 'even' END AS remark FROM flow_long""",
    ("flow_long",),
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Odd and even years stacked: other column order, one column only in the even part."""
    flows = fx.flow_long(spark, sf)
    even = flows.where(F.col("year") % 2 == 0).withColumn("remark", F.lit("even"))
    odd = flows.where(F.col("year") % 2 != 0).select(
        "migrants", "year", "origin_state", "current_state"
    )
    return stack([odd, even]).select(*flows.columns, "remark")


@query("SELECT * FROM flow_long", ("flow_long",))
def union_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Odd and even years stacked with the same columns required."""
    flows = fx.flow_long(spark, sf)
    even = flows.where(F.col("year") % 2 == 0).select(*reversed(flows.columns))
    return stack([flows.where(F.col("year") % 2 != 0), even], strict=True)


@query(
    """SELECT file, CAST(min(year) AS INTEGER) AS year FROM (
        SELECT 'flows_' || year || '.xlsx' AS file, year FROM pair_year) GROUP BY 1""",
    ("pair_year",),
)
def file_years(spark: SparkSession, sf: str) -> DataFrame:
    """The i-th file name gets the i-th year."""
    files = fx.state_cells(spark, sf).select("file").distinct()
    return assign_years(files, range(1995, 2002)).select("file", "year")
