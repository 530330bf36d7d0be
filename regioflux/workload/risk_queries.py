"""Queries on disasters, scores, the risk index and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.classes import factor, ordinal, threshold_rating
from regioflux.functions.text import sanitize_names
from regioflux.operators import groups, profile
from regioflux.operators.ranks import add_percent_rank
from regioflux.operators.tables import points_from_text
from regioflux.plans import hazard_risk as plan
from regioflux.session import new_path, with_folder
from regioflux.sources.typed_csv import TypedCsv, read_typed_csv
from regioflux.workload import fixtures as fx
from regioflux.workload.registry import query

SINCE = 1998
CUTS = (250, 300, 350, 400)
DROPPED = fx.OFF_MAP_NATIONS


def rating_sql(p: str) -> str:
    return f"""CASE WHEN {p} >= 80 THEN 'Very High' WHEN {p} >= 60 THEN 'High'
        WHEN {p} >= 40 THEN 'Moderate' WHEN {p} >= 20 THEN 'Low' WHEN {p} < 20 THEN 'Very Low' END"""


def ordinal_sql(x: str) -> str:
    return f"""CAST(CASE {x} WHEN 'Very Low' THEN 1 WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 3
        WHEN 'High' THEN 4 WHEN 'Very High' THEN 5 END AS INTEGER)"""


def percentile_sql(source: str, key: str, column: str) -> str:
    """(key, p): percent rank times 100 over the present values only."""
    return f"""SELECT {key}, percent_rank() OVER (ORDER BY "{column}") * 100 AS p
        FROM {source} WHERE "{column}" IS NOT NULL"""


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    return groups.recent_incidents(fx.disasters(spark, sf), SINCE)


TOTALS_SQL = """SELECT "STUSPS", CAST(count(*) AS DOUBLE) AS "TotalDisasters" FROM disasters
    WHERE "fyDeclared" >= 1998 GROUP BY 1
    HAVING "STUSPS" IS NULL OR "STUSPS" NOT IN ('NATION_0', 'NATION_24')"""

WIDE_SQL = """SELECT "STUSPS", count(*) FILTER ("incidentType" = '1-URGENT') AS n_urgent,
        count(*) FILTER ("incidentType" = '2-HIGH') AS n_high,
        count(*) FILTER ("incidentType" = '3-MEDIUM') AS n_medium,
        count(*) FILTER ("incidentType" = '4-NOT SPECIFIED') AS n_not_specified,
        count(*) FILTER ("incidentType" = '5-LOW') AS n_low
    FROM disasters WHERE "fyDeclared" >= 1998 GROUP BY 1"""

RANKING_SQL = """CASE WHEN "TotalDisasters" <= 250 THEN 'Very Low' WHEN "TotalDisasters" <= 300 THEN 'Low'
    WHEN "TotalDisasters" <= 350 THEN 'Moderate' WHEN "TotalDisasters" <= 400 THEN 'High'
    WHEN "TotalDisasters" > 400 THEN 'Very High' END"""


@query(TOTALS_SQL, ("disasters",))
def disaster_totals(spark: SparkSession, sf: str) -> DataFrame:
    return groups.incident_totals(_incidents(spark, sf), DROPPED)


@query(
    """SELECT "STUSPS", "incidentType", count(*) AS n FROM disasters WHERE "fyDeclared" >= 1998
    GROUP BY 1, 2""",
    ("disasters",),
)
def incident_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups.incident_counts(_incidents(spark, sf))


@query(WIDE_SQL, ("disasters",))
def incident_wide(spark: SparkSession, sf: str) -> DataFrame:
    return groups.count_wide(_incidents(spark, sf), "STUSPS", "incidentType", fx.PRIORITIES)


@query(
    f"""SELECT n_name AS "STUSPS", "TotalDisasters", n_urgent, n_high, n_medium, n_not_specified, n_low,
        {RANKING_SQL} AS "Disaster_Ranking", {ordinal_sql(f"({RANKING_SQL})")} AS ranking_ordinal
    FROM nation LEFT JOIN ({TOTALS_SQL}) t ON n_name = t."STUSPS"
    LEFT JOIN ({WIDE_SQL}) w ON n_name = w."STUSPS" """,
    ("disasters",),
)
def disaster_layer(spark: SparkSession, sf: str) -> DataFrame:
    states = fx.states(spark, sf).select("STUSPS")
    return plan.disaster_layer(states, _incidents(spark, sf), fx.PRIORITIES, DROPPED, CUTS)


@query(
    f'SELECT *, {RANKING_SQL} AS "Disaster_Ranking" FROM ({TOTALS_SQL})',
    ("disasters",),
)
def disaster_rating(spark: SparkSession, sf: str) -> DataFrame:
    totals = groups.incident_totals(_incidents(spark, sf), DROPPED)
    return totals.withColumn("Disaster_Ranking", threshold_rating(totals["TotalDisasters"], CUTS))


@query(
    """SELECT n_name AS "STUSPS", "fyDeclared", "incidentType", "designatedArea",
        CASE WHEN d."STUSPS" IS NOT NULL THEN CAST(1 AS DOUBLE) END AS "incidentNumber",
        CAST(n_nationkey % 5 AS DOUBLE) + 0.5 AS lon, CAST(n_nationkey // 5 AS DOUBLE) + 0.5 AS lat
    FROM nation LEFT JOIN (SELECT * FROM disasters WHERE "fyDeclared" >= 1998
        AND "STUSPS" NOT IN ('NATION_0', 'NATION_24')) d ON n_name = d."STUSPS" """,
    ("disasters",),
)
def disaster_points(spark: SparkSession, sf: str) -> DataFrame:
    shapes = fx.state_vertices(spark, sf)
    return plan.disaster_points(fx.states(spark, sf), _incidents(spark, sf), shapes, DROPPED)


CVI_SQL = """SELECT n_name AS "STUSPS", m AS "CVI" FROM nation
    LEFT JOIN (SELECT "STATE", avg("CVI_Score") AS m FROM tract_scores GROUP BY 1) ON n_name = "STATE" """


@query(CVI_SQL, ("tract_scores",))
def cvi_state(spark: SparkSession, sf: str) -> DataFrame:
    states = fx.states(spark, sf).select("STUSPS")
    return plan.score_by_state(states, fx.tract_scores(spark, sf))


@query(
    """SELECT code AS "GEOID", "NAME", m AS "CVI"
    FROM (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || c_mktsegment AS code,
              c_mktsegment AS "NAME" FROM customer WHERE c_nationkey <> 7)
    LEFT JOIN (SELECT "GEOID_County", avg("CVI_Score") AS m FROM tract_scores GROUP BY 1)
        ON code = "GEOID_County" """,
    ("tract_scores",),
)
def cvi_county(spark: SparkSession, sf: str) -> DataFrame:
    return plan.score_by_county(fx.score_counties(spark, sf), fx.tract_scores(spark, sf))


@query(
    f"""SELECT s."STUSPS", "CVI", p AS cvi_percentile, {rating_sql("p")} AS cvi_rating
    FROM ({CVI_SQL}) s LEFT JOIN ({percentile_sql(f"({CVI_SQL})", '"STUSPS"', "CVI")}) r
        ON s."STUSPS" = r."STUSPS" """,
    ("tract_scores",),
)
def cvi_rating(spark: SparkSession, sf: str) -> DataFrame:
    return plan.rated(cvi_state(spark, sf), "CVI", "cvi_percentile", "cvi_rating")


RISK_SQL = """SELECT "STATEABBRV", "STATEFIPS",
        CASE WHEN count(*) FILTER ("RISK_SCORE" IS NOT NULL AND "POPULATION" IS NULL) = 0 THEN
            CAST(sum("RISK_SCORE" * "POPULATION") AS DOUBLE)
            / nullif(CAST(sum("POPULATION") FILTER ("RISK_SCORE" IS NOT NULL) AS DOUBLE), 0)
        END AS state_risk_score,
        CAST(coalesce(sum("POPULATION"), 0) AS BIGINT) AS total_population, count(*) AS n_counties
    FROM risk_counties WHERE "STATEABBRV" NOT IN ('NATION_0', 'NATION_24') GROUP BY 1, 2"""


@query(
    f"""SELECT s.*, p AS risk_percentile, {rating_sql("p")} AS state_risk_ratng
    FROM ({RISK_SQL}) s
    LEFT JOIN ({percentile_sql(f"({RISK_SQL})", '"STATEABBRV"', "state_risk_score")}) r
        ON s."STATEABBRV" = r."STATEABBRV" """,
    ("risk_counties",),
)
def nri_state_risk(spark: SparkSession, sf: str) -> DataFrame:
    return plan.state_risk(fx.risk_counties(spark, sf), DROPPED)


def _indicator_sql() -> str:
    joins = "\n".join(
        f"""LEFT JOIN ({percentile_sql("indicators", '"Name"', c)}) r{i} ON r{i}."Name" = s."Name" """
        for i, c in enumerate(fx.INDICATORS)
    )
    columns = ", ".join(
        f'"{c}", r{i}.p AS "{c}_percentile", {rating_sql(f"r{i}.p")} AS "{c}_rating"'
        for i, c in enumerate(fx.INDICATORS)
    )
    return f'SELECT s."Name", {columns} FROM indicators s {joins}'


@query(_indicator_sql(), ("indicators",))
def indicator_ratings(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.indicators(spark, sf).drop("Source")
    return plan.rated_columns(table, "Name", fx.INDICATORS)


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
        percent_rank() OVER (ORDER BY l_extendedprice) * 100 AS price_percentile FROM lineitem"""
)
def pct_rank_scale(spark: SparkSession, sf: str) -> DataFrame:
    prices = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return add_percent_rank(prices, "l_extendedprice", "price_percentile")


@query(
    f"""SELECT "STCOFIPS" AS "GEOID", {ordinal_sql('"RISK_RATNG"')} AS class_index,
        6 - {ordinal_sql('"RISK_RATNG"')} AS class_index_reversed FROM risk_counties""",
    ("risk_counties",),
)
def rating_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    rating = F.col("RISK_RATNG")
    return fx.risk_counties(spark, sf).select(
        F.col("STCOFIPS").alias("GEOID"),
        ordinal(rating).alias("class_index"),
        ordinal(rating, reverse=True).alias("class_index_reversed"),
    )


@query(
    """SELECT "STCOFIPS" AS "GEOID", "COUNTY" AS "County", "STATEABBRV" AS "State",
        "RISK_SCORE" AS "Risk_Score",
        CASE WHEN "RISK_RATNG" <> 'No Rating' THEN "RISK_RATNG" END AS "Risk_Rating",
        "COUNTY" || ', ' || "STATEABBRV" AS "Name" FROM risk_counties""",
    ("risk_counties",),
)
def region_label(spark: SparkSession, sf: str) -> DataFrame:
    return plan.region_label(fx.risk_counties(spark, sf))


def _summary_sql(column: str) -> str:
    x = f'CAST("{column}" AS DOUBLE)'
    quarters = ", ".join(
        f"quantile_cont({x}, CAST({p} AS DOUBLE)) AS {name}"
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return f"""SELECT '{column}' AS field, min({x}) AS min, {quarters}, max({x}) AS max,
        CAST(sum("{column}") AS DOUBLE) / count("{column}") AS mean, count("{column}") AS n,
        count(*) - count("{column}") AS missing FROM risk_counties"""


@query(
    _summary_sql("RISK_SCORE") + " UNION ALL " + _summary_sql("POPULATION"), ("risk_counties",)
)
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return profile.numeric_summary(fx.risk_counties(spark, sf), ("RISK_SCORE", "POPULATION"))


@query(
    """SELECT 'RISK_RATNG' AS field,
        CASE WHEN "RISK_RATNG" <> 'No Rating' THEN "RISK_RATNG" END AS level, count(*) AS n
    FROM risk_counties GROUP BY 2
    UNION ALL SELECT 'STATEABBRV', "STATEABBRV", count(*) FROM risk_counties GROUP BY 2""",
    ("risk_counties",),
)
def profile_levels(spark: SparkSession, sf: str) -> DataFrame:
    counties = fx.risk_counties(spark, sf)
    rated = counties.withColumn("RISK_RATNG", factor(counties["RISK_RATNG"]))
    return profile.level_counts(rated, ("RISK_RATNG", "STATEABBRV"))


@query(
    """SELECT count(*) - count("STCOFIPS") AS "STCOFIPS", count(*) - count("COUNTY") AS "COUNTY",
        count(*) - count("STATEABBRV") AS "STATEABBRV", count(*) - count("STATEFIPS") AS "STATEFIPS",
        count(*) - count("RISK_SCORE") AS "RISK_SCORE", count(*) - count("POPULATION") AS "POPULATION",
        count(*) - count("RISK_RATNG") AS "RISK_RATNG",
        coalesce(bool_or("RISK_SCORE" IS NULL OR "POPULATION" IS NULL), false) AS any_missing
    FROM risk_counties""",
    ("risk_counties",),
)
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_counts(fx.risk_counties(spark, sf))


@query(
    """SELECT * EXCLUDE (copy) FROM (
        SELECT *, row_number() OVER (PARTITION BY COLUMNS(*)) AS copy FROM (
            SELECT * FROM risk_counties
            UNION ALL SELECT * FROM risk_counties WHERE CAST("STCOFIPS" AS BIGINT) % 50 = 0))
    WHERE copy > 1""".replace(
        "COLUMNS(*)",
        '"STCOFIPS", "COUNTY", "STATEABBRV", "STATEFIPS", "RISK_SCORE", "POPULATION", "RISK_RATNG"',
    ),
    ("risk_counties",),
)
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.repeated_rows(fx.doubled_counties(spark, sf))


@query(
    """SELECT r."STCOFIPS" AS "GEOID", r."COUNTY" AS "County", r."STATEABBRV" AS "State",
        b."COUNTY" || ' County, ' || b."STATEABBRV" AS "Name"
    FROM risk_counties r LEFT JOIN (SELECT * FROM risk_counties
        WHERE CAST("STCOFIPS" AS BIGINT) % 3 <> 0) b ON r."STCOFIPS" = b."STCOFIPS" """,
    ("risk_counties",),
)
def id_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Two county sources compared by code; every third code has no boundary."""
    counties = fx.risk_counties(spark, sf)
    boundaries = counties.where(F.col("STCOFIPS").cast("bigint") % 3 != 0).select(
        F.col("STCOFIPS").alias("GEOID"),
        F.concat("COUNTY", F.lit(" County")).alias("NAMELSAD"),
        F.col("STATEABBRV").alias("STUSPS"),
    )
    return plan.id_mismatches(counties, boundaries)


INDICATOR_SCHEMA = (
    "`Name` string, `Source` string, `Temperature` bigint, `Droughts` bigint, `Storms` bigint, "
    "`Wild fires & smoke` bigint, `Flooding` bigint"
)


@query(
    """SELECT "Name", lat || ',' || lon AS "Source", "Temperature", "Droughts", "Storms",
        "Wildfires" AS wild_fires_smoke, "Flooding" FROM indicators""",
    ("indicators",),
)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators as CSV lines and read back, the lines never leaving the plan."""
    raw = fx.indicators(spark, sf).withColumnRenamed("Wildfires", "Wild fires & smoke")
    lines = raw.select(F.to_csv(F.struct(*[raw[f"`{c}`"] for c in raw.columns])).alias("line"))
    back = lines.select(F.from_csv("line", INDICATOR_SCHEMA).alias("row")).select("row.*")
    return back.toDF(*sanitize_names(back.columns)).withColumnRenamed("Wild.fires...smoke", "wild_fires_smoke")


@query(
    """SELECT "Name", lat, lon, "Temperature", "Droughts", "Storms", "Wildfires", "Flooding"
    FROM indicators""",
    ("indicators",),
)
def split_latlon(spark: SparkSession, sf: str) -> DataFrame:
    return points_from_text(fx.indicators(spark, sf))


def _typed_orders(spark: SparkSession, sf: str) -> TypedCsv:
    """The orders written as CSV files in the shared folder and scanned."""
    path = new_path(with_folder(spark), "orders-csv")
    fx.order_lines(spark, sf).write.text(path)
    return read_typed_csv(spark, path, fx.ORDER_FIELDS)


@query(
    """SELECT o_orderkey AS order_key, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS clerk_code,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS price,
        strftime(o_orderdate, '%Y-%m-%d') AS placed, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus = 'O' END AS open,
        'said "' || o_orderpriority || '", twice' AS note
    FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0"""
)
def csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from CSV files with the types told from the data; the day is shown as text."""
    return _typed_orders(spark, sf).rows.withColumn("placed", F.date_format("placed", "yyyy-MM-dd"))


@query(
    """SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'surplus' ELSE 'short' END AS kind, count(*) AS n
    FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 GROUP BY 1"""
)
def csv_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Malformed records of the orders' CSV files by kind."""
    kind = F.when(F.endswith("line", F.lit(",surplus")), "surplus").otherwise("short")
    return _typed_orders(spark, sf).malformed.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _hazard_sql() -> str:
    """The eleven maps' columns by region, each rank among the regions that have the value."""
    ranks = "".join(
        f''', CASE WHEN "{m.column}" IS NOT NULL THEN percent_rank() OVER (PARTITION BY "{m.column}" IS NULL ORDER BY "{m.column}") * 100 END
            AS {m.percentile}'''
        for m in plan.MAPS
        if m.percentile
    )
    ratings = "".join(f", {rating_sql(m.percentile) if m.percentile else RANKING_SQL} AS \"{m.rating}\"" for m in plan.MAPS)
    return f""", social AS (
        SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS losses, count(*) FILTER (c_custkey % 3 = 0) AS housing,
            nullif(count(*) FILTER (c_acctbal < 0) % 7, 0) AS stressors
        FROM customer GROUP BY 1
    ), scores AS (
        SELECT n_name AS region, CASE WHEN listed THEN CAST(n_nationkey AS INTEGER) END AS geo_id, CASE WHEN listed THEN "CVI" END AS "CVI",
            CASE WHEN listed THEN "TotalDisasters" END AS "TotalDisasters", state_risk_score,
            CASE WHEN n_nationkey <> 9 THEN losses END AS "Economic_Productivity_Losses", housing AS "Housing_Type_Transportation",
            stressors AS "Socioeconomic_Stressors", "Temperature", "Droughts", "Storms", "Wildfires", "Flooding",
            listed AS on_cvi, listed AS on_disasters, r."STATEABBRV" IS NOT NULL AS on_risk,
            n_nationkey <> 9 AND social.c_nationkey IS NOT NULL AS on_economy, social.c_nationkey IS NOT NULL AS on_society, true AS on_events
        FROM (SELECT *, n_name NOT IN ('NATION_1', 'NATION_24') AS listed FROM nation)
        LEFT JOIN ({CVI_SQL}) c ON c."STUSPS" = n_name LEFT JOIN ({TOTALS_SQL}) t ON t."STUSPS" = n_name
        LEFT JOIN ({RISK_SQL}) r ON r."STATEABBRV" = n_name LEFT JOIN social ON social.c_nationkey = n_nationkey
        LEFT JOIN indicators i ON i."Name" = n_name
    ), ratings AS (SELECT *{ratings} FROM (SELECT *{ranks} FROM scores))
    """


HAZARD_FIXTURES = ("disasters", "tract_scores", "risk_counties", "indicators")
LAYERS_SQL = ", layers AS (" + " UNION ALL ".join(
    f'''SELECT '{m.name}' AS map, region, geo_id, CAST("{m.column}" AS DOUBLE) AS value, "{m.rating}" AS class,
        {ordinal_sql(f'"{m.rating}"')} AS class_index,
        'Name: ' || region || '<br>{m.popup}' || coalesce("{m.rating}", 'NA')'''
    + (""" || '<br>Total Disasters Since 2010: ' || coalesce(CAST(CAST("TotalDisasters" AS BIGINT) AS VARCHAR), 'NA')""" if m.name == "disasters" else "")
    + f" AS popup FROM ratings WHERE on_{m.source}"
    for m in plan.MAPS
) + ")\n"


def _hazards(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    economy, society = fx.social_indicators(with_folder(spark), sf)
    inputs = plan.Hazards(
        fx.states(spark, sf), economy, society, fx.indicators(spark, sf).drop("Source"), fx.tract_scores(spark, sf), fx.disasters(spark, sf), fx.risk_counties(spark, sf)
    )
    return plan.analyse(inputs, ("NATION_1", "NATION_24"), DROPPED, SINCE, CUTS)


@query(_hazard_sql() + "SELECT * FROM ratings", HAZARD_FIXTURES)
def hazard_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ten percentile ratings and the disaster rating of every region."""
    return _hazards(spark, sf)["ratings"]


@query(_hazard_sql() + LAYERS_SQL + "SELECT * FROM layers", HAZARD_FIXTURES)
def hazard_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of all eleven maps with class and popup."""
    return _hazards(spark, sf)["layers"]


@query(
    _hazard_sql()
    + LAYERS_SQL
    + "SELECT m AS map, title, CAST(position AS INTEGER) AS position, l.level, count(region) AS regions FROM (VALUES "
    + ", ".join(f"('{m.name}', '{m.title}')" for m in plan.MAPS)
    + """) AS maps(m, title), (VALUES (1, 'Very Low'), (2, 'Low'), (3, 'Moderate'), (4, 'High'), (5, 'Very High')) AS l(position, level)
    LEFT JOIN layers ON map = m AND class = l.level GROUP BY m, title, position, l.level""",
    HAZARD_FIXTURES,
)
def hazard_legends(spark: SparkSession, sf: str) -> DataFrame:
    """The legends of all eleven maps with the number of regions of each class."""
    return _hazards(spark, sf)["legends"]
