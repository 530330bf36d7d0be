"""Indicators, disasters and the risk index to ratings and map layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.functions.classes import (
    DISASTER_CUTS,
    RATING_LEVELS,
    factor,
    ordinal,
    percentile_rating,
    threshold_rating,
)
from regioflux.functions.missing import not_in
from regioflux.functions.regions import DISASTER_TERRITORIES, TERRITORIES
from regioflux.functions.text import number_text, pad_code, paste
from regioflux.operators import groups
from regioflux.operators.geometry import centroids
from regioflux.operators.ranks import add_percent_rank, add_percent_ranks
from regioflux.operators.tables import expand_left_join, named, natural_left_join, points_from_text, rename
from regioflux.session import settled
from regioflux.sources.typed_csv import read_typed_csv


class Map(NamedTuple):
    """One map: the rated column of a source, its rank and class, the popup's text before the class, and the legend's title."""

    name: str
    source: str
    column: str
    percentile: str | None
    rating: str
    popup: str
    title: str


# The maps' columns, texts and titles.
MAPS = (
    Map("risk", "risk", "state_risk_score", "risk_percentile", "state_risk_ratng", "State Risk Rating: ", "NRI Risk Rating by State"),
    Map("cvi", "cvi", "CVI", "cvi_percentile", "cvi_rating", "Climate Vulnerability Rating: ", "Climate Vulnerability Rating by State"),
    Map("disasters", "disasters", "TotalDisasters", None, "Disaster_Ranking", "Disaster Ranking: ", "FEMA Disaster Exposure by State"),
    Map("economy", "economy", "Economic_Productivity_Losses", "econ_percentile", "econ_loss_rating", "Economic Loss Rating ", "Economic Productivity Losses by State"),
    Map("housing", "society", "Housing_Type_Transportation", "housing_percentile", "housing_rating", "Housing & Transportation Inaccessibility: ", "Housing & Transportation Inaccessibility by State"),
    Map("stressors", "society", "Socioeconomic_Stressors", "socioecon_percentile", "socioecon_rating", "Socioeconomic Stressors: ", "Socioeconomic Stressors by State"),
    Map("temperature", "events", "Temperature", "temp_percentile", "temp_rating", "Vulnerability to Extreme Temperatures: ", "Vulnerability to Extreme Temperatures by State"),
    Map("droughts", "events", "Droughts", "dr_percentile", "dr_rating", "Vulnerability to Droughts: ", "Vulnerability to Droughts by State"),
    Map("storms", "events", "Storms", "storm_percentile", "storm_rating", "Vulnerability to Extreme Storms: ", "Vulnerability to Extreme Storms by State"),
    Map("wildfires", "events", "Wildfires", "fire_percentile", "fire_rating", "Vulnerability to Wildfires: ", "Vulnerability to Wildfires by State"),
    Map("flooding", "events", "Flooding", "flood_percentile", "flood_rating", "Vulnerability to Flooding: ", "Vulnerability to Flooding by State"),
)
DISASTER_POPUP = "Total Disasters Since 2010: "
SINCE = 2010
SOURCES = ("economy", "society", "events")


class Hazards(NamedTuple):
    """The inputs. states has (geo_id, STUSPS); economy, society and events one row for each region, called Name."""

    states: DataFrame
    economy: DataFrame
    society: DataFrame
    events: DataFrame
    tracts: DataFrame
    incidents: DataFrame
    counties: DataFrame


def read_hazards(spark: SparkSession, states: DataFrame, counties: DataFrame, paths: Mapping[str, str]) -> Hazards:
    """The CSV files named by economy, society, events, tracts and incidents, beside tables of states and of counties with their risk.

    Header texts become names with single underscores; 'lat,lon' texts of the indicators become two columns; the second column of the incidents
    is the state's code. Malformed records are left out; read_typed_csv gives them.
    """

    def read(name: str) -> DataFrame:
        rows = read_typed_csv(spark, paths[name]).rows
        return rows.toDF(*("_".join(filter(None, c.replace(".", "_").split("_"))) for c in rows.columns))

    economy, society, events = (points_from_text(read(name)) for name in SOURCES)
    return Hazards(states, economy, society, events, read("tracts"), rename(read("incidents"), {2: "STUSPS"}), counties)


def hazard_scores(
    inputs: Hazards, territories: Sequence[str] = TERRITORIES, dropped: Sequence[str] = DISASTER_TERRITORIES, since: int = SINCE
) -> DataFrame:
    """(region, geo_id, every map's column, on_<source>): one row for each region that any source names.

    on_<source> tells whether the region is on the maps of the source: a listed state, or a region that the source itself has. Regions without a
    name are left out.
    """
    listed = inputs.states.where(not_in(inputs.states["STUSPS"], territories)).select("geo_id", "STUSPS")
    shown = F.lit(True)
    cvi = score_by_state(listed.select("STUSPS"), inputs.tracts).select("STUSPS", "CVI")
    totals = groups.incident_totals(groups.recent_incidents(inputs.incidents, since), dropped)
    states = natural_left_join(natural_left_join(listed, cvi), totals).withColumnRenamed("STUSPS", "region")
    parts = [states.withColumns({"on_cvi": shown, "on_disasters": shown})]
    risk = state_scores(inputs.counties, dropped).select(F.col("STATEABBRV").alias("region"), "state_risk_score")
    parts.append(risk.withColumn("on_risk", shown))
    for source in SOURCES:
        table = getattr(inputs, source)
        columns = [named(table, m.column) for m in MAPS if m.source == source]
        parts.append(table.select(table["Name"].alias("region"), *columns, shown.alias(f"on_{source}")))
    joined = reduce(lambda a, b: a.join(b.where("region IS NOT NULL"), "region", "full"), parts[1:], parts[0].where("region IS NOT NULL"))
    flags = [c for c in joined.columns if c.startswith("on_")]
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def hazard_ratings(scores: DataFrame, cuts: Sequence[float] = DISASTER_CUTS) -> DataFrame:
    """The scores with ten percent ranks, each among the regions that have the value, their ratings, and the rating of the disasters by cuts.

    All ranks come from one set of shuffles. A region that a source repeats is an error.
    """
    ranked = add_percent_ranks(scores, "region", [m.column for m in MAPS if m.percentile])
    ranked = ranked.withColumnsRenamed({f"{m.column}_percentile": m.percentile for m in MAPS if m.percentile})
    rating = lambda m: percentile_rating(F.col(m.percentile)) if m.percentile else threshold_rating(F.col(m.column), cuts)
    return ranked.withColumns({m.rating: rating(m) for m in MAPS})


def hazard_layers(ratings: DataFrame) -> DataFrame:
    """(map, region, geo_id, value, class, class_index, popup): every map's regions in one table."""

    def entry(m: Map) -> Column:
        lines: list[Column | str] = ["Name: ", F.col("region"), "<br>", m.popup, F.col(m.rating)]
        if m.name == "disasters":
            lines += ["<br>", DISASTER_POPUP, number_text(F.col(m.column))]
        fields = {
            "map": F.lit(m.name),
            "value": F.col(m.column).cast("double"),
            "class": F.col(m.rating),
            "class_index": ordinal(F.col(m.rating)),
            "popup": paste(*lines, sep=""),
        }
        return F.when(F.col(f"on_{m.source}"), F.struct(*(v.alias(k) for k, v in fields.items())))

    return ratings.select("region", "geo_id", F.explode(F.array_compact(F.array(*map(entry, MAPS)))).alias("e")).select(
        "e.map", "region", "geo_id", "e.value", "e.class", "e.class_index", "e.popup"
    )


def hazard_legends(layers: DataFrame) -> DataFrame:
    """(map, title, position, level, regions): every map's levels in order, also those no region has."""
    levels = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(level).alias("level")) for i, level in enumerate(RATING_LEVELS, start=1)))
    titles = F.array(*(F.struct(F.lit(m.name).alias("map"), F.lit(m.title).alias("title")) for m in MAPS))
    entries = layers.sparkSession.range(1).select(F.inline(titles)).select("map", "title", F.inline(levels))
    counts = layers.groupBy("map", F.col("class").alias("level")).agg(F.count("*").alias("regions"))
    return entries.join(counts, ["map", "level"], "left").select("map", "title", "position", "level", F.coalesce("regions", F.lit(0)).alias("regions"))


def analyse(
    inputs: Hazards,
    territories: Sequence[str] = TERRITORIES,
    dropped: Sequence[str] = DISASTER_TERRITORIES,
    since: int = SINCE,
    cuts: Sequence[float] = DISASTER_CUTS,
    settle: Callable[[DataFrame], DataFrame] = settled,
) -> dict[str, DataFrame]:
    """ratings, layers and legends of all maps. The scores, one row for each region, are settled, so the sources are read once."""
    ratings = hazard_ratings(settle(hazard_scores(inputs, territories, dropped, since)), cuts)
    layers = hazard_layers(ratings)
    return {"ratings": ratings, "layers": layers, "legends": hazard_legends(layers)}


def rated(df: DataFrame, column: str, percentile: str, rating: str) -> DataFrame:
    """Percentile over all regions and its five-level rating."""
    ranked = add_percent_rank(df, column, percentile)
    return ranked.withColumn(rating, percentile_rating(ranked[percentile]))


def rated_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Percentile and rating for each of several indicators."""
    ranked = add_percent_ranks(df, key, columns)
    return ranked.withColumns(
        {f"{c}_rating": percentile_rating(ranked[f"{c}_percentile"]) for c in columns}
    )


def score_by_state(states: DataFrame, tracts: DataFrame) -> DataFrame:
    """Mean tract score per state joined to all states."""
    means = groups.group_mean(tracts, "STATE", "CVI_Score", "CVI").withColumnRenamed("STATE", "STUSPS")
    return natural_left_join(states, means)


def score_by_county(counties: DataFrame, tracts: DataFrame, digits: int = 5) -> DataFrame:
    """Mean tract score per county joined to all counties; codes are compared zero-padded."""
    padded = tracts.withColumn("GEOID", pad_code(F.col("GEOID_County"), digits))
    means = groups.group_mean(padded, "GEOID", "CVI_Score", "CVI")
    coded = counties.withColumn("GEOID", pad_code(F.col("GEOID"), digits))
    return natural_left_join(coded, means)


def disaster_layer(
    states: DataFrame,
    incidents: DataFrame,
    incident_types: Mapping[str, str] | Sequence[str],
    dropped: Sequence[str] = DISASTER_TERRITORIES,
    cuts: Sequence[float] = DISASTER_CUTS,
) -> DataFrame:
    """States with total, incidents by type and threshold rating, from one pass over the incidents."""
    measures = groups.count_wide(
        incidents, "STUSPS", "incidentType", incident_types, {"TotalDisasters": "incidentNumber"}
    )
    listed = not_in(measures["STUSPS"], dropped)
    measures = measures.withColumn("TotalDisasters", F.when(listed, measures["TotalDisasters"]))
    joined = states.join(measures, "STUSPS", "left")
    rating = threshold_rating(joined["TotalDisasters"], cuts)
    return joined.withColumns(
        {"Disaster_Ranking": rating, "ranking_ordinal": ordinal(rating, RATING_LEVELS)}
    )


def disaster_points(
    states: DataFrame,
    incidents: DataFrame,
    vertices: DataFrame,
    dropped: Sequence[str] = DISASTER_TERRITORIES,
) -> DataFrame:
    """Each state (geo_id, STUSPS) once per incident, at its centroid."""
    kept = incidents.where(not_in(incidents["STUSPS"], dropped)).select(
        "STUSPS", "fyDeclared", "incidentType", "designatedArea", "incidentNumber"
    )
    points = centroids(vertices).select("geo_id", "lon", "lat")
    located = states.join(points, "geo_id", "left").drop("geo_id")
    return expand_left_join(located, kept, "STUSPS")


def region_label(counties: DataFrame) -> DataFrame:
    """County table with display name and declared rating levels."""
    return counties.select(
        F.col("STCOFIPS").alias("GEOID"),
        F.col("COUNTY").alias("County"),
        F.col("STATEABBRV").alias("State"),
        F.col("RISK_SCORE").alias("Risk_Score"),
        factor(F.col("RISK_RATNG")).alias("Risk_Rating"),
        paste(F.col("COUNTY"), F.col("STATEABBRV"), sep=", ").alias("Name"),
    )


def state_scores(counties: DataFrame, dropped: Sequence[str] = DISASTER_TERRITORIES) -> DataFrame:
    """Population-weighted county risk per state, the population and the number of counties."""
    kept = counties.where(not_in(counties["STATEABBRV"], dropped))
    names = ("state_risk_score", "total_population", "n_counties")
    return groups.group_weighted(kept, ["STATEABBRV", "STATEFIPS"], "RISK_SCORE", "POPULATION", names)


def state_risk(counties: DataFrame, dropped: Sequence[str] = DISASTER_TERRITORIES) -> DataFrame:
    """Population-weighted county risk per state with percentile and rating."""
    return rated(state_scores(counties, dropped), "state_risk_score", "risk_percentile", "state_risk_ratng")


def id_mismatches(counties: DataFrame, boundaries: DataFrame, digits: int = 5) -> DataFrame:
    """Risk counties with the display name the boundary table has for their code, null if it has none.

    Codes are compared, and returned, padded with zeros.
    """
    name = paste(F.col("NAMELSAD"), F.col("STUSPS"), sep=", ").alias("Name")
    names = boundaries.select(pad_code(F.col("GEOID"), digits).alias("GEOID"), name)
    ids = counties.select(
        pad_code(F.col("STCOFIPS"), digits).alias("GEOID"),
        F.col("COUNTY").alias("County"),
        F.col("STATEABBRV").alias("State"),
    )
    return ids.join(names, "GEOID", "left")
