"""The hazard analysis from files to ratings, layers and legends."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from regioflux.plans import hazard_risk as plan

COUNTIES = "STATEABBRV string, STATEFIPS string, RISK_SCORE double, POPULATION bigint"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hazards")
    files = {
        "economy": 'Name,Source,Economic & Productivity Losses\nOH,"40.5,-82.7",3\nMI,"44,-85",1.5\nPR,"18,-66",9\n',
        "society": 'Name,Source,Housing Type & Transportation,Socioeconomic Stressors\nOH,"40.5,-82.7",1,1\nMI,"44,-85",NA,2\n',
        "events": 'Name,Source,Temperature,Droughts,Storms,Wildfires,Flooding\nOH,"40.5,-82.7",1,2,3,4,5\nMI,"44,-85",1,1,4,3,6\n',
        "tracts": "STATE,GEOID County,CVI Score\nOH,01001,0.25\nOH,01001,0.75\nMI,26001,NA\nPR,72001,0.9\n",
        "incidents": "disasterNumber,state,fyDeclared,incidentType,designatedArea\n" + "1,OH,2012,Flood,A\n" * 150 + "2,OH,2009,Fire,B\n3,MI,2011,Fire,C\n4,PR,2011,Fire,D\nbroken,XX\n",
    }
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    states = spark.createDataFrame([(1, "OH"), (2, "MI"), (3, "PR"), (4, "WY")], "geo_id bigint, STUSPS string")
    counties = spark.createDataFrame([("OH", "39", 10.0, 1), ("OH", "39", 40.0, 2), ("MI", "26", 50.0, 5), ("PR", "72", 99.0, 9), ("GU", "66", 1.0, 1)], COUNTIES)
    return plan.read_hazards(spark, states, counties, {name: str(folder / f"{name}.csv") for name in files})


@pytest.fixture(scope="module")
def results(inputs):
    return plan.analyse(inputs, settle=lambda df: df)


def test_files_become_typed_tables(inputs):
    assert dict(inputs.economy.dtypes) == {"Name": "string", "lat": "double", "lon": "double", "Economic_Productivity_Losses": "double"}
    assert dict(inputs.tracts.dtypes) == {"STATE": "string", "GEOID_County": "string", "CVI_Score": "double"}
    assert rows(inputs.society, "Housing_Type_Transportation", "Socioeconomic_Stressors") == [(None, 2), (1, 1)]
    assert inputs.incidents.columns[1] == "STUSPS" and inputs.incidents.count() == 153


def test_ratings(results):
    found = {r.region: r for r in results["ratings"].collect()}
    assert set(found) == {"OH", "MI", "PR", "WY"}
    assert (found["OH"].state_risk_score, found["OH"].risk_percentile, found["OH"].state_risk_ratng) == (30.0, 0.0, "Very Low")
    assert (found["MI"].risk_percentile, found["MI"].state_risk_ratng) == (100.0, "Very High")
    # The mean of the only state with scores has no rank. The territory is on no map of the states but on those of its indicators.
    assert (found["OH"].CVI, found["OH"].cvi_percentile, found["OH"].cvi_rating, found["MI"].CVI) == (0.5, None, None, None)
    assert (found["PR"].geo_id, found["PR"].CVI, found["PR"].econ_percentile, found["OH"].econ_percentile) == (None, None, 100.0, 50.0)
    assert [found[s].Disaster_Ranking for s in ("OH", "MI", "PR", "WY")] == ["Low", "Very Low", None, None]
    assert (found["OH"].temp_rating, found["OH"].dr_rating, found["MI"].dr_rating) == ("Very Low", "Very High", "Very Low")


def test_layers(results):
    shown = {(r.map, r.region): r for r in results["layers"].collect()}
    assert {region for name, region in shown if name == "cvi"} == {"OH", "MI", "WY"}
    assert {region for name, region in shown if name == "economy"} == {"OH", "MI", "PR"}
    assert {region for name, region in shown if name == "risk"} == {"OH", "MI"}
    assert shown["economy", "PR"].popup == "Name: PR<br>Economic Loss Rating Very High"
    assert shown["disasters", "OH"].popup == "Name: OH<br>Disaster Ranking: Low<br>Total Disasters Since 2010: 150"
    assert shown["disasters", "WY"].popup.endswith("Disaster Ranking: NA<br>Total Disasters Since 2010: NA")
    assert (shown["droughts", "OH"].value, shown["droughts", "OH"].class_index) == (2.0, 5)
    assert len(shown) == 3 + 3 + 2 + 3 + 7 * 2


def test_legends(results):
    found = results["legends"].orderBy("map", "position").collect()
    assert len(found) == 55 and {r.map for r in found} == {m.name for m in plan.MAPS}
    assert [(r.level, r.regions) for r in found if r.map == "droughts"] == [("Very Low", 1), ("Low", 0), ("Moderate", 0), ("High", 0), ("Very High", 1)]


def test_repeated_nameless_and_empty_sources(spark, inputs):
    twice = inputs._replace(society=inputs.society.union(inputs.society))
    with pytest.raises(Exception, match="repeated region"):
        plan.analyse(twice, settle=lambda df: df)["ratings"].collect()
    nameless = inputs._replace(events=inputs.events.withColumn("Name", F.when(F.col("Name") == "OH", F.col("Name"))), counties=inputs.counties.where("false"))
    found = plan.analyse(nameless, settle=lambda df: df)
    assert rows(found["ratings"].where("on_events"), "region") == [("OH",)]
    assert found["layers"].where("map = 'risk'").count() == 0 and found["legends"].count() == 55


def test_sources_are_read_once(inputs):
    scores = plan.hazard_scores(inputs)
    plan_text = scores._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("FileScan csv") == 5 and "BroadcastNestedLoopJoin" not in plan_text and "CartesianProduct" not in plan_text
