"""Flow operators: hand-computed cases, conservation properties and the end-to-end state analysis."""

from __future__ import annotations

import random

import pytest

from conftest import rows
from regioflux.operators import flows as fl
from regioflux.plans import state_flows

SCHEMA = "current_state string, origin_state string, year int, migrants double"


@pytest.fixture(scope="module")
def flows(spark):
    data = [
        ("Ohio", "Texas", 2021, 10.0),
        ("Ohio", "Texas", 2022, 30.0),
        ("Ohio", "Ohio", 2021, 99.0),
        ("Texas", "Ohio", 2021, 5.0),
        ("Texas", "Michigan", 2022, None),
        ("Michigan", "Florida", 2022, 7.0),
        (None, "Ohio", 2022, 4.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    names = [f"R{i}" for i in range(8)]
    data = [
        (rng.choice(names[:7]), rng.choice(names[1:]), rng.randint(2016, 2019), float(rng.randint(0, 50)))
        for _ in range(600)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_totals(flows):
    assert rows(fl.arrivals(flows)) == [(None, 4.0), ("Michigan", 7.0), ("Ohio", 139.0), ("Texas", 5.0)]
    moved = fl.between_regions(flows)
    assert rows(fl.arrivals(moved)) == [("Michigan", 7.0), ("Ohio", 40.0), ("Texas", 5.0)]
    assert rows(fl.departures(moved)) == [("Florida", 7.0), ("Michigan", 0.0), ("Ohio", 5.0), ("Texas", 40.0)]


def test_balance(flows):
    assert rows(fl.balance(flows)) == [
        ("Florida", 0.0, 7.0, -7.0),
        ("Michigan", 7.0, 0.0, 7.0),
        ("Ohio", 40.0, 5.0, 35.0),
        ("Texas", 5.0, 40.0, -35.0),
    ]
    assert rows(fl.balance(flows, ["year"], ["Ohio"], ("a", "b"))) == [
        (2021, "Ohio", 10.0, 5.0, 5.0),
        (2022, "Ohio", 30.0, 0.0, 30.0),
    ]


def test_balance_equals_full_join(many):
    moved = fl.between_regions(many)
    for by in ([], ["year"]):
        joined = fl.net_of(fl.arrivals(moved, by), fl.departures(moved, by), [*by, "state"])
        assert rows(fl.balance(many, by)) == rows(joined)


def test_nothing_is_lost(many):
    total = [sum(c) for c in zip(*rows(fl.balance(many), "inflow", "outflow", "net_migration"))]
    assert total[0] == total[1] > 0
    assert total[2] == 0


def test_inflow_change(flows):
    assert rows(fl.inflow_change(flows, 2021, 2022)) == [
        ("Michigan", None, 7.0, None),
        ("Ohio", 10.0, 30.0, 20.0),
        ("Texas", 5.0, 0.0, -5.0),
    ]


def test_focus(flows):
    assert fl.focus_rows(flows, ["Ohio"]).count() == 5
    assert rows(fl.focus_flows(flows, ["Ohio", "Texas"])) == [
        ("Michigan", "Texas", 0.0, "Inflow"),
        ("Ohio", "Texas", 5.0, "Inflow"),
        ("Texas", "Ohio", 40.0, "Inflow"),
    ]
    found = rows(fl.focus_flows(flows, ["Michigan"]))
    assert found == [("Florida", "Michigan", 7.0, "Inflow"), ("Michigan", "Texas", 0.0, "Outflow")]
    assert rows(fl.top_focus_flows(flows, ["Ohio", "Texas"], 1), "origin_state") == [("Texas",)]


def test_coordinates(spark, flows):
    points = spark.createDataFrame([("Ohio", 1.0, 2.0), ("Texas", 3.0, 4.0)], "NAME string, lon double, lat double")
    located = fl.with_coordinates(fl.focus_flows(flows, ["Ohio", "Texas"]), points)
    assert rows(located, "origin_state", "lon_from", "lat_from", "lon_to", "lat_to") == [
        ("Ohio", 1.0, 2.0, 3.0, 4.0),
        ("Texas", 3.0, 4.0, 1.0, 2.0),
    ]


def square(geo_id, x, y, size=1.0):
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return [(geo_id, 0, 0, i, x + a * size, y + b * size) for i, (a, b) in enumerate(corners)]


def test_state_analysis(spark, flows):
    names = ["Ohio", "Texas", "Michigan", "Guam"]
    regions = spark.createDataFrame(list(enumerate(names)), "geo_id long, NAME string")
    vertices = spark.createDataFrame(
        [v for i in range(4) for v in square(i, i * 2.0, 0.0)],
        "geo_id long, part int, ring int, seq int, x double, y double",
    )
    found = state_flows.analyse(flows, regions, vertices, 2021, 2022)
    assert found["net_migration"].first()["state"] == "Ohio"
    assert rows(found["top_states"], "state") == [("Florida",), ("Michigan",), ("Ohio",), ("Texas",)]
    assert rows(found["rust_belt_net"], "year", "state", "net_migration") == [
        (2021, "Ohio", 5.0),
        (2022, "Michigan", 7.0),
        (2022, "Ohio", 30.0),
    ]
    assert rows(found["net_layer"], "NAME", "net_migration", "fill") == [
        ("Michigan", 7.0, 0.6), ("Ohio", 35.0, 1.0), ("Texas", -35.0, 0.0),
    ]
    assert rows(found["flow_lines"], "origin_state", "line_width") == [("Michigan", 1.9)]
    assert rows(found["focus_points"], "NAME", "lon", "lat") == [("Michigan", 4.5, 0.5)]
    assert rows(found["rust_belt_layer"], "NAME") == [("Michigan",), ("Ohio",)]
    assert found["top_destinations"].first()["current_state"] == "Ohio"
    assert found["inflow_change"].first()["current_state"] == "Ohio"
