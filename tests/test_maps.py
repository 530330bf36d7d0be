"""Geometry over vertex tables, layers, sinks and the hazard analysis."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from regioflux.operators import geometry as geo
from regioflux.operators import groups, layers, rings
from regioflux.plans import hazard_risk
from regioflux.session import settled, with_folder
from regioflux.sources import tables as sources

VERTICES = "geo_id long, part int, ring int, seq int, x double, y double"


def ring(geo_id, points, part=0, number=0, start=0):
    return [(geo_id, part, number, start + i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def box(x, y, w=1.0, h=1.0, clockwise=False):
    points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return points[::-1] if clockwise else points


def table(spark, *parts):
    return spark.createDataFrame([v for p in parts for v in p], VERTICES)


def test_edges_do_not_depend_on_the_chunk(spark):
    points = [(math.cos(i / 10), math.sin(i / 10)) for i in range(40)]
    for start in (0, 1, 5):
        vertices = table(spark, ring(1, [*points, points[0]], start=start))
        wanted = rows(geo.ring_edges(vertices))
        assert len(wanted) == 40
        for chunk in (1, 2, 7, 40, 41):
            assert rows(geo.ring_edges(vertices, chunk)) == wanted


@pytest.mark.parametrize("clockwise", [False, True])
def test_centroids(spark, clockwise):
    vertices = table(
        spark,
        ring(1, box(0, 0, 4, 4, clockwise)),
        ring(1, box(2, 0, 2, 4, not clockwise), number=1),
        ring(2, box(0, 0, 1, 1, clockwise)),
        ring(2, box(9, 0, 1, 3, clockwise), part=1),
        ring(3, [(0, 0), (1, 1), (0, 0)]),
    )
    assert rows(geo.centroids(vertices)) == [
        (1, 8.0, 1.0, 2.0),
        (2, 4.0, (0.5 + 9.5 * 3) / 4, (0.5 + 1.5 * 3) / 4),
        (3, 0.0, None, None),
    ]


def test_view(spark):
    vertices = table(spark, ring(1, box(0, 0)), ring(2, box(5, 5)), ring(3, box(1, 1)))
    assert rows(geo.in_view(vertices, (0.5, 0.5, 1.0, 1.0)), "geo_id") == [(1,), (3,)]


def test_dissolve(spark):
    cells = [ring(10 * x + y, box(x, y)) for x in range(3) for y in range(3)]
    vertices = table(spark, *cells)
    groups_ = spark.createDataFrame([(10 * x + y, "all") for x in range(3) for y in range(3)], "geo_id long, g string")
    edges = rows(geo.dissolve(vertices, groups_, "g"), "x1", "y1", "x2", "y2")
    assert len(edges) == 12
    assert all({x1, x2} <= {0.0, 3.0} or {y1, y2} <= {0.0, 3.0} for x1, y1, x2, y2 in edges)


def test_invalid_rings(spark):
    vertices = spark.createDataFrame(
        ring(1, box(0, 0))
        + ring(2, box(0, 0)[:-1])
        + ring(3, [(0, 0), (1, 1), (0, 0)])
        + ring(4, [(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
        + [(5, 0, 0, i, None if i == 2 else float(x), float(y)) for i, (x, y) in enumerate(box(0, 0))],
        VERTICES,
    )
    flags = ["open_ring", "short_ring", "zero_area", "null_coordinate", "repeated_vertex"]
    found = {r["geo_id"]: [f for f in flags if r[f]] for r in geo.invalid_rings(vertices).collect()}
    assert found == {
        2: ["open_ring"],
        3: ["short_ring", "zero_area"],
        4: ["repeated_vertex"],
        5: ["null_coordinate"],
    }
    assert rows(geo.invalid_count(vertices)) == [(4,)]


def test_degrees(spark):
    metres = table(spark, ring(1, [(0, 0), (20037508.342789244, 20037508.342789244)])).withColumn("crs", F.lit(3857))
    x, y, crs = rows(geo.to_degrees(metres), "x", "y", "crs")[1]
    assert (round(x, 9), round(y, 6), crs) == (180.0, 85.051129, 4326)
    kept = metres.withColumn("crs", F.lit(4326))
    assert rows(geo.to_degrees(kept), "x") == rows(kept, "x")
    with pytest.raises(PySparkException, match="no conversion from crs 4269"):
        geo.to_degrees(metres.withColumn("crs", F.lit(4269))).collect()


def test_scales(spark):
    df = spark.createDataFrame([(1, -50.0), (2, 0.0), (3, 100.0), (4, None)], "i int, v double")
    assert [r[2] for r in rows(layers.diverging(df, "v", "p"))] == [0.25, 0.5, 1.0, None]
    assert [r[2] for r in rows(layers.rescaled(df, "v", "p", 10.0, 40.0))] == [10.0, 20.0, 40.0, None]
    flat = df.where("i = 3")
    assert rows(layers.diverging(flat, "v", "p"), "p") == [(0.5,)]
    assert rows(layers.rescaled(flat, "v", "p", 0.8, 3.0), "p") == [(1.9,)]


def test_legend_and_popup(spark):
    df = spark.createDataFrame([("a", "High"), ("b", "High"), ("c", None)], "k string, rating string")
    assert [tuple(r) for r in layers.legend(df, "rating").orderBy("position").collect()] == [
        (1, "Very Low", 0), (2, "Low", 0), (3, "Moderate", 0), (4, "High", 2), (5, "Very High", 0),
    ]
    text = layers.popup(("Name", F.col("k")), ("Rating", F.col("rating")))
    assert rows(df.select(text.alias("t"))) == [
        ("Name: a<br>Rating: High",), ("Name: b<br>Rating: High",), ("Name: c<br>Rating: NA",),
    ]
    layer = layers.choropleth(df.withColumn("v", F.lit(1)), "k", "k", "v", "rating", reverse=True)
    assert rows(layer, "region", "class_index") == [("a", 2), ("b", 2), ("c", None)]


def test_geojson(spark, tmp_path):
    vertices = table(
        spark,
        ring(1, box(0, 0)),
        ring(1, box(0.25, 0.25, 0.5, 0.5), number=1),
        ring(1, box(5, 5), part=1),
        ring(2, [(i, i * i) for i in range(20)] + [(0, 0)]),
    )
    regions = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id long, name string, v int")
    found = layers.features(regions, vertices, "id", ["name", "v"], chunk=8)
    sources.write_geojson(found, str(tmp_path / "layer"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "layer")).collect()]
    shapes = {k: [f for f in lines if f["properties"]["name"] == k] for k in "ab"}
    (multi,) = shapes["a"]
    assert multi["properties"] == {"name": "a", "v": None}
    assert multi["geometry"]["type"] == "MultiPolygon"
    assert [[len(r) for r in polygon] for polygon in multi["geometry"]["coordinates"]] == [[5, 5], [5]]
    assert multi["geometry"]["coordinates"][1][0][2] == [6.0, 6.0]
    (outline,) = shapes["b"]
    assert outline["geometry"]["type"] == "MultiPolygon" and len(outline["geometry"]["coordinates"][0][0]) == 21


def test_outline_pieces_join_up(spark):
    vertices = table(spark, [v for v in ring(2, [(i, i * i) for i in range(20)] + [(0, 0)]) if v[3] not in (8, 9)])
    regions = spark.createDataFrame([(2, "b")], "id long, name string")
    found = layers.outline_pieces(regions, vertices, "id", ["name"], chunk=4)
    pieces = sorted((json.loads(r.feature) for r in found.collect()), key=lambda f: f["properties"]["block"])
    lines = [f["geometry"]["coordinates"] for f in pieces]
    assert all(a[-1] == b[0] for a, b in zip(lines, lines[1:])) and max(map(len, lines)) <= 5
    assert sum(len(x) - 1 for x in lines) == 18 and pieces[0]["properties"] == {"name": "b", "part": 0, "ring": 0, "block": 0}


def test_edges_bridge_gaps(spark):
    gapped = table(spark, [v for v in ring(1, [(i, i * i) for i in range(20)] + [(0, 0)]) if v[3] not in (4, 8, 9, 10, 11)])
    wanted = rows(geo.ring_edges(gapped))
    assert len(wanted) == 15
    for chunk in (1, 2, 4):
        assert rows(geo.ring_edges(gapped, chunk)) == wanted


def test_csv_and_boundaries(spark, tmp_path):
    path = str(tmp_path / "csv")
    raw = spark.createDataFrame([("Ohio", "1,2", 5.0), ("NA", 'say "x"', None)], "Name string, `a & b` string, v double")
    sources.write_csv(raw, path)
    back = sources.read_csv(spark, path, "`Name` string, `a & b` string, v double")
    assert back.columns == ["Name", "a...b", "v"]
    assert rows(back) == [(None, 'say "x"', None), ("Ohio", "1,2", 5.0)]
    vertices = table(spark, ring(1, box(0, 0)))
    attributes = spark.createDataFrame([(1, "Ohio")], "geo_id long, NAME string")
    sources.write_layer(vertices, str(tmp_path / "v"))
    sources.write_layer(attributes, str(tmp_path / "a"))
    names, shapes = sources.read_boundaries(spark, str(tmp_path / "a"), str(tmp_path / "v"))
    assert rows(names) == [(1, "Ohio")]
    assert rows(shapes) == rows(vertices)


def test_hazard_analysis(spark):
    states = spark.createDataFrame([(1, "TX"), (2, "OH"), (3, "AK")], "geo_id long, STUSPS string")
    incidents = groups.recent_incidents(
        spark.createDataFrame(
            [("TX", 2011, "Fire", "A")] * 3 + [("OH", 2012, "Flood", "B"), ("PR", 2012, "Fire", "C"), ("TX", 1999, "Fire", "A")],
            "STUSPS string, fyDeclared int, incidentType string, designatedArea string",
        ),
        2010,
    )
    layer = hazard_risk.disaster_layer(states.drop("geo_id"), incidents, ["Fire", "Flood"], cuts=(1, 2, 3, 4))
    assert rows(layer) == [
        ("AK", None, None, None, None, None),
        ("OH", 1.0, 0, 1, "Very Low", 1),
        ("TX", 3.0, 3, 0, "Moderate", 3),
    ]
    vertices = table(spark, ring(1, box(0, 0)), ring(2, box(2, 2)))
    points = hazard_risk.disaster_points(states, incidents, vertices)
    assert rows(points, "STUSPS", "incidentType", "lon") == [
        ("AK", None, None), ("OH", "Flood", 2.5), ("TX", "Fire", 0.5), ("TX", "Fire", 0.5), ("TX", "Fire", 0.5),
    ]


def test_scores(spark):
    tracts = spark.createDataFrame(
        [("TX", "1001", 1.0), ("TX", "1001", 3.0), ("OH", "39001", None)],
        "STATE string, GEOID_County string, CVI_Score double",
    )
    states = spark.createDataFrame([("TX",), ("OH",), ("AK",)], "STUSPS string")
    assert rows(hazard_risk.score_by_state(states, tracts)) == [("AK", None), ("OH", None), ("TX", 2.0)]
    counties = spark.createDataFrame([("01001",), ("39001",)], "GEOID string")
    assert rows(hazard_risk.score_by_county(counties, tracts)) == [("01001", 2.0), ("39001", None)]


def test_state_risk(spark):
    data = [
        ("01", "A", "TX", "48", 10.0, "High", 1),
        ("02", "B", "TX", "48", 20.0, "No Rating", 3),
        ("03", "C", "OH", "39", 5.0, "Low", 2),
        ("04", "D", "PR", "72", 99.0, "Low", 2),
        ("05", "E", None, "00", 1.0, None, 2),
    ]
    counties = spark.createDataFrame(
        data,
        "STCOFIPS string, COUNTY string, STATEABBRV string, STATEFIPS string, RISK_SCORE double, "
        "RISK_RATNG string, POPULATION int",
    )
    found = hazard_risk.state_risk(counties)
    assert rows(found, "STATEABBRV", "state_risk_score", "total_population", "n_counties", "state_risk_ratng") == [
        (None, 1.0, 2, 1, "Very Low"),
        ("OH", 5.0, 2, 1, "Moderate"),
        ("TX", 17.5, 4, 2, "Very High"),
    ]
    labels = rows(hazard_risk.region_label(counties), "Name", "Risk_Rating")
    assert labels[:2] == [("A, TX", "High"), ("B, TX", None)] and labels[-1] == ("E, NA", None)
    boundaries = spark.createDataFrame([("1", "A County", "TX")], "GEOID string, NAMELSAD string, STUSPS string")
    checked = hazard_risk.id_mismatches(counties, boundaries)
    assert rows(checked, "GEOID", "Name")[:2] == [("00001", "A County, TX"), ("00002", None)]


def degrees_ring(spark, rings):
    """(geo_id, part, ring, seq, x, y) from {(geo_id, ring): corners}."""
    rows = [(g, 0, r, i, float(x), float(y)) for (g, r), corners in rings.items() for i, (x, y) in enumerate([*corners, corners[0]])]
    return spark.createDataFrame(rows, "geo_id long, part int, ring int, seq int, x double, y double")


def test_centroid_on_the_sphere(spark):
    square = [(-10, -10), (10, -10), (10, 10), (-10, 10)]
    across = [(170, 40), (-170, 40), (-170, 60), (170, 60)]
    cap = [(lon, 80) for lon in range(0, 360, 10)]
    small = [(8.0, 47.0), (8.00001, 47.0), (8.00001, 47.00001), (8.0, 47.00001)]
    hole = [(-2, -5), (-2, 5), (8, 5), (8, -5)]
    rings = {(1, 0): square, (2, 0): across, (3, 0): cap, (4, 0): small, (5, 0): square, (5, 1): hole, (6, 0): [(0, 0), (1, 0)], (7, 0): across[::-1]}
    found = {r.geo_id: r for r in geo.sphere_centroids(degrees_ring(spark, rings)).collect()}
    assert abs(found[1].lon) < 1e-9 and abs(found[1].lat) < 1e-9
    assert abs(abs(found[2].lon) - 180) < 1e-9 and 49 < found[2].lat < 51.5
    assert abs(found[7].lon - found[2].lon) % 360 < 1e-9 and abs(found[7].lat - found[2].lat) < 1e-9
    assert found[3].lat > 89.999999
    assert abs(found[4].lon - 8.000005) < 2e-7 and abs(found[4].lat - 47.000005) < 2e-7
    assert found[5].lon < -0.5 and abs(found[5].lat) < 1e-9
    assert found[6].lon is None


def test_centroid_on_the_sphere_does_not_depend_on_blocks(spark, monkeypatch):
    ring = [(math.cos(t / 500 * math.pi) * 20 + 5, math.sin(t / 500 * math.pi) * 10) for t in range(1000)]
    vertices = degrees_ring(spark, {(1, 0): ring})
    one = geo.sphere_centroids(vertices).first()
    monkeypatch.setattr(geo.ring_edges, "__defaults__", (64, False))
    other = geo.sphere_centroids(vertices).first()
    assert abs(one.lon - other.lon) < 1e-9 and abs(one.lat - other.lat) < 1e-9 and abs(one.lon - 5) < 1e-6


def squares(spark, cells, side="a"):
    """Unit squares at lower left corners, some wound clockwise, and their group."""
    rows = []
    for i, (x, y) in enumerate(cells):
        corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
        rows += [(i, 0, 0, s, float(a), float(b)) for s, (a, b) in enumerate(corners[:: -1 if i % 3 == 0 else 1])]
    vertices = spark.createDataFrame(rows, "geo_id long, part int, ring int, seq int, x double, y double")
    return vertices, spark.createDataFrame([(i, side) for i in range(len(cells))], "geo_id long, side string")


def outlines(df):
    """{(side, part, ring): corners in order}."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.side, r.part, r.ring, r.seq)):
        out.setdefault((r.side, r.part, r.ring), []).append((r.x, r.y))
    return out


def area(corners):
    return sum(a * d - c * b for (a, b), (c, d) in zip(corners, corners[1:])) / 2


def test_dissolved_rings_have_parts_and_holes(spark):
    with_folder(spark)
    frame = [(x, y) for x in range(7) for y in range(7) if x in (0, 6) or y in (0, 6)]
    inner = [(x, y) for x in range(2, 5) for y in range(2, 5) if (x, y) != (3, 3)]
    vertices, groups = squares(spark, frame + inner + [(7, 7), (20, 0), (21, 0)])
    found = outlines(rings.dissolve_rings(vertices, groups, "side"))
    sizes = {k[1:]: area(v) for k, v in found.items()}
    # The frame, the ring inside its hole, a square that touches the frame's corner, and two squares in one.
    assert sizes == {(0, 0): 49, (0, 1): -25, (1, 0): 9, (1, 1): -1, (2, 0): 1, (3, 0): 2}
    for corners in found.values():
        assert corners[0] == corners[-1] == min(corners)
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(corners, corners[1:]))
    none = groups.where("geo_id < 0")
    assert rings.dissolve_rings(vertices, none, "side").count() == 0


def test_long_ring_takes_few_rounds(spark):
    with_folder(spark)
    n = 100_000
    corner = F.lit(2 * math.pi / n) * (F.col("id") % n)
    rows = spark.range(n + 1).select(
        F.lit(1).cast("long").alias("geo_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").alias("seq"), F.cos(corner).alias("x"), F.sin(corner).alias("y")
    )
    rounds = []

    def settle(df):
        rounds.append(1)
        return settled(df)

    found = rings.dissolve_rings(rows, spark.createDataFrame([(1, "a")], "geo_id long, side string"), "side", settle)
    one = found.agg(F.count("*"), F.max("seq"), F.count_distinct("x", "y"), F.max("ring")).first()
    assert tuple(one) == (n + 1, n, n, 0)
    assert len(rounds) <= 22


def test_regions_that_touch_in_a_point_stay_apart(spark):
    with_folder(spark)
    vertices, groups = squares(spark, [(0, 0), (1, 1), (2, 0), (1, -1)])
    found = outlines(rings.dissolve_rings(vertices, groups, "side"))
    assert {k[1:]: area(v) for k, v in found.items()} == {(i, 0): 1 for i in range(4)}


def crosses(corners):
    """Whether any two edges that do not follow each other have a point in common, all pairs compared."""
    edges = list(zip(corners, corners[1:]))

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    for i, (a, b) in enumerate(edges):
        for j in range(i + 2, len(edges)):
            c, d = edges[j]
            if i == 0 and j == len(edges) - 1:
                continue
            boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
            if boxes and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                return True
    return False


def test_self_intersection_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    shapes = {}
    for g in range(60):
        n = rng.choice([4, 6, 9, 40])
        if g % 2:
            corners = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
        else:  # a star around a point, now and then with two corners swapped
            corners = [(round(rng.uniform(1, 30) * math.cos(2 * math.pi * t / n), 3), round(rng.uniform(1, 30) * math.sin(2 * math.pi * t / n), 3)) for t in range(n)]
        if all(corners[i] != corners[i - 1] for i in range(n)):
            shapes[g, 0] = corners
    vertices = degrees_ring(spark, shapes)
    wanted = sorted((g,) for (g, _), corners in shapes.items() if crosses([*corners, corners[0]]))
    assert 10 < len(wanted) < len(shapes) - 5
    assert rows(geo.crossing_rings(vertices).select("geo_id")) == wanted
    monkeypatch.setattr(geo, "CROWDED", 2)
    assert rows(geo.crossing_rings(vertices).select("geo_id")) == wanted
    monkeypatch.setattr(geo.ring_edges, "__defaults__", (3, False))
    assert rows(geo.crossing_rings(vertices).select("geo_id")) == wanted
    assert geo.crossing_rings(vertices.limit(0)).count() == 0


def test_long_rings_meet_in_cells_only(spark):
    n = 60_000
    angle = F.lit(2 * math.pi / n) * (F.col("id") % n)
    ring = spark.range(n + 1).select(
        F.lit(1).cast("long").alias("geo_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").alias("seq"), F.cos(angle).alias("x"), F.sin(angle).alias("y")
    )
    assert geo.crossing_rings(ring).count() == 0
    pulled = ring.withColumn("x", F.when(F.col("seq") == 1000, -2.0).otherwise(F.col("x")))
    assert geo.crossing_rings(pulled).count() == 1


def planned(df):
    """The physical plan before adaptive changes, as sizes are guessed from files."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_dissolve_sends_no_edges_to_the_task_that_reads_the_groups(spark, tmp_path):
    table(spark, *(ring(g, box(g, 0)) for g in range(8))).write.parquet(f"{tmp_path}/vertices")
    spark.createDataFrame([(g, str(g // 4)) for g in range(8)], "geo_id long, g string").write.parquet(f"{tmp_path}/groups")
    vertices, groups_ = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("vertices", "groups"))
    for edges in (geo.dissolve(vertices, groups_, "g"), rings.outline_edges(vertices, groups_, "g")):
        assert edges.count() == 20
        assert "BroadcastHashJoin" not in planned(edges)


def test_crossing_rings_joins_edges_of_crowded_cells_only(spark):
    star = [(math.cos(math.tau * 7 * i / 15), math.sin(math.tau * 7 * i / 15)) for i in range(16)]
    comb = [(i * 1e-3, i % 2 * 1e-3) for i in range(300)] + [(500.0, 9.0), (0.0, 1.0), (0.0, 0.0)]
    crossed = [*comb[:100], comb[101], comb[100], comb[101], *comb[102:]]
    missing = [(None, *r[1:]) for r in ring(0, star)]
    vertices = spark.createDataFrame(ring(1, star) + ring(2, comb) + ring(3, crossed) + ring(4, box(0, 0)) + missing, VERTICES)
    found = geo.crossing_rings(vertices)
    assert rows(found.select("geo_id")) == [(1,), (3,)]
    # One join with the rings for each of three branches and one of crowded cells; before, cells also met their counts and themselves.
    assert "BroadcastHashJoin" not in planned(found) and planned(found).count("SortMergeJoin") == 4
