"""Exact sides of lines, and edges cut at the vertices on them, against fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import rows
from regioflux.functions.exact import turn
from regioflux.operators.geometry import crossing_rings, dissolve
from regioflux.operators.noding import noded

SCHEMA = "geo_id bigint, part int, ring int, seq int, x double, y double"


def exact_side(ax, ay, bx, by, cx, cy):
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return float((det > 0) - (det < 0))


def near_lines(seed):
    """Points on and a few last bits beside lines, of very different sizes."""
    rng = random.Random(seed)
    for _ in range(400):
        scale = 10.0 ** rng.randint(-12, 12)
        ax, ay, bx, by = (rng.uniform(-scale, scale) for _ in range(4))
        t = rng.choice([0.0, 0.5, 1.0, rng.random()])
        cx, cy = ax + t * (bx - ax), ay + t * (by - ay)
        for _ in range(rng.randint(0, 2)):
            cx = math.nextafter(cx, rng.choice([-math.inf, math.inf]))
        yield ax, ay, bx, by, cx, cy
    for _ in range(200):
        yield tuple(rng.randint(-3, 3) * 0.1 + rng.choice([0, 1e6]) for _ in range(6))


@pytest.mark.parametrize("seed", range(2))
def test_side_equals_fractions(spark, seed):
    cases = list(near_lines(seed))
    names = ["ax", "ay", "bx", "by", "cx", "cy"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], ["i", *names])
    found = dict(rows(df.select("i", turn(*map(F.col, names)).alias("side")), "i", "side"))
    wanted = {i: exact_side(*c) for i, c in enumerate(cases)}
    assert found == wanted
    plain = [(b - a) * (y - c) - (d - c) * (x - a) for a, c, b, d, x, y in cases]
    # The cases are hard ones: the usual computation gets some of them wrong.
    assert any((p > 0) - (p < 0) != wanted[i] for i, p in enumerate(plain))


def test_side_of_missing_point_is_missing(spark):
    one = F.lit(1.0)
    assert spark.range(1).select(turn(one, one, one + 1, one, F.lit(None).cast("double"), one)).first()[0] is None


def ring(geo_id, *points, steps=1):
    return [(geo_id, 0, 0, i * steps, x, y) for i, (x, y) in enumerate([*points, points[0]])]


def test_a_neighbours_corner_cuts_the_edge(spark):
    wide = ring(1, (0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0), steps=10)
    small = ring(2, (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))
    found = noded(spark.createDataFrame(wide + small, SCHEMA), chunk=20)
    shape = [(r.seq, r.x, r.y) for r in found.where("geo_id = 1").orderBy("seq").collect()]
    points = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (2.0, 1.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert shape == [(i, *p) for i, p in enumerate(points)]
    assert found.schema.simpleString() == "struct<geo_id:bigint,part:int,ring:int,seq:int,x:double,y:double>"
    assert found.where("geo_id = 2").count() == 5
    groups = spark.createDataFrame([(1, "g"), (2, "g")], "geo_id bigint, g string")
    before = dissolve(spark.createDataFrame(wide + small, SCHEMA), groups, "g")
    after = dissolve(found, groups, "g")
    on_border = "y1 = 1 and y2 = 1 and x1 < 2 and x2 > 1"
    assert (before.where(on_border).count(), after.where(on_border).count()) == (2, 0)


def test_a_point_beside_the_edge_does_not_cut_it(spark):
    high = math.nextafter(1.0, 2.0)
    wide = ring(1, (0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0))
    small = ring(2, (1.0, high), (2.0, high), (2.0, 2.0), (1.0, 2.0))
    assert noded(spark.createDataFrame(wide + small, SCHEMA)).where("geo_id = 1").count() == 5


def test_odd_rings(spark):
    data = [
        *ring(1, (0.0, 0.0), (2.0, 0.0), (2.0, 2.0)),
        (2, 0, 0, 0, 1.0, 0.0),  # a single vertex, on an edge of the first ring
        *[(3, 0, 0, i, None if i == 1 else 1.0, 1.0) for i in range(4)],  # no coordinate, and edges without length
        *[(4, 0, 0, i, float("nan") if i == 2 else float(i), 9.0) for i in range(4)],
    ]
    data += ring(5, (0.0, 0.0), (2.0, 0.0), (2.0, 2.0))  # the first ring again
    found = noded(spark.createDataFrame(data, SCHEMA))
    sizes = {r.geo_id: r["count"] for r in found.groupBy("geo_id").count().collect()}
    # (1, 0) and (1, 1) cut both copies once each.
    assert sizes == {1: 6, 2: 1, 3: 4, 4: 4, 5: 6}
    assert [r.x for r in found.where("geo_id = 3").orderBy("seq").collect()] == [1.0, None, 1.0, 1.0]
    empty = noded(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0


def test_long_edge_with_many_points(spark):
    n = 20_000
    wide = spark.createDataFrame(ring(1, (0.0, 0.0), (float(n), 0.0), (float(n), 1e6), (0.0, 1e6)), SCHEMA)
    i = F.col("id").cast("double")
    teeth = spark.range(n).select((F.col("id") + 2).alias("geo_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"),
                                  F.posexplode(F.array(*(F.struct((i + a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0.0), (1, 0.0), (0.5, -1.0), (0, 0.0))))))
    teeth = teeth.select("geo_id", "part", "ring", F.col("pos").alias("seq"), "col.x", "col.y")
    found = noded(wide.unionByName(teeth)).where("geo_id = 1")
    assert found.agg(F.count("*"), F.max("seq"), F.countDistinct("seq")).first()[:] == (n + 4, n + 3, n + 4)
    assert found.where("seq <= 20000 and x = seq and y = 0").count() == n + 1


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    data = []
    for geo_id in range(25):
        size = rng.choice([1, 3, 12])
        x, y = rng.randint(-6, 6), rng.randint(-6, 6)
        data += ring(geo_id, *((float(x + rng.randint(0, size)), float(y + rng.randint(0, size))) for _ in range(rng.randint(3, 6))))
    points = {(x, y) for *_, x, y in data}
    wanted = []
    for geo_id in range(25):
        mine = [(x, y) for g, _, _, _, x, y in data if g == geo_id]
        shape = []
        for a, b in zip(mine, mine[1:]):
            on = [p for p in points if p not in (a, b) and exact_side(*a, *b, *p) == 0 and all(min(s, t) <= q <= max(s, t) for s, t, q in zip(a, b, p))]
            shape += [a, *sorted(on, key=lambda p: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)] if a != b else [a]
        wanted += [(geo_id, 0, 0, i, x, y) for i, (x, y) in enumerate([*shape, mine[-1]])]
    assert rows(noded(spark.createDataFrame(data, SCHEMA), chunk=3)) == sorted(wanted)


def test_rings_that_touch_by_a_last_bit(spark):
    """A corner on the far side, and one a last bit short of it."""
    def notch(geo_id, depth):
        return ring(geo_id, (0.0, 0.1), (0.7, 0.1), (0.7, 1.0), (0.35, depth), (0.0, 1.0))

    data = notch(1, 0.1) + notch(2, math.nextafter(0.1, 1.0)) + notch(3, math.nextafter(0.1, 0.0))
    found = crossing_rings(spark.createDataFrame(data, SCHEMA))
    assert rows(found, "geo_id") == [(1,), (3,)]
