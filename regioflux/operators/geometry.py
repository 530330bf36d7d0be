"""Region geometry as a vertex table (geo_id, part, ring, seq, x, y).

Rings are closed: the last vertex repeats the first. Ring 0 is the shell, further rings are holes. seq
grows within a ring; it may leave numbers out. Attributes live in their own table and meet the geometry only on export.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regioflux.functions.exact import turn

RING = ("geo_id", "part", "ring")
CHUNK = 4096

# Fixed values.
EARTH_RADIUS_M = 6378137.0
MERCATOR = 3857
DEGREES = 4326


def in_blocks(vertices: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Vertices with a block number: rings cut into pieces of bounded length.

    Every block also holds the first vertex of the next block that exists, whatever seq leaves out, so that blocks
    join up. Grouping by ring and block spreads a ring of any length over many tasks; the order of a ring's blocks comes
    from one row for each block. Vertices are dealt out first: a file that is small on disk is read by one task, which would else
    sort all of them for the blocks' first ones.
    """
    cut = vertices.select(*RING, "seq", "x", "y", F.floor(F.col("seq") / chunk).alias("block")).repartition(*RING, "block")
    heads = cut.groupBy(*RING, "block").agg(F.min(F.struct("seq", "x", "y")).alias("head"))
    before = F.lag("block").over(Window.partitionBy(*RING).orderBy("block"))
    borders = heads.withColumn("before", before).where(F.col("before").isNotNull())
    return cut.unionByName(borders.select(*RING, "head.*", F.col("before").alias("block")))


def ring_edges(vertices: DataFrame, chunk: int = CHUNK, with_next: bool = False) -> DataFrame:
    """(geo_id, part, ring, seq, x1, y1, x2, y2): each vertex with its successor, and on request the successor's seq (next)."""
    order = Window.partitionBy(*RING, "block").orderBy("seq")
    pairs = in_blocks(vertices, chunk).select(
        *RING,
        "seq",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.lead("x").over(order).alias("x2"),
        F.lead("y").over(order).alias("y2"),
        F.lead("seq").over(order).alias("next"),
    )
    pairs = pairs.where(F.col("next").isNotNull())
    return pairs if with_next else pairs.drop("next")


def ring_moments(vertices: DataFrame) -> DataFrame:
    """Per ring twice the signed area and the first moments (shoelace sums)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return (
        ring_edges(vertices)
        .groupBy(*RING)
        .agg(
            F.sum(cross).alias("area2"),
            F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"),
            F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
        )
    )


def centroids(vertices: DataFrame) -> DataFrame:
    """(geo_id, area, lon, lat): area-weighted planar centroid, holes taken out, any winding."""
    turn = F.signum("area2") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    sums = (
        ring_moments(vertices)
        .groupBy("geo_id")
        .agg(
            F.sum(turn * F.col("area2")).alias("area2"),
            F.sum(turn * F.col("mx")).alias("mx"),
            F.sum(turn * F.col("my")).alias("my"),
        )
    )
    return sums.select(
        "geo_id",
        (F.col("area2") / 2).alias("area"),
        F.try_divide(F.col("mx"), 3 * F.col("area2")).alias("lon"),
        F.try_divide(F.col("my"), 3 * F.col("area2")).alias("lat"),
    )


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The point of the unit sphere at a longitude and latitude in degrees."""
    lon, lat = F.radians(lon), F.radians(lat)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def sphere_moments(vertices: DataFrame) -> DataFrame:
    """Per ring the integral of the unit normal over the region inside (mx, my, mz) and the sum of its vertices (sx, sy, sz).

    The integral is half the sum, over the ring's great-circle edges, of an edge's angle times the unit normal of its plane. So edges of all
    blocks of a ring just add up, and no edge needs to know where the date line or a pole is. The cross product is taken with the difference
    of an edge's ends, which keeps its digits for short edges.
    """
    edges = ring_edges(vertices)
    ends = zip("xyz", _unit(F.col("x1"), F.col("y1")), _unit(F.col("x2"), F.col("y2")), strict=True)
    at = edges.select(*RING, *(c for n, p, q in ends for c in (p.alias(f"p{n}"), (q - p).alias(f"d{n}"))))
    turned = at.select(
        "*",
        (F.col("py") * F.col("dz") - F.col("pz") * F.col("dy")).alias("cx"),
        (F.col("pz") * F.col("dx") - F.col("px") * F.col("dz")).alias("cy"),
        (F.col("px") * F.col("dy") - F.col("py") * F.col("dx")).alias("cz"),
    )
    long = lambda v: F.sqrt(sum((F.col(v + n) * F.col(v + n) for n in "xyz"), F.lit(0.0)))
    # The angle over its sine; the half chord gives the angle of any edge, also of one near half a circle.
    angle = F.asin(F.least(F.lit(1.0), long("d") / 2)) * 2
    weight = F.when(long("c") > 0, angle / long("c") / 2).otherwise(0.0)
    sums = [F.sum(weight * F.col(f"c{n}")).alias(f"m{n}") for n in "xyz"] + [F.sum(f"p{n}").alias(f"s{n}") for n in "xyz"]
    return turned.groupBy(*RING).agg(*sums)


def sphere_centroids(vertices: DataFrame) -> DataFrame:
    """(geo_id, lon, lat): centroid on the sphere of regions whose vertices are in degrees, holes taken out, any winding.

    A ring's inside is the side its vertices lean to, which holds for rings of less than a hemisphere. A region across the date line is one
    region; longitudes beyond 180 degrees are fine. A region without area has no centroid. Edges are great circles.
    """
    lean = sum((F.col(f"m{n}") * F.col(f"s{n}") for n in "xyz"), F.lit(0.0))
    turn = F.signum(lean) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    sums = sphere_moments(vertices).groupBy("geo_id").agg(*[F.sum(turn * F.col(f"m{n}")).alias(n) for n in "xyz"])
    flat = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    some = (flat > 0) | (F.col("z") != 0)
    return sums.select(
        "geo_id",
        F.when(some, F.degrees(F.atan2("y", "x"))).alias("lon"),
        F.when(some, F.degrees(F.atan2(F.col("z"), flat))).alias("lat"),
    )


def boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("geo_id").agg(
        F.min("x").alias("west"),
        F.min("y").alias("south"),
        F.max("x").alias("east"),
        F.max("y").alias("north"),
    )


def in_view(vertices: DataFrame, view: Sequence[float]) -> DataFrame:
    """Boxes of the regions that meet the window (west, south, east, north)."""
    west, south, east, north = view
    return boxes(vertices).where(
        (F.col("east") >= west)
        & (F.col("west") <= east)
        & (F.col("north") >= south)
        & (F.col("south") <= north)
    )


def lon_degrees(x: Column) -> Column:
    return x / EARTH_RADIUS_M * (180.0 / math.pi)


def lat_degrees(y: Column) -> Column:
    return (F.atan(F.exp(y / EARTH_RADIUS_M)) * 2.0 - math.pi / 2) * (180.0 / math.pi)


def to_degrees(vertices: DataFrame) -> DataFrame:
    """Web-Mercator metres to longitude and latitude, by the crs column; other systems are an error."""
    crs = F.col("crs")
    known = F.when(crs.isin(MERCATOR, DEGREES), crs).otherwise(
        F.raise_error(
            F.concat(F.lit("no conversion from crs "), F.coalesce(crs.cast("string"), F.lit("NA")))
        ).cast("int")
    )
    return vertices.withColumns(
        {
            "x": F.when(known == MERCATOR, lon_degrees(F.col("x"))).otherwise(F.col("x")),
            "y": F.when(known == MERCATOR, lat_degrees(F.col("y"))).otherwise(F.col("y")),
            "crs": F.lit(DEGREES),
        }
    )


def dissolve(vertices: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Outer edges per group of regions; groups has (geo_id, <group>).

    An edge between two members occurs twice and vanishes. Neighbours must share their vertices exactly;
    where one has a vertex inside the edge of the other, both sides stay in the result.
    """
    # Sizes are guessed from files, before regions unfold into vertices, so that all edges would be sent to the one task that reads the groups.
    edges = ring_edges(vertices).join(groups.select("geo_id", group).hint("merge"), "geo_id")
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    undirected = edges.select(
        group,
        F.when(forward, F.col("x1")).otherwise(F.col("x2")).alias("x1"),
        F.when(forward, F.col("y1")).otherwise(F.col("y2")).alias("y1"),
        F.when(forward, F.col("x2")).otherwise(F.col("x1")).alias("x2"),
        F.when(forward, F.col("y2")).otherwise(F.col("y1")).alias("y2"),
    )
    counted = undirected.groupBy(group, "x1", "y1", "x2", "y2").agg(F.count("*").alias("uses"))
    return counted.where(F.col("uses") == 1).drop("uses")


def in_cells(edges: DataFrame, size: Column) -> DataFrame:
    """Edges once for each cell (cx, cy) of a square grid that they pass through: about as many cells as an edge is sizes long.

    Within each row of cells an edge covers the cells between where it enters and where it leaves; a margin makes up for rounding.
    """
    margin = size * 1e-6
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumns({"_size": size, "cy": F.explode(F.sequence(F.floor((low - margin) / size), F.floor((high + margin) / size)))})
    at = lambda y: F.col("x1") + F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    size, margin = F.col("_size"), F.col("_size") * 1e-6
    flat = F.col("y1") == F.col("y2")
    enter = F.when(flat, F.col("x1")).otherwise(at(F.least(F.greatest(F.col("cy") * size, low), high)))
    leave = F.when(flat, F.col("x2")).otherwise(at(F.least(F.greatest((F.col("cy") + 1) * size, low), high)))
    # Where an edge is nearly flat the margin in y is worth a lot of x, so both neighbours of a border hold it.
    first, last = F.floor((F.least(enter, leave) - margin) / size), F.floor((F.greatest(enter, leave) + margin) / size)
    return rows.withColumn("cx", F.explode(F.sequence(first, last))).drop("_size")


CROWDED = 32
FINER = 16


def crossing_rings(vertices: DataFrame) -> DataFrame:
    """(geo_id, part, ring) of rings that meet themselves: two edges that do not follow each other have a point in common.

    Edges meet in the cells of a grid as wide as the ring's mean edge, so a ring of n edges gives about n cells with a few edges each, and
    edges of one cell are compared only, each with those behind it in the order of the cell. Crowded cells are cut into FINER x FINER again, and
    their edges joined. A ring that repeats a vertex in a row meets itself there. Sides are told without rounding. Edges with a missing coordinate are left out.
    """
    edges = ring_edges(vertices, with_next=True)
    edges = edges.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x1", "y1", "x2", "y2")))
    long = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    rings = edges.groupBy(*RING).agg(F.avg(long).alias("size"), F.min("seq").alias("start"), F.max("next").alias("stop")).where("size > 0")
    cells = in_cells(edges.join(rings.hint("merge"), list(RING)), F.col("size"))
    ends = ("seq", "next", "x1", "y1", "x2", "y2")
    cells = cells.select(*RING, "cx", "cy", *ends, "size", "start", "stop").repartition(*RING, "cx", "cy")
    cell = Window.partitionBy(*RING, "cx", "cy").orderBy("seq")
    held = F.count("*").over(cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = F.collect_list(F.struct(*(F.col(c).alias(f"o{c}") for c in ends))).over(cell.rowsBetween(1, CROWDED - 1))
    near = cells.withColumns({"held": held, "behind": behind}).where(F.col("held").between(2, CROWDED))
    near = near.select(*RING, *ends, "start", "stop", F.inline("behind"))
    crowd = cells.withColumn("held", held).where(F.col("held") > CROWDED).drop("cx", "cy", "held").dropDuplicates([*RING, "seq"])
    fine = in_cells(crowd, F.col("size") / FINER)
    other = fine.select(*RING, "cx", "cy", *(F.col(c).alias(f"o{c}") for c in ends))
    far = fine.hint("merge").join(other, [*RING, "cx", "cy"]).select(*near.columns)
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    c, d = (F.col("ox1"), F.col("oy1")), (F.col("ox2"), F.col("oy2"))
    meets = (turn(*a, *b, *c) * turn(*a, *b, *d) <= 0) & (turn(*c, *d, *a) * turn(*c, *d, *b) <= 0)
    for p1, p2, q1, q2 in (("x1", "x2", "ox1", "ox2"), ("y1", "y2", "oy1", "oy2")):
        meets = meets & (F.least(p1, p2) <= F.greatest(q1, q2)) & (F.least(q1, q2) <= F.greatest(p1, p2))
    follows = (F.col("next") == F.col("oseq")) | ((F.col("seq") == F.col("start")) & (F.col("onext") == F.col("stop")))
    # A closed ring's last edge is followed by its first; of an open ring the two may meet like any others.
    follows = (F.col("next") == F.col("oseq")) | (follows & (F.col("x1") == F.col("ox2")) & (F.col("y1") == F.col("oy2")))
    met = (F.col("seq") < F.col("oseq")) & ~follows & meets
    return near.where(met).select(*RING).unionByName(far.where(met).select(*RING)).distinct()


def invalid_rings(vertices: DataFrame) -> DataFrame:
    """Rings with a defect, one flag per kind. `crossing_rings` tells which rings meet themselves."""
    # Equal points of a ring are folded first, so that no task holds all vertices of a long ring.
    points = vertices.groupBy(*RING, "x", "y").agg(
        F.count("*").alias("uses"), F.min("seq").alias("first"), F.max("seq").alias("last")
    )
    spot = F.struct("x", "y")
    shape = points.groupBy(*RING).agg(
        F.sum("uses").alias("n"),
        F.count("*").alias("spots"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("holes"),
        F.min_by(spot, "first").alias("start"),
        F.max_by(spot, "last").alias("end"),
    )
    closed = F.col("start").eqNullSafe(F.col("end"))
    flags = {
        "open_ring": ~closed,
        "short_ring": F.col("n") < 4,
        "zero_area": (F.col("holes") == 0) & F.coalesce(F.col("area2") == 0, F.lit(False)),
        "null_coordinate": F.col("holes") > 0,
        "repeated_vertex": F.col("spots") < F.col("n") - F.when(closed, 1).otherwise(0),
    }
    checked = shape.join(ring_moments(vertices).select(*RING, "area2"), list(RING), "left").select(
        *RING, *[flag.alias(name) for name, flag in flags.items()]
    )
    return checked.where(" OR ".join(flags))


def invalid_count(vertices: DataFrame) -> DataFrame:
    """One row with the number of regions that have a defective ring."""
    regions = invalid_rings(vertices).select("geo_id").distinct()
    return regions.agg(F.count("*").alias("invalid"))
