"""Shared borders made equal: edges are cut at every vertex that lies on them, so that neighbours have the same edges.

Vertices meet the edges near them in the cells of square grids, one for each size of edges: an edge lies in about ten cells at most of the
grid of its own size, however long it is, and a point in one cell of each grid. So the pairs to look at grow with the points times the
few edges of like size around each, never with all pairs of points and edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regioflux.functions.exact import turn
from regioflux.operators.geometry import CHUNK, RING, in_cells, ring_edges

BASE = 4.0


def cut_points(vertices: DataFrame) -> DataFrame:
    """(geo_id, part, ring, seq, x, y, place): vertices of any ring inside the edge that starts at seq, place growing along the edge.

    A point counts only if it lies on the edge exactly. Equal points are one; edges without length and missing or non-finite
    coordinates are left out. A cell that holds very many points of a hot place is split by the adaptive planner.
    """
    finite = lambda c: F.abs(c) < F.lit(float("inf"))
    edges = ring_edges(vertices).where(finite(F.col("x1")) & finite(F.col("y1")) & finite(F.col("x2")) & finite(F.col("y2")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    edges = edges.withColumn("long", F.greatest(F.abs(dx), F.abs(dy))).where("long > 0")
    edges = edges.withColumn("level", F.floor(F.log(BASE, "long")).cast("int")).drop("long")
    # One number for each power of four among the lengths: the exponents of doubles bound it.
    levels = edges.agg(F.collect_set("level").alias("levels")).scalar()
    size = F.pow(F.lit(BASE), F.col("level"))
    points = vertices.where(finite(F.col("x")) & finite(F.col("y"))).select("x", "y").distinct()
    points = points.withColumn("level", F.explode(levels)).withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    near = in_cells(edges, size).join(points, ["level", "cx", "cy"])
    within = (F.col("x") >= F.least("x1", "x2")) & (F.col("x") <= F.greatest("x1", "x2"))
    within = within & (F.col("y") >= F.least("y1", "y2")) & (F.col("y") <= F.greatest("y1", "y2"))
    for end in "12":
        within = within & ((F.col("x") != F.col("x" + end)) | (F.col("y") != F.col("y" + end)))
    on = turn(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y"))) == 0
    # Coordinates along the longer axis order the points without rounding.
    place = F.when(F.abs(dx) >= F.abs(dy), F.col("x") * F.signum(dx)).otherwise(F.col("y") * F.signum(dy))
    return near.where(within & on).select(*RING, "seq", "x", "y", place.alias("place"))


def noded(vertices: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(geo_id, part, ring, seq, x, y): the rings with every vertex of the table that lies on one of their edges put into it.

    seq is counted anew from 0 in each ring. Blocks of a ring are counted apart and add up, so no task holds a long ring. Vertices with missing
    coordinates stay where they are. A point that misses an edge by a rounding is not on it.
    """
    kind = vertices.schema["seq"].dataType
    given = vertices.select(*RING, "seq", "x", "y", F.lit(None).cast("double").alias("place"))
    blocks = given.unionByName(cut_points(vertices)).withColumn("block", F.floor(F.col("seq") / chunk))
    before = F.sum("held").over(Window.partitionBy(*RING).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = blocks.groupBy(*RING, "block").agg(F.count("*").alias("held"))
    offsets = counts.select(*RING, "block", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*RING, "block").orderBy("seq", F.asc_nulls_first("place")))
    placed = blocks.withColumn("inside", inside).join(offsets, [*RING, "block"])
    return placed.select(*RING, (F.col("offset") + F.col("inside") - 1).cast(kind).alias("seq"), "x", "y")
