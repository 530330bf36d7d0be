"""Closed rings from loose edges: dissolved regions as polygons with parts and holes.

Edges are linked into rings by pointer jumping: every edge knows the edge that follows it, and in each round looks twice as far ahead as
in the round before. So a ring of any length is put in order in logarithmically many rounds of joins, and no task ever holds
a ring. Holes find their shell by counting, in bands of y, how often a ray from them crosses a shell's edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regioflux.operators.geometry import RING, ring_edges, ring_moments
from regioflux.session import settled

ENDS = ("x1", "y1", "x2", "y2")


def outline_edges(vertices: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(<group>, x1, y1, x2, y2): the edges of a group's outline, each with the inside on its left.

    Rings of any winding are turned, shells counter-clockwise and holes clockwise. An edge between two members occurs once in each direction
    and vanishes. Neighbours must share their vertices exactly. Rings without area have no outline.
    """
    turn = F.signum("area2") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    turned = ring_moments(vertices).select(*RING, turn.alias("turn")).where("turn <> 0")
    # As in `dissolve`: the sizes that are guessed from files would send all edges to one task.
    edges = ring_edges(vertices).join(turned.hint("merge"), list(RING)).join(groups.select("geo_id", group).hint("merge"), "geo_id")
    edges = edges.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    along = F.col("turn") > 0
    pick = lambda a, b: F.when(along, F.col(a)).otherwise(F.col(b))
    left = edges.select(group, pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"))
    here, there = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2")))
    undirected = left.select(group, F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), F.struct(*ENDS).alias("edge"))
    once = undirected.groupBy(group, "a", "b").agg(F.count("*").alias("uses"), F.min("edge").alias("edge"))
    return once.where("uses = 1").select(group, "edge.*")


def followed(edges: DataFrame, group: str) -> DataFrame:
    """(<group>, edge, next): the edge that follows each one; where rings touch in a point, the one that turns most to the left.

    With the inside on the left this keeps parts that only touch apart. An edge that none follows is left out.
    """
    after = edges.select(F.col(group).alias("_group"), *(F.col(c).alias(f"n{c}") for c in ENDS))
    met = edges.join(after, F.col(group).eqNullSafe(F.col("_group")) & (F.col("x2") == F.col("nx1")) & (F.col("y2") == F.col("ny1")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("nx2") - F.col("nx1"), F.col("ny2") - F.col("ny1")
    angle = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    following = F.struct(*(F.col(f"n{c}").alias(c) for c in ENDS))
    chosen = met.groupBy(group, *ENDS).agg(F.max_by(following, F.struct(angle.alias("angle"), following.alias("edge"))).alias("next"))
    return chosen.select(group, F.struct(*ENDS).alias("edge"), "next")


def linked_rings(edges: DataFrame, group: str, settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(<group>, first, seq, n, x1, y1, x2, y2): edges in the order of their ring, which starts at its least edge and has n of them.

    In a round an edge knows the least edge among the 2 ** k that start with it, and how far ahead that is. A round that finds no lesser edge
    anywhere is the last. Every round is settled, so that a lost executor repeats one round at most. An edge on no closed ring is left out.
    """
    state = settle(followed(edges, group).select(group, "edge", "next", F.col("edge").alias("first"), F.lit(0).cast("long").alias("ahead")))
    span = 1
    while True:
        beyond = state.select(F.col(group).alias("_group"), F.col("edge").alias("_edge"), F.col("next").alias("_next"), F.col("first").alias("_first"), F.col("ahead").alias("_ahead"))
        pair = state.join(beyond, F.col(group).eqNullSafe(F.col("_group")) & (F.col("next") == F.col("_edge")), "left")
        lesser = F.coalesce(F.col("_first") < F.col("first"), F.lit(False))
        moved = pair.select(
            group,
            "edge",
            F.col("_next").alias("next"),
            F.when(lesser, F.col("_first")).otherwise(F.col("first")).alias("first"),
            F.when(lesser, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"),
            lesser.alias("lesser"),
        )
        state = settle(moved)
        span *= 2
        if not state.where("lesser").take(1):
            break
    # On a path that ends, looking ahead comes to nothing.
    state = state.where("next IS NOT NULL")
    sizes = state.groupBy(group, "first").agg(F.count("*").alias("n"))
    state = state.join(sizes, [group, "first"])
    return state.select(group, "first", ((F.col("n") - F.col("ahead")) % F.col("n")).alias("seq"), "n", "edge.*")


def _shells_of_holes(rings: DataFrame, linked: DataFrame, group: str) -> DataFrame:
    """(<group>, first, shell): the least shell around the middle of each hole's first edge.

    No other edge of the outlines passes through that point. Edges lie in the bands of y that they touch, two at most, as bands are as high
    as the longest edge of their group; so a hole meets only edges of its own band.
    """
    height = linked.groupBy(group).agg(F.max(F.abs(F.col("y2") - F.col("y1"))).alias("height"))
    band = lambda y: F.floor(y / F.col("height"))
    holes = rings.where("area2 < 0").join(height, group).select(
        F.col(group).alias("_group"),
        F.col("first").alias("hole"),
        ((F.col("first.x1") + F.col("first.x2")) / 2).alias("px"),
        ((F.col("first.y1") + F.col("first.y2")) / 2).alias("py"),
        "height",
    )
    holes = holes.withColumn("_band", band(F.col("py"))).drop("height")
    shells = rings.where("area2 > 0").select(group, "first", "area2")
    sides = linked.join(shells, [group, "first"]).join(height, group)
    sides = sides.withColumn("band", F.explode(F.array_distinct(F.array(band(F.col("y1")), band(F.col("y2"))))))
    crossing = F.col("x1") + F.try_divide(F.col("py") - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    crossed = holes.join(sides, (F.col("_group") == F.col(group)) & (F.col("_band") == F.col("band")) & ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))))
    around = crossed.where(F.col("px") < crossing).groupBy(group, "hole", "first", "area2").agg(F.count("*").alias("crossings"))
    inside = around.where("crossings % 2 = 1").groupBy(group, "hole").agg(F.min_by("first", F.struct("area2", "first")).alias("shell"))
    return inside.withColumnRenamed("hole", "first")


def _numbered(group: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("int")


def dissolve_rings(vertices: DataFrame, groups: DataFrame, group: str, settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(<group>, part, ring, seq, x, y): the dissolved regions as closed rings, shells (ring 0) counter-clockwise and holes clockwise.

    Parts and holes are numbered by their least edge, where their rings also start. Members without a group are left out.
    """
    groups = groups.where(F.col(group).isNotNull())
    linked = settle(linked_rings(outline_edges(vertices, groups, group), group, settle))
    rings = settle(linked.groupBy(group, "first").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("area2")))
    shells = rings.where("area2 > 0").select(group, F.col("first").alias("shell"), (_numbered([group], "first") - 1).alias("part"))
    holes = _shells_of_holes(rings, linked, group)
    named = holes.join(shells, [group, "shell"]).select(group, "first", "part", _numbered([group, "part"], "first").alias("ring"))
    named = named.unionByName(shells.select(group, F.col("shell").alias("first"), "part", F.lit(0).alias("ring")))
    placed = linked.join(named, [group, "first"])
    last = placed.where("seq = n - 1").select(group, "part", "ring", F.col("n").alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return placed.select(group, "part", "ring", "seq", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(last)
