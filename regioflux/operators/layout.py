"""Vertex tables laid out in space, so that a view reads only the files and row groups near it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.operators.geometry import RING, boxes

#: Bits of each coordinate in a place on the curve.
BITS = 16


def _scale(low: Column, high: Column, value: Column) -> Column:
    """Where a value lies between low and high, in 0 .. 2 ** BITS - 1; 0 if they are equal."""
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")


def curve_places(found: DataFrame) -> DataFrame:
    """Boxes (geo_id, west, south, east, north) with their level and place on a Z-order curve.

    The level tells how often the whole extent can be halved before it is smaller than the box, so large boxes come before
    small ones and do not widen the files that hold those. The place interleaves the bits of the box's centre. Boxes without coordinates get none.
    """
    extent = found.agg(F.struct(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))).scalar()
    x = _scale(extent["west"], extent["east"], (F.col("west") + F.col("east")) / 2)
    y = _scale(extent["south"], extent["north"], (F.col("south") + F.col("north")) / 2)
    share = F.greatest(
        F.try_divide(F.col("east") - F.col("west"), extent["east"] - extent["west"]), F.try_divide(F.col("north") - F.col("south"), extent["north"] - extent["south"])
    )
    level = F.least(F.lit(BITS), F.when(share > 0, F.floor(-F.log2(share))).otherwise(BITS)).cast("int")
    bit = lambda of, i, to: F.shiftleft(F.getbit(of, F.lit(i)).cast("long"), to)
    known = F.col("west").isNotNull() & F.col("south").isNotNull()
    at = found.withColumns({"level": F.when(known, level), "_x": x, "_y": y})
    place = reduce(lambda a, b: a.bitwiseOR(b), [bit(F.col(c), i, 2 * i + j) for i in range(BITS) for j, c in enumerate(("_x", "_y"))])
    return at.withColumn("place", F.when(known, place)).drop("_x", "_y")


def write_layout(vertices: DataFrame, path: str, files: int | None = None) -> None:
    """Writes vertices with the box of their region, in files that follow the curve.

    A region or a place of any number of vertices spreads over as many files as it needs, as ranges are cut between vertices too.
    files: their number; by default that of the shuffle partitions, fewer where the adaptive planner joins small ones.
    """
    placed = vertices.select(*RING, "seq", "x", "y").join(curve_places(boxes(vertices)), "geo_id")
    order = ["level", "place", *RING, "seq"]
    ranges = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).drop("level", "place").write.parquet(path)


def layout_view(spark: SparkSession, path: str, view: Sequence[float]) -> DataFrame:
    """Vertices of the regions whose box meets the window (west, south, east, north).

    The four bounds reach the scan as range filters, so row groups whose statistics miss the window are not read.
    """
    west, south, east, north = view
    near = (F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north)
    return spark.read.parquet(path).where(near).select(*RING, "seq", "x", "y")
