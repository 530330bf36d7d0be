"""Map-layer tables: the data a map draws, without colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioflux.functions.classes import RATING_LEVELS, ordinal
from regioflux.functions.text import paste
from regioflux.operators.geometry import CHUNK, RING, in_blocks
from regioflux.operators.tables import left_join


def choropleth(
    df: DataFrame,
    region: str,
    label: str,
    value: str,
    rating: str,
    levels: Sequence[str] = RATING_LEVELS,
    reverse: bool = False,
) -> DataFrame:
    """(region, label, value, class, class_index), one row per region."""
    return df.select(
        df[region].alias("region"),
        df[label].alias("label"),
        df[value].alias("value"),
        df[rating].alias("class"),
        ordinal(df[rating], levels, reverse).alias("class_index"),
    )


def popup(*lines: tuple[str, Column]) -> Column:
    """'Title: value' fragments joined by <br>; missing values print as NA."""
    parts: list[Column | str] = []
    for title, value in lines:
        if parts:
            parts.append("<br>")
        parts += [f"{title}: ", value]
    return paste(*parts, sep="")


def legend(df: DataFrame, rating: str, levels: Sequence[str] = RATING_LEVELS) -> DataFrame:
    """(position, level, regions) for every level in order, also those no region has."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(level).alias("level"))
        for i, level in enumerate(levels, start=1)
    ]
    table = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
    counts = df.groupBy(df[rating].alias("level")).agg(F.count("*").alias("regions"))
    return table.join(counts, "level", "left").select(
        "position", "level", F.coalesce("regions", F.lit(0)).alias("regions")
    )


def _extent(df: DataFrame, column: str) -> Column:
    return df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()


def diverging(df: DataFrame, column: str, name: str, midpoint: float = 0.0) -> DataFrame:
    """Position in 0..1 with the midpoint at 0.5, scaled by the larger distance to it."""
    extent, x = _extent(df, column), df[column]
    reach = F.greatest(F.abs(extent["low"] - midpoint), F.abs(extent["high"] - midpoint))
    flat = extent["low"] == extent["high"]
    position = F.when(flat & x.isNotNull(), 0.5).otherwise(
        F.try_divide(x - midpoint, reach * 2) + 0.5
    )
    return df.withColumn(name, position)


def rescaled(df: DataFrame, column: str, name: str, low: float, high: float) -> DataFrame:
    """Linear map of the range of a column to low..high; a constant column gets the middle."""
    extent, x = _extent(df, column), df[column]
    flat = extent["low"] == extent["high"]
    share = F.try_divide(x - extent["low"], extent["high"] - extent["low"])
    position = F.when(flat & x.isNotNull(), (low + high) / 2).otherwise(share * (high - low) + low)
    return df.withColumn(name, position)


def flow_lines(flows: DataFrame, width: Sequence[float] = (0.8, 3.0)) -> DataFrame:
    """Lines of flows that carry coordinates, with a width by size."""
    return rescaled(flows, "migrants", "line_width", *width)


def indicator_geometry(df: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Indicators by region with the box of the region's shape."""
    return left_join(df, boxes, {key: key})


def _ordered(entries: Column, item: str) -> Column:
    return F.transform(F.array_sort(entries), lambda entry: entry[item])


def features(
    regions: DataFrame, vertices: DataFrame, key: str, properties: Sequence[str], chunk: int = CHUNK, keep: Sequence[str] = ()
) -> DataFrame:
    """GeoJSON features as one text column: one MultiPolygon for each region, however large its outline is.

    Rings are put in order block by block. outline_pieces writes an outline in parts of bounded length. keep names columns of the
    regions that stay beside the feature.
    """
    at = F.array("x", "y").alias("at")
    shapes = (
        vertices.withColumn("block", F.floor(F.col("seq") / chunk))
        .groupBy(*RING, "block")
        .agg(_ordered(F.collect_list(F.struct("seq", at)), "at").alias("points"))
        .groupBy(*RING)
        .agg(F.flatten(_ordered(F.collect_list(F.struct("block", "points")), "points")).alias("path"))
        .groupBy("geo_id", "part")
        .agg(_ordered(F.collect_list(F.struct("ring", "path")), "path").alias("rings"))
        .groupBy("geo_id")
        .agg(_ordered(F.collect_list(F.struct("part", "rings")), "rings").alias("coordinates"))
        .select("geo_id", _shape("MultiPolygon"))
    )
    return _features(shapes, regions, key, properties, keep=keep)


def outline_pieces(
    regions: DataFrame, vertices: DataFrame, key: str, properties: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """GeoJSON LineString features of at most chunk + 1 vertices, with the part, ring and block of each among its properties.

    The blocks of a ring, in order, share their end points.
    """
    shapes = (
        in_blocks(vertices, chunk)
        .groupBy(*RING, "block")
        .agg(_ordered(F.collect_list(F.struct("seq", F.array("x", "y").alias("at"))), "at").alias("coordinates"))
        .where(F.size("coordinates") > 1)
        .select(*RING, "block", _shape("LineString"))
    )
    return _features(shapes, regions, key, properties, ("part", "ring", "block"))


def _shape(kind: str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), "coordinates")).alias("shape")


def _features(
    shapes: DataFrame, regions: DataFrame, key: str, properties: Sequence[str], more: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    named = regions.select(regions[key].alias("geo_id"), F.struct(*[regions[c] for c in properties]).alias("own"), *(regions[c].alias(f"_{c}") for c in keep))
    values = F.to_json(F.struct("own.*", *more), {"ignoreNullFields": "false"})
    return shapes.join(named, "geo_id").select(
        F.concat(
            F.lit('{"type":"Feature","properties":'), values, F.lit(',"geometry":'), F.col("shape"), F.lit("}")
        ).alias("feature"),
        *(F.col(f"_{c}").alias(c) for c in keep),
    )
