"""CSV scan, boundary scan and the layer sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regioflux.functions.missing import nan_free
from regioflux.functions.text import sanitize_names

VERTEX_SCHEMA = "geo_id bigint, part int, ring int, seq int, x double, y double"


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = False
) -> DataFrame:
    """A CSV file or folder with header, read with a declared schema; NA and empty fields are missing.

    The header texts become valid column names. Files with line breaks inside quotes need multi_line,
    which reads each file in one task.
    """
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", "NA")
        .option("enforceSchema", False)
        .csv(path)
    )
    return nan_free(raw.toDF(*sanitize_names(raw.columns)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("nullValue", "NA").csv(path)


def read_boundaries(spark: SparkSession, attributes: str, vertices: str) -> tuple[DataFrame, DataFrame]:
    """Region attributes and their vertex table, both parquet."""
    shapes = spark.read.schema(VERTEX_SCHEMA).parquet(vertices)
    return spark.read.parquet(attributes), nan_free(shapes)


def write_layer(layer: DataFrame, path: str) -> None:
    layer.write.mode("errorifexists").parquet(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """Features as newline-delimited GeoJSON."""
    features.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)
