"""Files laid out in space, and layers of GeoJSON files: what is read, what is written, and what failed tasks leave behind."""

from __future__ import annotations

import glob
import json
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import ROOT, rows
from regioflux.operators import geometry as geo
from regioflux.operators.layers import features
from regioflux.operators.layout import curve_places, layout_view, write_layout
from regioflux.sources.layer_files import BOX, LayerReader, read_layer_files, shape_vertices, write_layer_files

VERTICES = "geo_id bigint, part int, ring int, seq int, x double, y double"


def squares(spark, n, width):
    """Squares 0.5 wide on a grid."""
    corners = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5), (0.0, 0.0)]
    x, y = (F.col("id") % width).cast("double"), F.floor(F.col("id") / width).cast("double")
    points = F.array(*(F.struct(F.lit(i).alias("seq"), (x + dx).alias("x"), (y + dy).alias("y")) for i, (dx, dy) in enumerate(corners)))
    return spark.range(n).select(F.col("id").alias("geo_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.inline(points))


def scanned_rows(df):
    """Rows that the scan of a plan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_layout_reads_the_files_near_the_view_only(spark, tmp_path):
    vertices = squares(spark, 40000, 200)
    path = str(tmp_path / "layout")
    write_layout(vertices, path, files=32)
    view = (20.2, 30.2, 29.8, 39.8)
    found = layout_view(spark, path, view)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{f}({c}," in plan for c, f in (("east", "GreaterThanOrEqual"), ("west", "LessThanOrEqual"), ("north", "GreaterThanOrEqual"), ("south", "LessThanOrEqual")))
    assert found.count() == 10 * 10 * 5
    counted = found.select("x")
    counted.collect()
    assert scanned_rows(counted) < 200000 / 8
    inside = geo.in_view(vertices, view).select("geo_id")
    assert rows(found) == rows(vertices.join(inside, "geo_id"))


def test_boxes_as_wide_as_the_map_keep_to_their_own_files(spark, tmp_path):
    whole = spark.createDataFrame([(100000 + k, 0, 0, i, x, y) for k in range(3) for i, (x, y) in enumerate([(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 0.0)])], VERTICES)
    path = str(tmp_path / "layout")
    write_layout(squares(spark, 10000, 100).union(whole), path, files=16)
    wide = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index("east")
        wide += any(meta.row_group(g).column(column).statistics.max >= 200 for g in range(meta.num_row_groups))
    assert wide <= 2
    assert layout_view(spark, path, (0.6, 0.6, 0.7, 0.7)).count() == 12


def test_a_place_with_most_vertices_is_cut(spark, tmp_path):
    ring = spark.range(30000).select(F.lit(7).cast("long").alias("geo_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("seq"), F.cos("id").alias("x"), F.sin("id").alias("y"))
    path = str(tmp_path / "layout")
    write_layout(ring.union(squares(spark, 2000, 40)), path, files=8)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")]
    assert max(sizes) < 2 * 40000 / 8


def test_curve_of_nothing_of_points_and_of_missing_coordinates(spark):
    boxes = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0), (2, None, None, None, None)], "geo_id bigint, west double, south double, east double, north double")
    assert rows(curve_places(boxes), "geo_id", "level", "place") == [(1, 16, 0), (2, None, None)]
    assert curve_places(boxes.where("geo_id > 5")).count() == 0


def layer_of(spark, n=3000, width=60):
    vertices = squares(spark, n, width)
    tags = curve_places(geo.boxes(vertices)).withColumns(
        {
            "name": F.when(F.col("geo_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit('a",\n}]é '), "geo_id")),
            "value": F.when(F.col("geo_id") % 5 > 0, F.col("geo_id") / 4),
        }
    )
    return vertices, tags, features(tags, vertices, "geo_id", ("geo_id", "name", "value"), keep=(*BOX, "level", "place"))


def content(path):
    return json.loads(Path(path, "_layer.json").read_text())["files"]


def test_layer_is_read_as_written_however_it_is_cut(spark, tmp_path):
    vertices, tags, found = layer_of(spark)
    path = str(tmp_path / "layer")
    write_layer_files(found.repartitionByRange(6, "level", "place"), path)
    assert len(content(path)) == 6 and sum(f["features"] for f in content(path)) == 3000
    for file in content(path):
        collection = json.loads(Path(path, file["file"]).read_text())
        assert collection["type"] == "FeatureCollection" and len(collection["features"]) == file["features"]
        assert Path(path, file["file"]).stat().st_size == file["size"]
        assert [min(f["bbox"][i] for f in collection["features"]) for i in (0, 1)] == file["box"][:2]
    back = read_layer_files(spark, path, "geo_id bigint, name string, value double")
    assert rows(shape_vertices(back)) == rows(vertices)
    wanted = rows(tags, "geo_id", "name", "value", *BOX)
    assert rows(back, "geo_id", "name", "value", *BOX) == wanted
    assert rows(read_layer_files(spark, path, "value double", shape=False), "value") == rows(tags, "value")
    assert read_layer_files(spark, path, "absent int", shape=False).where("absent is null").count() == 3000
    for split in (37, 29989):
        few = path if split > 37 else str(tmp_path / "few")
        if split == 37:
            write_layer_files(found.where("south = 0 and west < 2").coalesce(1), few)
        cut = spark.read.format("geojson_layer").schema("geo_id bigint, name string").option("path", few).option("split", str(split)).load()
        assert rows(cut) == [w[:2] for w in wanted if split > 37 or w[0] < 2]


def test_layer_leaves_out_files_beside_the_view(spark, tmp_path):
    vertices, _, found = layer_of(spark)
    path = str(tmp_path / "layer")
    write_layer_files(found.repartitionByRange(20, "level", "place"), path)
    view = (10.2, 10.2, 14.8, 14.8)
    schema = read_layer_files(spark, path, "geo_id bigint").schema
    assert 0 < len(LayerReader(path, schema, view, 1 << 20).partitions()) <= 5
    seen = read_layer_files(spark, path, "geo_id bigint", view=view)
    assert rows(seen, "geo_id") == rows(geo.in_view(vertices, view), "geo_id")
    assert read_layer_files(spark, path, view=(900.0, 900.0, 901.0, 901.0)).count() == 0
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        near = read_layer_files(spark, path, "geo_id bigint").where("east >= 10.2 and west <= 14.8 and north > 10.2 and south < 14.8")
        assert rows(near, "geo_id") == rows(seen, "geo_id")
        assert near.rdd.getNumPartitions() <= 5
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_layer_grows_and_is_replaced(spark, tmp_path):
    _, _, found = layer_of(spark, 100, 10)
    path = str(tmp_path / "layer")
    write_layer_files(found.where("south < 4"), path)
    write_layer_files(found.where("south >= 4"), path)
    assert read_layer_files(spark, path).count() == 100
    write_layer_files(found.where("south = 0 and west < 3"), path, overwrite=True)
    assert rows(read_layer_files(spark, path, "geo_id bigint"), "geo_id") == [(0,), (1,), (2,)]
    assert len(list(Path(path).iterdir())) == 1 + len(content(path))
    write_layer_files(found.where("south < 0"), path, overwrite=True)
    assert content(path) == [] and read_layer_files(spark, path).count() == 0


def test_given_up_write_changes_nothing(spark, tmp_path):
    _, _, found = layer_of(spark, 100, 10)
    path = str(tmp_path / "layer")
    write_layer_files(found.where("south < 5"), path)
    before = sorted(p.name for p in Path(path).iterdir())
    broken = found.repartition(4).withColumn("feature", F.when(F.col("west") == 7.0, F.raise_error(F.lit("broken"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="broken"):
        write_layer_files(broken, path)
    assert sorted(p.name for p in Path(path).iterdir()) == before
    assert read_layer_files(spark, path).count() == 50


RETRY = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark import TaskContext
from regioflux.session import local_session
from regioflux.sources.layer_files import write_layer_files
from test_layer_files import layer_of
spark = local_session("retry", **{{"spark.master": "local[2,3]"}})
def flaky(batches):
    task = TaskContext.get()
    for batch in batches:
        yield batch
    if task.partitionId() == 1 and task.attemptNumber() == 0:
        raise ValueError("lost")
found = layer_of(spark, 400, 20)[2].select("feature", "west", "south", "east", "north").repartition(3)
write_layer_files(found.mapInArrow(flaky, found.schema), {path!r})
spark.stop()
"""


def test_task_that_fails_and_runs_again_is_written_once(spark, tmp_path):
    path = str(tmp_path / "layer")
    code = RETRY.format(root=str(ROOT), tests=str(ROOT / "tests"), path=path)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost" in done.stderr
    assert sorted(p.name for p in Path(path).iterdir()) == sorted(["_layer.json", *(f["file"] for f in content(path))])
    assert sum(f["features"] for f in content(path)) == 400
    assert read_layer_files(spark, path).select(*BOX).distinct().count() == 400
