"""Layers as folders of GeoJSON files that tasks write and read in parallel: the Spark data source `geojson_layer`.

Every file is a valid FeatureCollection with one feature on a line and each feature's box in its `bbox`. A list of the files, with the box
of each, is the layer: files that it does not name are not read. So a layer appears or grows in one step, and parts
of tasks that failed, ran twice or were given up are never seen.

Tasks write below a folder of the job's own. On commit the files of the attempts that count are moved out of it and the list is replaced; after that, and
if the job is given up, the folder goes. Appends to one layer have to follow each other. Reading cuts files at line breaks into ranges, leaves
out files whose box misses the window, and parses the asked columns only.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pa_json
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BOX = ("west", "south", "east", "north")
#: The column with a feature's MultiPolygon; other columns that are not of BOX are properties.
SHAPE = "coordinates"
SHAPE_TYPE = "array<array<array<array<double>>>>"
#: Bytes of a file that one task reads, and bytes of lines that are parsed at once.
SPLIT = 64 << 20
BATCH = 4 << 20
CONTENT = "_layer.json"
HEAD, TAIL = b'{"type":"FeatureCollection","features":[\n', b"\n]}\n"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _content(system: fs.FileSystem, root: str) -> list[dict]:
    if system.get_file_info(f"{root}/{CONTENT}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{CONTENT}") as stream:
        return json.loads(stream.read())["files"]


class Range(InputPartition):
    """The lines of a file that begin in a range of bytes."""

    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class Written(NamedTuple):
    file: str
    size: int
    features: int
    box: list[float | None]


class Part(WriterCommitMessage):
    def __init__(self, written: Written | None):
        self.written = written


class LayerReader(DataSourceReader):
    """`window` keeps files only whose box meets it: bounds (west, south, east, north), None for an open side."""

    def __init__(self, path: str, schema: StructType, window: Sequence[float | None], split: int):
        self.path, self.schema, self.window, self.split = path, schema, list(window), split

    def _may_meet(self, box: Sequence[float | None]) -> bool:
        if any(x is None for x in box):
            return all(x is None for x in self.window)
        west, south, east, north = box
        w, s, e, n = self.window
        return (w is None or east >= w) and (s is None or north >= s) and (e is None or west <= e) and (n is None or south <= n)

    def partitions(self) -> Sequence[InputPartition]:
        system, root = _place(self.path)
        files = [f for f in _content(system, root) if self._may_meet(f["box"])]
        ranges = [Range(f["file"], a, min(a + self.split, f["size"])) for f in files for a in range(0, f["size"], self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, root = _place(self.path)
        with io.BufferedReader(system.open_input_file(f"{root}/{partition.file}"), 1 << 20) as stream:
            held: list[bytes] = []
            size = 0
            for line in _lines(stream, partition.start, partition.stop):
                held.append(line)
                size += len(line)
                if size >= BATCH:
                    yield self._parsed(held)
                    held, size = [], 0
            if held:
                yield self._parsed(held)

    def _parsed(self, lines: list[bytes]) -> pa.RecordBatch:
        wanted = to_arrow_schema(self.schema)
        own = [f for f in wanted if f.name not in BOX and f.name != SHAPE]
        fields = []
        if own:
            fields.append(pa.field("properties", pa.struct(own)))
        if any(n in BOX for n in wanted.names):
            fields.append(pa.field("bbox", pa.list_(pa.float64())))
        if SHAPE in wanted.names:
            fields.append(pa.field("geometry", pa.struct([wanted.field(SHAPE)])))
        if not fields:
            return pa.RecordBatch.from_struct_array(pa.array([{}] * len(lines), pa.struct([])))
        data = b"\n".join(lines)
        table = pa_json.read_json(
            io.BytesIO(data),
            read_options=pa_json.ReadOptions(use_threads=False, block_size=len(data) + 1),
            parse_options=pa_json.ParseOptions(explicit_schema=pa.schema(fields), unexpected_field_behavior="ignore"),
        )
        columns = []
        for field in wanted:
            if field.name in BOX:
                column = pc.list_element(table["bbox"], BOX.index(field.name))
            else:
                column = pc.struct_field(table["geometry" if field.name == SHAPE else "properties"], field.name)
            columns.append(column.combine_chunks().cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=wanted)


class PushingReader(LayerReader):
    """Takes bounds on the box columns from the query's own filters. They only leave out files, so Spark checks every row again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if column in ("east", "north") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                side = ("east", "north").index(column)
                self.window[side] = max(f.value, f.value if self.window[side] is None else self.window[side])
            elif column in ("west", "south") and isinstance(f, (LessThan, LessThanOrEqual)):
                side = 2 + ("west", "south").index(column)
                self.window[side] = min(f.value, f.value if self.window[side] is None else self.window[side])
            yield f


def _lines(stream: io.BufferedReader, start: int, stop: int) -> Iterator[bytes]:
    """The features on lines that begin in the range."""
    stream.seek(max(0, start - 1))
    if start:
        stream.readline()  # the line before, or its end
    while stream.tell() < stop:
        line = stream.readline().rstrip(b",\n")
        if line and line not in (HEAD.strip(), TAIL.strip()):
            yield line


class LayerWriter(DataSourceArrowWriter):
    """Writes the columns feature, west, south, east, north."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Part(None)
        system, root = _place(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job[:8]}-{task.taskAttemptId()}.geojson"
        system.create_dir(self._staging(root), recursive=True)
        extremes = [[], [], [], []]
        features, size = 0, 0
        with system.open_output_stream(f"{self._staging(root)}/{name}") as stream:
            batch = first
            while batch is not None:
                text = ",\n".join(batch.column("feature").to_pylist()).encode()
                size += stream.write((HEAD if not features else b",\n") + text)
                features += batch.num_rows
                for i, column in enumerate(BOX):
                    found = (pc.min if i < 2 else pc.max)(batch.column(column)).as_py()
                    extremes[i] += [] if found is None else [found]
                    extremes[i] = [(min if i < 2 else max)(extremes[i])] if extremes[i] else []
                batch = next(batches, None)
            size += stream.write(TAIL)
        return Part(Written(name, size, features, [x[0] if x else None for x in extremes]))

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        before = _content(system, root)
        new = [m.written for m in messages if m is not None and m.written is not None]
        for part in new:
            system.move(f"{self._staging(root)}/{part.file}", f"{root}/{part.file}")
        files = ([] if self.overwrite else before) + [part._asdict() for part in new]
        draft = f"{root}/{CONTENT}-{self.job}"
        with system.open_output_stream(draft) as stream:
            stream.write(json.dumps({"files": files}).encode())
        system.move(draft, f"{root}/{CONTENT}")
        self._clear(system, root)
        for gone in before if self.overwrite else []:
            system.delete_file(f"{root}/{gone['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


class LayerSource(DataSource):
    """Options: path; window (west,south,east,north); split (bytes of a task); pushdown (true where the session pushes filters)."""

    @classmethod
    def name(cls) -> str:
        return "geojson_layer"

    def schema(self) -> str:
        return f"{', '.join(f'{c} double' for c in BOX)}, {SHAPE} {SHAPE_TYPE}"

    def reader(self, schema: StructType) -> DataSourceReader:
        window = [float(x) for x in self.options["window"].split(",")] if "window" in self.options else [None] * 4
        kind = PushingReader if self.options.get("pushdown") == "true" else LayerReader
        return kind(self.options["path"], schema, window, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> LayerWriter:
        missing = {"feature", *BOX} - set(schema.names)
        if missing:
            raise ValueError(f"a layer needs the columns {sorted(missing)}")
        return LayerWriter(self.options["path"], overwrite)


def write_layer_files(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """Adds features (column feature, and their boxes) to a layer, or replaces it. Each partition becomes a file."""
    features.sparkSession.dataSource.register(LayerSource)
    box = F.to_json(F.array(*BOX))
    rows = features.select(F.concat(F.lit('{"bbox":'), box, F.lit(","), F.expr("substring(feature, 2)")).alias("feature"), *BOX)
    rows.write.format(LayerSource.name()).mode("overwrite" if overwrite else "append").option("path", path).save()


def read_layer_files(spark: SparkSession, path: str, properties: str = "", shape: bool = True, view: Sequence[float] | None = None) -> DataFrame:
    """(<properties>, west, south, east, north, coordinates) of a layer's features; properties as a schema text, absent ones are missing.

    Columns that are not asked for are not parsed. view (west, south, east, north) keeps the features whose box meets it.
    """
    spark.dataSource.register(LayerSource)
    names = [*([properties] if properties else []), *(f"{c} double" for c in BOX), *([f"{SHAPE} {SHAPE_TYPE}"] if shape else [])]
    scan = spark.read.format(LayerSource.name()).schema(", ".join(names)).option("path", path)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        scan = scan.option("pushdown", "true")
    if view is None:
        return scan.load()
    west, south, east, north = view
    found = scan.option("window", ",".join(repr(float(x)) for x in view)).load()
    return found.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))


def shape_vertices(layer: DataFrame, key: str = "geo_id", *more: str) -> DataFrame:
    """The vertex table (geo_id, part, ring, seq, x, y) of a layer's shapes, after the columns in more."""
    parts = layer.select(*more, F.col(key).alias("geo_id"), F.posexplode(SHAPE).alias("part", "rings"))
    rings = parts.select(*more, "geo_id", "part", F.posexplode("rings").alias("ring", "path"))
    points = rings.select(*more, "geo_id", "part", "ring", F.posexplode("path").alias("seq", "at"))
    return points.select(*more, "geo_id", "part", "ring", "seq", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))
