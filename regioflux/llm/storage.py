"""Tables written to the folder that driver and executors share, which cuts lineage durably."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a new folder and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="llm-")
    return _local[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that a lost executor costs no recomputation before it.

    The reader takes the schema from the files (an empty table has one too) and fails if they are gone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that `written` made and that no table still to be computed reads."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.removeprefix("file:").lstrip("/") not in path:
            raise ValueError(f"{path} is not in {folder}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now. It does so when the driver's JVM collects their plans, which may take long."""
    spark._jvm.System.gc()
