"""mapInArrow helpers: new columns beside the old ones, and frames of one schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Bytes of a batch that goes to Python. By rows alone, the default, a batch of long texts has no bound.
BATCH_BYTES = 4 << 20


def by_bytes(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded by bytes. A bound that the session has already stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def add_columns(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """All columns of df, then the columns that make gives for each batch. Columns of the same name (in any case) are replaced."""
    added = fields(ddl)
    taken = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in kept]
    new = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) if not isinstance(x, pa.Array) else x for x in make(batch))], names=[*names, *new])

    return by_bytes(df).mapInArrow(run, T.StructType([*kept, *added]))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
