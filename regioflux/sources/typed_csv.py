"""CSV scan with types told from the whole data, and a table of the records that do not fit the header.

Every field of every record is put into a class of texts; the classes that a column holds are joined to its type. The join is a
bitwise or, so all map tasks fold their records into one row, and one such row a task is all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioflux.functions.text import sanitize_names

INTEGER, LONG_INTEGER, DECIMAL, LOGICAL, DATE, TIME, TEXT = (1 << i for i in range(7))

# Patterns of the classes. An integer with a leading zero is a code and stays text.
INTEGER_PATTERN = r"^[+-]?(0|[1-9][0-9]*)$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|(0|[1-9][0-9]*)(?=[eE]))([eE][+-]?[0-9]{1,3})?$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"
EXACT_DIGITS = 15  # integers of so many digits are exact as doubles

BAD = "_malformed"


class TypedCsv(NamedTuple):
    """rows: the records with typed columns. malformed: (line) that have too few or too many fields. types: the type of each column."""

    rows: DataFrame
    malformed: DataFrame
    types: dict[str, str]


def text_class(x: Column) -> Column:
    """The class of one field; 0 for a missing one."""
    digits = F.length(F.regexp_replace(x, "[+-]", ""))
    return (
        F.when(x.isNull(), 0)
        .when(x.rlike(INTEGER_PATTERN) & x.try_cast("bigint").isNotNull(), F.when(digits <= EXACT_DIGITS, INTEGER).otherwise(LONG_INTEGER))
        .when(x.rlike(DECIMAL_PATTERN), DECIMAL)
        .when(F.lower(x).isin("true", "false"), LOGICAL)
        .when(x.rlike(DATE_PATTERN) & x.try_cast("date").isNotNull(), DATE)
        .when(x.rlike(TIME_PATTERN) & x.try_cast("timestamp_ntz").isNotNull(), TIME)
        .otherwise(TEXT)
    )


def joined_type(classes: int) -> str:
    """The least type that holds all classes without loss; text where there is none, or no value at all."""
    for held, name in (
        (INTEGER | LONG_INTEGER, "bigint"),
        (INTEGER | DECIMAL, "double"),
        (LOGICAL, "boolean"),
        (DATE, "date"),
        (DATE | TIME, "timestamp_ntz"),
    ):
        if classes and not classes & ~held:
            return name
    return "string"


def column_types(texts: DataFrame) -> dict[str, str]:
    """The type of every column of texts, from one pass over all rows."""
    found = texts.agg(*(F.bit_or(text_class(texts[f"`{c}`"])).alias(str(i)) for i, c in enumerate(texts.columns))).first()
    return {c: joined_type(classes or 0) for c, classes in zip(texts.columns, found)}


def read_typed_csv(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, missing: str = "NA", multi_line: bool = False
) -> TypedCsv:
    """A CSV file or folder. With names the files have no header; otherwise each one has the same, whose texts become valid names.

    Missing fields are empty or hold the given text. Numbers with a leading zero and integers beyond 64 bits stay text; integers of
    more than 15 digits beside fractions make the column text, as doubles would change them. A malformed record has no part in the types.
    The files are read once for the types and again for rows or malformed records. Line breaks inside quotes need multi_line,
    which reads each file in one task.
    """
    options = {"escape": '"', "multiLine": multi_line, "nullValue": missing, "header": names is None}
    if names is None:
        given = spark.read.options(**options).csv(path).columns
        names = sanitize_names(given)
    else:
        given = list(names)
    if BAD in given:
        raise ValueError(f"a column is called {BAD}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*given, BAD)])
    # With columns pruned Spark counts no fields and takes every record for whole.
    strict = {"enforceSchema": False, "columnPruning": False, "columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}
    scan = spark.read.schema(schema).options(**options, **strict).csv(path)
    scan = scan.toDF(*names, BAD)
    # Spark refuses to read the malformed records' column alone, as a count would, so a field is read along. A plain null test would be
    # pushed into the scan, where that column is not yet filled.
    line = F.coalesce(F.concat(F.col(BAD), F.substring(F.coalesce(scan[f"`{names[0]}`"], F.lit("")), 1, 0)), F.lit(""))
    texts = scan.where(line == "").drop(BAD)
    types = column_types(texts)
    rows = texts.select(*(texts[f"`{c}`"].cast(kind).alias(c) for c, kind in types.items()))
    return TypedCsv(rows, scan.where(line != "").select(F.col(BAD).alias("line")), types)
