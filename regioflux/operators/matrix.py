"""From a long cell table (file, sheet, year, row, col, value) to flows and records.

A cell is found by its stored address, never by the order of rows in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.functions.missing import in_set
from regioflux.functions.text import clean_count, trim_blank
from regioflux.operators.tables import to_numbers, token_to_null, unpivot

# The layout of the published workbooks.
HEADER_ROW = 7
LAST_HEAD_ROW = 11
COUNTY_HEAD_ROWS = 3
COUNTY_COLUMNS = {
    5: "state_from",
    6: "county_from",
    7: "state_to",
    8: "county_to",
    9: "inflow",
    11: "outflow",
    13: "net_migration",
}
COUNTY_NUMBERS = ("inflow", "outflow", "net_migration")

SHEET = ("file", "sheet")


def skip_rows(cells: DataFrame, n: int) -> DataFrame:
    return cells.where(cells["row"] > n)


def header_columns(
    cells: DataFrame, regions: Sequence[str], header_row: int = HEADER_ROW
) -> DataFrame:
    """(file, sheet, col, origin_state) of the columns whose heading names a region.

    Columns without such a heading, for example margins of error, are thereby left out.
    """
    heads = cells.where(cells["row"] == header_row).select(
        *SHEET, "col", trim_blank(F.col("value")).alias("origin_state")
    )
    return heads.where(in_set(heads["origin_state"], regions))


def row_labels(cells: DataFrame, regions: Sequence[str], head_rows: int = LAST_HEAD_ROW) -> DataFrame:
    """(file, sheet, row, year, current_state) of the rows whose first cell names a region."""
    labels = skip_rows(cells, head_rows).where(F.col("col") == 1)
    named = labels.select(*SHEET, "row", "year", trim_blank(F.col("value")).alias("current_state"))
    return named.where(in_set(named["current_state"], regions))


def matrix_cells(cells: DataFrame, regions: Sequence[str]) -> DataFrame:
    """(file, sheet, row, origin_state, value): the body of the matrix with its column names."""
    body = skip_rows(cells, LAST_HEAD_ROW).select(*SHEET, "row", "col", "value")
    return body.join(header_columns(cells, regions), [*SHEET, "col"]).drop("col")


def sheet_frame(cells: DataFrame, regions: Sequence[str]) -> DataFrame:
    """(file, sheet, year, row, col, current_state, origin_state): every labelled row with every headed column of its sheet.

    Labels and headings of a sheet are gathered in one pass over its first column and its heading row; a sheet's format
    bounds them to 1,048,576 rows and 16,384 columns.
    """
    at = F.col("row")
    name = trim_blank(F.col("value"))
    heads = F.when((at == HEADER_ROW) & in_set(name, regions), F.struct("col", name.alias("origin_state")))
    label = (at > LAST_HEAD_ROW) & (F.col("col") == 1) & in_set(name, regions)
    labels = F.when(label, F.struct("row", "year", name.alias("current_state")))
    edges = cells.where((at == HEADER_ROW) | ((at > LAST_HEAD_ROW) & (F.col("col") == 1)))
    sheets = edges.groupBy(*SHEET).agg(F.collect_list(heads).alias("heads"), F.collect_list(labels).alias("labels"))
    rows = sheets.select(*SHEET, "heads", F.inline("labels"))
    return rows.select(*SHEET, "row", "year", "current_state", F.inline("heads"))


def flows_from_cells(cells: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Long flows straight from the cells. Cells are long already, so the wide matrix is never built.

    Every labelled row has a flow from every headed column of its sheet: a cell that is absent from the sheet is a flow with
    missing migrants, so a region whose whole row is empty stays too. The cells are read twice.
    """
    frame = sheet_frame(cells, regions)
    body = skip_rows(cells, LAST_HEAD_ROW).where(F.col("col") > 1).select(*SHEET, "row", "col", "value")
    filled = frame.join(body, [*SHEET, "row", "col"], "left")
    return filled.select("current_state", "origin_state", "year", clean_count(F.col("value")).alias("migrants"))


def matrix_from_cells(cells: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Wide matrix (current_state, year, one text column per region)."""
    labels = row_labels(cells, regions)
    filled = labels.join(matrix_cells(cells, regions), [*SHEET, "row"], "left")
    wide = filled.groupBy(*SHEET, "row", "current_state", "year").agg(
        *[F.max(F.when(F.col("origin_state") == r, F.col("value"))).alias(r) for r in regions]
    )
    return wide.drop(*SHEET, "row")


def flows_from_matrix(matrix: DataFrame) -> DataFrame:
    """Unpivots a wide matrix; missing cells stay as rows with missing migrants."""
    long = unpivot(matrix, ["current_state", "year"], "origin_state", "migrants")
    return long.select(
        trim_blank(F.col("current_state")).alias("current_state"),
        trim_blank(F.col("origin_state")).alias("origin_state"),
        "year",
        clean_count(F.col("migrants")).alias("migrants"),
    )


def records_by_position(
    cells: DataFrame, columns: Mapping[int, str], head_rows: int = COUNTY_HEAD_ROWS
) -> DataFrame:
    """One record per sheet row with the listed columns, by position from 1."""
    body = skip_rows(cells, head_rows).where(F.col("col").isin(*columns))
    return (
        body.groupBy(*SHEET, "row")
        .agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(c) for i, c in columns.items()])
        .drop(*SHEET, "row")
    )


def county_pairs(cells: DataFrame) -> DataFrame:
    """Clean county-to-county table: '-' is missing, incomplete rows go, numbers are typed."""
    records = token_to_null(records_by_position(cells, COUNTY_COLUMNS))
    return to_numbers(records.na.drop("any"), COUNTY_NUMBERS)
