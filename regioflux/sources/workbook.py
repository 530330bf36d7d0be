"""Workbooks (.xlsx) to a long table of cells (file, sheet, row, col, value).

Files are listed by Spark and opened on the executors. A first step takes the sheets of a workbook apart
without reading them, a shuffle spreads the sheets, and a second step streams the cells of each sheet.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHEETS = "file string, position int, sheet string, year int, grid binary, texts binary"
CELLS = "file string, sheet string, year int, row int, col int, value string"
BATCH = 20000

# The names of the spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def list_workbooks(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """(file, content) of the workbooks in a folder, or of one workbook."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("file"), "content")


def assign_years(files: DataFrame, years: Sequence[int]) -> DataFrame:
    """Adds the i-th year to the i-th file by name; unequal numbers of files and years are an error."""
    wanted = len(years)
    # One more name than there are years is enough to see that there are too many files.
    first = files.select("file").orderBy("file").limit(wanted + 1)
    place = F.row_number().over(Window.orderBy("file"))
    problem = F.raise_error(F.lit(f"the number of workbooks is not {wanted}")).cast("int")
    numbered = first.select(
        F.col("file").alias("_file"), place.alias("_place"), F.count("*").over(Window.partitionBy()).alias("_n")
    )
    year = F.get(F.array(*map(F.lit, years)), F.col("_place") - 1)
    paired = numbered.select("_file", F.when(F.col("_n") == wanted, year).otherwise(problem).alias("year"))
    # At most one pair per given year, so the pairs go to the files and not the contents to the pairs.
    return files.join(F.broadcast(paired), files["file"] == paired["_file"], "left").select(
        "file",
        # A file beyond the limit has no pair: the numbers differ.
        F.when(F.col("_file").isNull(), problem).otherwise(F.col("year")).alias("year"),
        *[c for c in files.columns if c != "file"],
    )


def _take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, year, content in zip(batch["file"], batch["year"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                targets = {
                    link.get("Id"): link.get("Target")
                    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
                }
                members = set(book.namelist())
                texts = b""
                if "xl/sharedStrings.xml" in members:
                    texts = zlib.compress(book.read("xl/sharedStrings.xml"))
                entries = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")
                for position, entry in enumerate(entries, start=1):
                    target = targets[entry.get(RELATION)]
                    member = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
                    if member.startswith("xl/worksheets/"):
                        grid = zlib.compress(book.read(member))
                        row = (file, position, entry.get("name"), year, grid, texts)
                        yield pd.DataFrame(
                            [row], columns=["file", "position", "sheet", "year", "grid", "texts"]
                        ).astype({"year": "Int32"})


def _shared_texts(packed: bytes) -> list[str]:
    if not packed:
        return []
    items = ElementTree.fromstring(zlib.decompress(packed)).iter(MAIN + "si")
    return ["".join(_plain_text(item)) for item in items]


def _plain_text(item: ElementTree.Element) -> Iterator[str]:
    """Text runs of an item; phonetic hints are left out."""
    for child in item:
        if child.tag == MAIN + "t":
            yield child.text or ""
        elif child.tag == MAIN + "r":
            yield from _plain_text(child)


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - 64
    return number


def _cell_value(cell: ElementTree.Element, texts: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = cell.find(MAIN + "is")
        return None if held is None else "".join(_plain_text(held))
    raw = cell.findtext(MAIN + "v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    return raw


def _sheet_cells(grid: bytes, texts: list[str]) -> Iterator[tuple[int, int, str]]:
    row_number = 0
    parser = ElementTree.iterparse(io.BytesIO(zlib.decompress(grid)), events=("end",))
    for _, element in parser:
        if element.tag != MAIN + "row":
            continue
        row_number = int(element.get("r", row_number + 1))
        col = 0
        for cell in element.iter(MAIN + "c"):
            address = re.match(r"[A-Z]+", cell.get("r", ""))
            col = _column_number(address.group()) if address else col + 1
            value = _cell_value(cell, texts)
            if value is not None:
                yield row_number, col, value
        element.clear()


def _read_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def table(file: str, sheet: str, year: int, cells: list[tuple[int, int, str]]) -> pd.DataFrame:
        out = pd.DataFrame(cells, columns=["row", "col", "value"])
        out.insert(0, "file", file)
        out.insert(1, "sheet", sheet)
        out.insert(2, "year", pd.array([year] * len(out), dtype="Int32"))
        return out

    for batch in batches:
        for entry in batch.itertuples(index=False):
            year = None if pd.isna(entry.year) else int(entry.year)
            texts, cells = _shared_texts(entry.texts), []
            for cell in _sheet_cells(entry.grid, texts):
                cells.append(cell)
                if len(cells) == BATCH:
                    yield table(entry.file, entry.sheet, year, cells)
                    cells = []
            if cells:
                yield table(entry.file, entry.sheet, year, cells)


def workbook_cells(files: DataFrame, first_sheet: bool = False) -> DataFrame:
    """All non-empty cells of files(file, content[, year]); rows and columns count from 1.

    With first_sheet only the first sheet of each workbook is read.
    """
    year = files["year"].cast("int") if "year" in files.columns else F.lit(None).cast("int")
    sheets = files.select("file", year.alias("year"), "content").mapInPandas(_take_apart, SHEETS)
    if first_sheet:
        sheets = sheets.where(F.col("position") == 1)
    return sheets.repartition("file", "sheet").mapInPandas(_read_cells, CELLS)
