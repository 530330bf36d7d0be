"""Workbook scan and the way from cells to flows and county pairs."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from conftest import rows
from regioflux.operators import matrix
from regioflux.operators.flows import balance
from regioflux.plans import county_flows, state_flows
from regioflux.sources import workbook
from regioflux.workload.xlsx_writer import MAIN, OFFICE, PACKAGE, workbook_bytes

CELLS = "file string, sheet string, year int, row int, col int, value string"


def state_sheet(numbers, sheet="Table"):
    """Cells of a two-state matrix with margins, filler, a total and a repeated heading."""
    cells = [(1, 1, "Title"), (6, 1, "Current"), (7, 2, " Ohio "), (7, 4, "Texas"), (7, 6, "Elsewhere"),
             (8, 2, "Estimate"), (8, 3, "MOE"), (11, 1, "Ohio"), (11, 2, "777"),
             (12, 1, " Ohio\t"), (12, 2, "N/A"), (12, 3, "+/-1"), (12, 4, numbers[0]), (12, 6, "9"),
             (13, 1, "Texas"), (13, 2, numbers[1]), (13, 5, "+/-2"),
             (14, 1, "Total"), (14, 2, "5"), (15, 1, "Current"), (15, 2, "Ohio")]
    return [(sheet, r, c, v) for r, c, v in cells]


def book(cells):
    return workbook_bytes(pd.DataFrame(cells, columns=["sheet", "row", "col", "value"]))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b_2022.xlsx").write_bytes(book(state_sheet(["20", "3,000"])))
    (tmp_path / "a_2021.xlsx").write_bytes(
        book(state_sheet(["1,234", " 7 "]) + state_sheet(["8", "8"], "Zweitblatt"))
    )
    (tmp_path / "notes.txt").write_text("no workbook")
    return str(tmp_path)


def test_folder_scan(spark, folder):
    files = workbook.list_workbooks(spark, folder)
    cells = workbook.workbook_cells(files)
    assert rows(cells.select("sheet").distinct()) == [("Table",), ("Zweitblatt",)]
    assert rows(workbook.workbook_cells(files, first_sheet=True).select("sheet").distinct()) == [("Table",)]
    found = cells.where("file LIKE '%a_2021.xlsx' AND sheet = 'Table'")
    wanted = [(r, c, v) for _, r, c, v in state_sheet(["1,234", " 7 "])]
    assert rows(found, "row", "col", "value") == sorted(wanted)


def test_years_follow_file_names(spark, folder):
    files = workbook.list_workbooks(spark, folder)
    dated = workbook.assign_years(files, [2021, 2022])
    assert [(f.rsplit("/")[-1], y) for f, y in rows(dated, "file", "year")] == [
        ("a_2021.xlsx", 2021),
        ("b_2022.xlsx", 2022),
    ]
    for years in ([2021], [2021, 2022, 2023]):
        with pytest.raises(PySparkException, match="number of workbooks"):
            workbook.assign_years(files, years).collect()


def test_state_flows_from_folder(spark, folder):
    flows = state_flows.read_state_flows(spark, folder, [2021, 2022])
    assert rows(flows, "year", "current_state", "origin_state", "migrants") == [
        (2021, "Ohio", "Ohio", None),
        (2021, "Ohio", "Texas", 1234.0),
        (2021, "Texas", "Ohio", 7.0),
        (2021, "Texas", "Texas", None),
        (2022, "Ohio", "Ohio", None),
        (2022, "Ohio", "Texas", 20.0),
        (2022, "Texas", "Ohio", 3000.0),
        (2022, "Texas", "Texas", None),
    ]
    plan = flows._jdf.queryExecution().executedPlan().toString()
    # The scan itself has two steps; labels with headings and the body each take it once.
    assert len(re.findall(r"MapInPandas \w+\(", plan)) <= 4


def test_region_with_an_empty_row_stays(spark):
    empty = [("Table", 16, 1, "Utah"), ("Table", 7, 8, "Utah")]
    cells = spark.createDataFrame([("f", s, 2021, r, c, v) for s, r, c, v in state_sheet(["1", "2"]) + empty], CELLS)
    flows = matrix.flows_from_cells(cells, ("Ohio", "Texas", "Utah"))
    assert rows(flows.where("current_state = 'Utah'"), "origin_state", "migrants") == [("Ohio", None), ("Texas", None), ("Utah", None)]
    assert rows(flows.where("origin_state = 'Utah'"), "current_state", "migrants") == [("Ohio", None), ("Texas", None), ("Utah", None)]
    assert flows.count() == 9
    assert rows(balance(flows).where("state = 'Utah'"), "state", "inflow", "outflow") == [("Utah", 0.0, 0.0)]


def test_matrix_keeps_missing_cells(spark):
    cells = spark.createDataFrame(
        [("f", s, 2021, r, c, v) for s, r, c, v in state_sheet(["1,234", "7"])], CELLS
    )
    regions = ("Ohio", "Texas")
    wide = matrix.matrix_from_cells(cells, regions)
    assert wide.columns == ["current_state", "year", "Ohio", "Texas"]
    assert rows(matrix.flows_from_matrix(wide), "current_state", "origin_state", "migrants") == [
        ("Ohio", "Ohio", None),
        ("Ohio", "Texas", 1234.0),
        ("Texas", "Ohio", 7.0),
        ("Texas", "Texas", None),
    ]


def test_cell_types(spark):
    sheet = (
        f'<worksheet xmlns="{MAIN}"><sheetData>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>in</t></is></c><c r="AB2"><v>1.5</v></c></row>'
        '<row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>sum</v></c></row>'
        '<row r="9"><c r="B9" t="s"><v>0</v></c><c r="C9"/></row></sheetData></worksheet>'
    )
    texts = f'<sst xmlns="{MAIN}"><si><r><t>a</t></r><r><t>b</t></r><rPh><t>x</t></rPh></si></sst>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("xl/worksheets/sheet1.xml", sheet)
        out.writestr("xl/sharedStrings.xml", texts)
        out.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>',
        )
        out.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}"><Relationship Id="a" Target="/xl/worksheets/sheet1.xml"/>'
            "</Relationships>",
        )
    files = spark.createDataFrame([("f", bytearray(buffer.getvalue()))], "file string, content binary")
    assert rows(workbook.workbook_cells(files), "row", "col", "value") == [
        (2, 1, "in"),
        (2, 28, "1.5"),
        (3, 1, "TRUE"),
        (3, 3, "sum"),
        (9, 2, "ab"),
    ]


def county_sheet(state, records):
    cells = [(r, c, "head") for r in (1, 2, 3) for c in (5, 9, 13)]
    for row, record in enumerate(records, start=4):
        cells += list(zip([row] * 8, (1, 5, 6, 7, 8, 9, 11, 13), ("code", state, *record)))
    return [(state, r, c, v) for r, c, v in cells if v is not None]


def test_county_analysis(spark, tmp_path):
    path = tmp_path / "counties.xlsx"
    path.write_bytes(
        book(
            county_sheet(
                "Ohio",
                [
                    ("Erie County", "Texas", "Bexar County", "20000", "5", "19995"),
                    ("Erie County", "Texas", "Cass County", "-", "5", "5"),
                    ("Lake County", "Texas", "Bexar County", "1", "3", "-2"),
                    ("Lake County", "Texas", "Cass County", "1", None, "-2"),
                ],
            )
            + county_sheet("Alaska", [("Sitka City and Borough", "Ohio", "Erie County", "4", "x", "4")])
        )
    )
    pairs = county_flows.read_county_pairs(spark, str(path))
    assert pairs.columns == list(matrix.COUNTY_COLUMNS.values())
    assert rows(pairs, "county_from", "inflow", "outflow", "net_migration") == [
        ("Erie County", 20000.0, 5.0, 19995.0),
        ("Lake County", 1.0, 3.0, -2.0),
        ("Sitka City and Borough", 4.0, None, 4.0),
    ]
    counties = spark.createDataFrame(
        [("Ohio", "Erie"), ("Ohio", "Lake"), ("Ohio", "Wood"), ("Alaska", "Sitka"), (None, "Nowhere")],
        "STATE_NAME string, NAME string",
    )
    found = county_flows.analyse(pairs, counties)
    assert rows(found["totals"], "county_from", "c_outflow") == [
        ("Erie County", 5.0),
        ("Lake County", 3.0),
        ("Sitka City and Borough", 0.0),
    ]
    assert rows(found["county_layer"], "NAME", "net", "bin") == [
        ("Erie", 19995.0, 5),
        ("Lake", -2.0, 3),
        ("Nowhere", None, None),
        ("Wood", None, None),
    ]
    popups = dict(rows(found["county_layer"], "NAME", "popup"))
    assert popups["Erie"] == "STATE_NAME: Ohio<br>County: Erie<br>Net Migration: 19995"
    assert popups["Wood"].endswith("Net Migration: NA")
    assert rows(found["rust_belt_top"], "county_from") == [("Erie County",), ("Lake County",)]
    assert [r["county_from"] for r in found["rust_belt_bottom"].collect()] == ["Erie County", "Lake County"]
    assert found["top_in"].first()["county_from"] == "Erie County"
    assert found["rust_belt_layer"].count() == 3
