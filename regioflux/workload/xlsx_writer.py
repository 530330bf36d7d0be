"""A minimal workbook writer, so that the scan can be tried on real files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(col: int) -> str:
    letters = ""
    while col:
        col, digit = divmod(col - 1, 26)
        letters = chr(65 + digit) + letters
    return letters


def workbook_bytes(cells: pd.DataFrame) -> bytes:
    """Workbook of the given (sheet, row, col, value) text cells, sheets in name order."""
    texts: dict[str, int] = {}
    sheets = sorted(cells["sheet"].unique())
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        entries, links = [], []
        for i, sheet in enumerate(sheets, start=1):
            entries.append(f'<sheet name={quoteattr(sheet)} sheetId="{i}" r:id="rId{i}"/>')
            links.append(
                f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            )
            rows = []
            held = cells[cells["sheet"] == sheet].sort_values(["row", "col"])
            for row, part in held.groupby("row"):
                content = "".join(
                    f'<c r="{_letters(col)}{row}" t="s">'
                    f"<v>{texts.setdefault(value, len(texts))}</v></c>"
                    for col, value in zip(part["col"], part["value"])
                )
                rows.append(f'<row r="{row}">{content}</row>')
            body = f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
            book.writestr(f"xl/worksheets/sheet{i}.xml", body)
        items = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{"".join(entries)}</sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}">{"".join(links)}</Relationships>',
        )
    return buffer.getvalue()
