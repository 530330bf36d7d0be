"""HTML extraction: long and deep pages, spans, visibility, and a comparison with the standard library's parser."""

from __future__ import annotations

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from regioflux.llm import html_text, queries


def seconds(page: str) -> tuple[float, str]:
    start = time.process_time()
    text = html_text.render(page)
    return time.process_time() - start, text


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="x" ' * 110_000, "<a b=\"<a c='" * 80_000 + ">x", "<!" * 500_000, "<script>" + "</script " * 100_000])
def test_long_unfinished_markup(page):
    took, text = seconds(page)
    assert took < 10
    assert page.startswith("<script") or len(text) == 0 or text[0] == page[0]


def test_deep_pages():
    took, text = seconds("<div>" * 100_000 + "x" + "</span>" * 100_000 + "</div>" * 100_000 + "<p>y")
    assert took < 20 and text.split() == ["x", "y"]
    took, text = seconds("<blockquote>x" * 20_000)
    assert took < 20 and text.count("x") == 20_000 and max(map(len, text.split("\n"))) <= html_text.WIDEST + 3
    hidden = "<div>" * 250 + "<span hidden>HIDDEN</span><p style='display:none'>gone</p>seen"
    assert html_text.render(hidden) == "seen"


def test_spans_of_cells():
    page = "<table><tr><td rowspan=2>a<td colspan=2>bbbbbb<td>c<tr><td>d<td>e<td>f<tr><td>gg<td>h<td>i<td>j</table>"
    assert html_text.render(page) == "a   bbbbbb  c\n    d  e    f\ngg  h  i    j"
    assert html_text.render("<table><tr><td colspan=99999999 rowspan=x>a<td>b</table>").split() == ["a", "b"]


def test_visibility_is_inherited():
    page = "<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i>too</i></b>no<table><tr><td>no<td style='visibility:visible'>cell</table></div>ok"
    assert html_text.render(page).split() == ["yestoo", "cell", "ok"]
    assert html_text.render("<p hidden>a<b style='visibility:visible'>b</b></p>c") == "c"


class Texts(HTMLParser):
    """All texts that no hidden element holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.words: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            given = dict(attrs)
            style = given.get("style") or ""
            self.open.append((tag, tag in html_text.HIDDEN or "hidden" in given or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style))))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def test_same_words_as_another_parser(spark):
    pages = queries.table(spark, "/root/testdata/sf0.001", "pages")
    found = html_text.extract(pages.select("page_id", F.col("html").alias("source"), "html")).collect()
    assert len(found) == pages.count() > 0
    for row in found:
        other = Texts()
        other.feed(row.source or "")
        other.close()
        # Only what the layout adds, marks of list items, may be more; blocks may part what other text joins.
        assert Counter("".join(other.words)) - Counter("".join(row.text.split())) == Counter()
        more = Counter("".join(row.text.split())) - Counter("".join(other.words))
        assert set(more) <= set("-0123456789.")
