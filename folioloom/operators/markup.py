"""Tables and lists of web pages as rows of cells, by a machine over tags that holds one page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = "struct<kind: string, rows: array<array<string>>>"
#: Fixed value: no cell spans more columns.
MOST_SPAN = 1000


class _Region:
    """A table or list that is open: rows done, the row being filled, and cells that hang down from earlier rows."""

    def __init__(self, kind: str) -> None:
        self.kind, self.rows, self.row, self.hanging = kind, [], None, {}
        self.text, self.across, self.down = None, 1, 1

    def hang(self, last: bool) -> None:
        """Cells from above take their places; at a row's end, those behind it too."""
        while len(self.row) in self.hanging or (last and self.hanging and max(self.hanging) > len(self.row)):
            text, left = self.hanging.pop(len(self.row), ("", 1))
            self.row.append(text)
            if left > 1:
                self.below[len(self.row) - 1] = (text, left - 1)

    def open_row(self) -> None:
        self.close_row()
        self.row, self.below = [], {}

    def close_row(self) -> None:
        self.close_cell()
        if self.row is not None:
            self.hang(True)
            if self.row:
                self.rows.append(self.row)
            self.row, self.hanging = None, self.below

    def open_cell(self, across: int, down: int) -> None:
        self.close_cell()
        if self.row is None:
            self.open_row()
        self.text, self.across, self.down = [], across, down

    def close_cell(self) -> None:
        if self.text is None:
            return
        text, self.text = re.sub(r"\s+", " ", "".join(self.text)).strip(), None
        for _ in range(self.across):
            self.hang(False)
            if self.down > 1:
                self.below[len(self.row)] = (text, self.down - 1)
            self.row.append(text)


def _span(attrs: list, name: str, most: int) -> int:
    value = (dict(attrs).get(name) or "").strip()
    return min(max(int(value), 1), most) if re.fullmatch("[0-9]{1,9}", value) else 1


class _Machine(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("table", "ul", "ol"):
            self.open.append(_Region("table" if tag == "table" else "list"))
            self.found.append(self.open[-1])
        elif self.open:
            top = self.open[-1]
            if top.kind == "list" and tag == "li":
                top.open_row()
                top.open_cell(1, 1)
            elif top.kind == "table" and tag == "tr":
                top.open_row()
            elif top.kind == "table" and tag in ("td", "th"):
                top.open_cell(_span(attrs, "colspan", MOST_SPAN), _span(attrs, "rowspan", 65_534))
            elif tag in ("br", "p", "div"):
                self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        top = self.open[-1]
        if (tag == "table" and top.kind == "table") or (tag in ("ul", "ol") and top.kind == "list"):
            top.close_row()
            top.whole = True
            self.open.pop()
        elif top.kind == "table" and tag in ("td", "th"):
            top.close_cell()
        elif (top.kind, tag) in (("table", "tr"), ("list", "li")):
            top.close_row()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].text is not None and self.cdata_elem is None:
            self.open[-1].text.append(data)


def regions(html: str | None) -> list[dict]:
    """Tables and lists in the order in which they open; a cell that spans stands in each place it covers.

    What is inside an inner table or list belongs to that one only. A region that is never
    closed has no rows; neither has a page that cannot be read. Null has no regions.
    """
    machine = _Machine()
    try:
        machine.feed(html or "")
        machine.close()
    except (AssertionError, ValueError):
        return []
    return [{"kind": r.kind, "rows": r.rows if getattr(r, "whole", False) else []} for r in machine.found]


def with_regions(pages: DataFrame, html: str, name: str = "regions") -> DataFrame:
    """Adds the regions of each page; pages are read in Arrow batches, each by itself."""

    @F.pandas_udf(f"array<{REGION}>")
    def read(x: pd.Series) -> pd.Series:
        return x.map(regions, na_action=None)

    return pages.withColumn(name, read(html))


def visible_text(html: Column | str) -> Column:
    """What a reader sees: no comments, scripts, styles or tags; the commonest references resolved. No Python."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for ref, char in REFERENCES:
        x = F.replace(x, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: Fixed values, in this order: the ampersand last, so nothing is resolved twice.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def visible_text_sql(html: str) -> str:
    x = rf"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for ref, char in REFERENCES:
        x = f"replace({x}, '{ref}', '{char}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
