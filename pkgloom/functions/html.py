"""Readable text of HTML documents, and addresses of refresh tags."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCKS = {"p", "div", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "header", "footer", "pre", "blockquote", "ul", "ol"}
HIDDEN = {"script", "style", "head", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in BLOCKS:
            self.out.append("\n")
        elif tag == "img":
            self.out.append(dict(attrs).get("alt") or "")

    def handle_endtag(self, tag) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS or tag == "li":
            self.out.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


def text_of(html: str | None) -> str:
    """Text without tags, scripts, link targets and list items, images by their alternative text, on one line."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(reader.out).split("\n"))
    return " ".join(line for line in lines if line and not line.startswith("*"))


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else text_of(p) for p in pages], dtype=object)


def refresh_target(html: Column) -> Column:
    """The address of a refresh tag, '' for none."""
    return F.regexp_extract(html, r"(?is)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*url=[\"']?([^\"'>\s;]+)", 1)


class _Cells(HTMLParser):
    """Cells of the first row of the table inside the element with the asked id."""

    def __init__(self, element: str) -> None:
        super().__init__(convert_charrefs=True)
        self.element, self.inside, self.open, self.cells = element, False, False, []

    def handle_starttag(self, tag, attrs) -> None:
        if dict(attrs).get("id") == self.element:
            self.inside = True
        elif self.inside and tag == "td":
            self.open = True
            self.cells.append("")

    def handle_endtag(self, tag) -> None:
        if tag == "td":
            self.open = False

    def handle_data(self, data) -> None:
        if self.open:
            self.cells[-1] += data


@F.pandas_udf(StringType())
def copyright_license(pages: pd.Series) -> pd.Series:
    """The third cell of the table of copyright information, null for none."""

    def one(page: str | None) -> str | None:
        reader = _Cells("copyright_info")
        reader.feed(page or "")
        return (reader.cells[2].strip() or None) if len(reader.cells) > 2 else None

    return pd.Series([one(p) for p in pages], dtype=object)
