"""Parts of HTML pages, by the standard library's parser in Arrow batches. Broken markup gives what was understood."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

#: Prefixes of pages that are no articles.
NAMESPACES = ("File:", "Category:", "Help:", "Special:", "Talk:", "User:", "Template:", "Wikipedia:", "Portal:")
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr"}


class _Page(HTMLParser):
    """Collects title, paragraphs, tables with their class, link targets and category texts in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.links, self.categories, self.tables = None, [], [], [], []
        self.open: list[dict] = []
        self.text: list[str] | None = None
        self.kind = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
            if "Category:" in a["href"]:
                self._begin("category")
        elif tag == "h1" and self.title is None and ("firstHeading" in classes or a.get("id") == "firstHeading"):
            self._begin("title")
        elif tag == "p" and not self.open:
            self._begin("p")
        elif tag == "table":
            self.open.append({"classes": classes, "rows": []})
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self._begin(tag)

    def _begin(self, kind: str) -> None:
        self._end()
        self.kind, self.text = kind, []

    def _end(self) -> None:
        if self.text is None:
            return
        text, kind = " ".join("".join(self.text).split()), self.kind
        self.text = None
        if kind == "title":
            self.title = text
        elif kind == "p":
            self.paragraphs.append(text)
        elif kind == "category":
            self.categories.append(text)
        elif self.open and self.open[-1]["rows"]:
            self.open[-1]["rows"][-1].append((kind, text))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "h1", "td", "th") or (tag == "a" and self.kind == "category"):
            self._end()
        elif tag == "table" and self.open:
            self._end()
            self.tables.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    if html:
        page.feed(html)
        page.close()
        page._end()
        page.tables += page.open[::-1]
    return page


def _infobox(html: str | None) -> dict[str, str]:
    box = next((t for t in parse(html).tables if "infobox" in t["classes"]), None)
    out = {}
    for row in box["rows"] if box else []:
        head, cell = (next((x for k, x in row if k == kind), None) for kind in ("th", "td"))
        if head and cell:
            out[head] = cell
    return out


def _tables(html: str | None) -> list[list[list[str]]]:
    return [[[x for _, x in row] for row in t["rows"] if row] for t in parse(html).tables if "wikitable" in t["classes"]]


def is_article_link(href: str) -> bool:
    path = href[len("/wiki/") :] if href.startswith("/wiki/") else ""
    return bool(path) and not path.startswith(NAMESPACES) and "#" not in href and "?" not in href


def _links(html: str | None) -> list[str]:
    return list(dict.fromkeys(h for h in parse(html).links if is_article_link(h)))


def _summary(html: str | None) -> str:
    return " ".join([p for p in parse(html).paragraphs[:5] if len(p) > 50][:3])


def _udf(fn: Callable, kind) -> Callable[[Column], Column]:  # noqa: ANN001
    @F.pandas_udf(kind)
    def over(html: pd.Series) -> pd.Series:
        return html.map(lambda h: fn(h if isinstance(h, str) else None))

    return over


infobox = _udf(_infobox, MapType(StringType(), StringType()))
tables = _udf(_tables, ArrayType(ArrayType(ArrayType(StringType()))))
internal_links = _udf(_links, ArrayType(StringType()))
categories = _udf(lambda h: parse(h).categories, ArrayType(StringType()))
summary = _udf(_summary, StringType())
_heading = _udf(lambda h: parse(h).title, StringType())
_decoded = _udf(lambda u: unquote(u) if u else None, StringType())


def title(html: Column, url: Column) -> Column:
    """The first heading, else the last part of the address with spaces for underscores."""
    return F.coalesce(_heading(html), F.regexp_replace(_decoded(F.nullif(F.regexp_extract(url, r"/wiki/([^?#]*)", 1), F.lit(""))), "_", " "))


def next_link(header: Column) -> Column:
    """The address of the next page in a Link header, null on the last page."""
    return F.nullif(F.regexp_extract(header, r'<([^>]+)>\s*;\s*rel="next"', 1), F.lit(""))
