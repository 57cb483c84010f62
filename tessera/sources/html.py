"""HTML pages and tables: readable text, and tables as rows of cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; entities that matter are resolved."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)</(p|div|li|tr|h[1-6])\s*>|<br\s*/?>", "\n")
    body = F.regexp_replace(body, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


class Tables(HTMLParser):
    """Collects the tables of a page as lists of rows of cell texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())
        elif tag in ("td", "th") and self.open and self.cell is not None:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def has_data(table: list[list[str]]) -> bool:
    """Two rows or more of two cells or more, and digits in two cells or more."""
    return sum(len(r) >= 2 for r in table) >= 2 and sum(any(c.isdigit() for c in x) for r in table for x in r) >= 2


def tables_of(html: str | None) -> list[list[list[str]]]:
    parser = Tables()
    parser.feed(html or "")
    return [[r for r in t if r] for t in parser.tables]


@pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def data_tables(pages: pd.Series) -> pd.Series:
    """Tables of a page that hold data."""
    return pages.map(lambda p: [t for t in tables_of(p) if has_data(t)])


def rendered(table: Column) -> Column:
    """A table as text, one row a line, cells set apart by bars."""
    return F.array_join(F.transform(table, lambda r: F.array_join(r, " | ")), "\n")
