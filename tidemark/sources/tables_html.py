"""Tables of HTML pages as rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_text(fragment: Column) -> Column:
    """Text of an HTML fragment: no comments, scripts, styles or tags, single blanks, entities decoded."""
    text = fragment
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<(?:script|style)\b.*?</(?:script|style)>", r"<[^>]+>", r"\s+"):
        text = F.regexp_replace(text, pattern, " ")
    # The named entities that occur.
    for name, sign in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_element(html: Column, tag: str) -> Column:
    """The inside of the first element of a tag, or null."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.try_element_at(found, F.lit(1))


def table_cells(pages: DataFrame, table: str = "table_html", key: str = "page_id") -> DataFrame:
    """(page_id, row, column, text): the cells of a table's inside, with their places from 0."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all("html_row", F.lit(r"(?is)<(?:th|td)\b[^>]*>(.*?)</(?:th|td)>"), F.lit(1))
    lines = pages.select(key, F.posexplode(rows).alias("row", "html_row"))
    return lines.select(key, "row", F.posexplode(cells).alias("column", "html_cell")).select(key, "row", "column", plain_text(F.col("html_cell")).alias("text"))
