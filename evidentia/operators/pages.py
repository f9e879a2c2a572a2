"""Reading pages and scanned layouts: links, headings, list items, lines, entries that run over lines, and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The entities that are turned back into characters.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain(html: Column) -> Column:
    """Text of a piece of markup: no tags, entities turned back, single spaces."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each link of a page: its place, address and text."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>'), 0)
    rows = pages.select(key, F.posexplode(found).alias("place", "tag"))
    return rows.select(key, "place", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("href"), plain(F.col("tag")).alias("text"))


def elements(pages: DataFrame, key: str, html: str, name: str) -> DataFrame:
    """A row for each element of a name that holds none of its own kind: its place and text."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), 1)
    return pages.select(key, F.posexplode(found).alias("place", "inner")).select(key, "place", plain(F.col("inner")).alias("text"))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line with its number."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def entries(numbered: DataFrame, key: str, is_head: Column) -> DataFrame:
    """Lines with entry_no, which rises at each heading; lines before the first heading have 0."""
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("entry_no", F.sum(F.coalesce(is_head, F.lit(False)).cast("int")).over(run))


def joined_entries(numbered: DataFrame, key: str, is_head: Column) -> DataFrame:
    """One row for each entry: its lines, joined in order."""
    rows = entries(numbered, key, is_head)
    listed = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key, "entry_no").agg(F.count("*").alias("n_lines"), F.array_join(listed["line"], " ").alias("text"))


def reading_order(boxes: DataFrame, page: list[str], width: str = "width") -> DataFrame:
    """Boxes (left, right, top, bottom, text) with their place in reading order: bands between full-width boxes, left column first.

    A box is full-width if it crosses the middle and spans over half the page. Boxes of a column are read from the top.
    """
    middle = F.col(width) / 2
    full = (F.col("left") < middle) & (F.col("right") > middle) & (F.col("right") - F.col("left") > middle)
    placed = boxes.withColumn("full", full)
    by_top = Window.partitionBy(*page).orderBy("top", "left", "text").rowsBetween(Window.unboundedPreceding, 0)
    band = F.sum(F.col("full").cast("int")).over(by_top)
    column = F.when(F.col("full"), 0).when((F.col("left") + F.col("right")) / 2 < middle, 1).otherwise(2)
    order = Window.partitionBy(*page).orderBy("band", "column", "top", "left", "text")
    return placed.withColumn("band", band).withColumn("column", column).withColumn("reading_no", F.row_number().over(order))
