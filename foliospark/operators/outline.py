"""Outlines: the section forest in reading order, and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

DEPTH_LIMIT = 40


# How outlines show titles and nesting.
NUMBER_TITLE = r"^\d+(?:\.\d+)*\.?$"
CHILD_MARK, LINE_LIMIT = "|_ ", 150


def lacks_header(title: Column) -> Column:
    """Preambles, empty titles, whole documents and bare numbers."""
    t = X.strip(F.coalesce(title, F.lit("")))
    return (t == "") | F.lower(t).startswith("[preamble") | (F.lower(t) == "no header") | t.rlike(NUMBER_TITLE)


def shown_title(title: Column) -> Column:
    t = X.strip(F.coalesce(title, F.lit("")))
    numbered = F.concat(F.regexp_replace(t, r"\.+$", ""), F.lit(".   (no header)"))
    return F.when(t.rlike(NUMBER_TITLE), numbered).when(lacks_header(title), "no header").otherwise(t)


def payload(tables: Column, figures: Column) -> Column:
    """``[2 tables, 1 picture]`` or nothing."""
    some = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))
    parts = F.array_compact(F.array(some(F.size(tables), "table"), some(F.size(figures), "picture")))
    return F.when(F.size(parts) > 0, F.concat(F.lit("   ["), F.array_join(parts, ", "), F.lit("]"))).otherwise("")


def _paths(orders, parents):
    found = {}
    for order, parent in zip(orders, parents):
        found[order] = [*found.get(parent, [])[:DEPTH_LIMIT], order]
    return list(found.values())


def with_paths(sections: DataFrame) -> DataFrame:
    """``sections`` with ``path`` (orders from the root) and ``depth``.

    Parents come before their children, so one fold over a document's sections in order
    settles every path; cycles cannot occur and depth is cut at ``DEPTH_LIMIT``. A document's
    sections are collected once, with all of their columns: select what is needed first.
    """
    kept = [c for c in sections.columns if c not in ("doc_key", "order", "parent")]
    held = sections.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("order", "parent", *kept))).alias("held"))
    paths = held.withColumn("_paths", F.udf(_paths, "array<array<int>>")(F.col("held.order"), F.col("held.parent")))
    rows = paths.select("doc_key", F.explode(F.arrays_zip("held", F.col("_paths").alias("path"))).alias("x"))
    return rows.select("doc_key", *(F.col(f"x.held.{c}") for c in sections.columns if c != "doc_key"), "x.path", (F.size("x.path") - 1).alias("depth"))


def outline_lines(sections: DataFrame) -> DataFrame:
    """``(doc_key, line_no, depth, line)``: one line a section, children under their parents."""
    shown = sections.select("doc_key", "order", "parent", shown_title(F.col("title")).alias("shown"), payload(F.col("tables"), F.col("figures")).alias("load"))
    mark = F.when(F.col("depth") > 0, CHILD_MARK).otherwise("")
    text = F.concat(F.substring(F.concat(F.repeat(F.lit("  "), F.col("depth")), mark, "shown"), 1, LINE_LIMIT), "load")
    rows = with_paths(shown).select("doc_key", "path", "depth", text.alias("line"))
    held = rows.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("path", "depth", "line"))).alias("held"))
    return held.select("doc_key", F.posexplode("held").alias("line_no", "x")).select("doc_key", "line_no", "x.depth", "x.line")


def outline_stats(sections: DataFrame) -> DataFrame:
    """Sections, nested ones, ones without a header, tables and pictures of each document."""
    n = lambda c: F.sum(c.cast("int"))
    return sections.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("sections"), n(F.col("parent").isNotNull()).alias("nested"), n(lacks_header(F.col("title"))).alias("no_header"),
        F.sum(F.size("tables")).alias("tables"), F.sum(F.size("figures")).alias("figures"),
    )


def outline_text(sections: DataFrame) -> DataFrame:
    """``(doc_key, outline)``: a document's outline lines as one text."""
    held = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return outline_lines(sections).groupBy("doc_key").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("outline"))
