"""Sections from marks: segmentation, numbering, nesting and clean-up.

A section is ``(doc_key, order, title, text, words, rule, number, parent)``; ``parent`` is the
``order`` of a section of the same document. All steps are windows over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import text as X
from ..storage import durable
from . import document, masking, rules, survey
from . import titles as T
from .lines import document_lines

PREAMBLE = "[preamble - before first heading]"


def doc():
    return W.partitionBy("doc_key")


def up():
    return doc().orderBy("order")


def before():
    return up().rowsBetween(W.unboundedPreceding, -1)


def number_of(title: Column) -> Column:
    return F.coalesce(X.first(title, P.NUMBER), X.first(title, P.WORD_NUMBER))


def assemble(marked: DataFrame) -> DataFrame:
    """Sections in order: each runs from its mark to the next, its own line included.

    Text before the first mark is a preamble; a document without marks is one section.
    """
    by_line = doc().orderBy("line_no")
    out = marked.withColumn("seg", F.sum(F.col("rule").isNotNull().cast("int")).over(by_line.rowsBetween(W.unboundedPreceding, 0)))
    parts = out.groupBy("doc_key", "seg").agg(
        F.first("title", True).alias("title"),
        F.first("rule", True).alias("rule"),
        F.first("blocks", True).alias("blocks"),
        F.array_sort(F.collect_list(F.struct("line_no", "stripped", "line"))).alias("held"),
    )
    spaced = X.strip(F.array_join(F.transform("held", lambda x: x["stripped"]), " "))
    broken = X.strip(F.array_join(F.transform("held", lambda x: x["line"]), "\n"))
    whole = F.array_join(F.transform(F.filter("held", lambda x: (x["stripped"] != "") & (x["stripped"] != P.BLOCK)), lambda x: x["line"]), "\n")
    last = F.max("seg").over(doc())
    parts = parts.withColumns({"alone": last == 0, "blocks": F.first("blocks", True).over(doc())})
    text = F.when(F.col("alone"), whole).when(F.col("seg") == 0, broken).otherwise(spaced)
    parts = parts.withColumn("text", text).where("seg > 0 OR alone OR text <> ''")
    parts = parts.withColumns(
        {
            "title": F.when(F.col("alone"), "no header").when(F.col("seg") == 0, PREAMBLE).otherwise(T.clean_title(F.col("title"))),
            "rule": F.when(F.col("alone"), "whole-document").when(F.col("seg") == 0, "preamble").otherwise(F.col("rule")),
        }
    )
    order = (F.row_number().over(W.partitionBy("doc_key").orderBy("seg")) - 1).alias("order")
    parts = parts.select("doc_key", order, "title", "rule", "text", "blocks", X.word_count(F.col("text")).alias("words"))
    return parts.withColumn("number", F.when(F.col("rule") != "whole-document", number_of(F.col("title")))).withColumn("id", T.section_id(F.col("title")))


def nest_numbers(sections: DataFrame) -> DataFrame:
    """``parent``: the nearest section before, within 60, that has the number one level up.

    An attachment in between is a wall. The search is an as-of join: sections and their
    questions meet under the number, and the last section seen answers.
    """
    stem = F.when(F.col("number").contains("."), T.canonical_number(F.regexp_replace("number", r"\.[^.]*$", "")))
    wall = F.last(F.when(T.is_attachment(F.col("title")), F.col("order")), True).over(before())
    base = sections.withColumns({"_stem": stem, "_wall": wall})
    own = F.struct(T.canonical_number(F.col("number")).alias("key"), F.lit(1).alias("is_own"))
    ask = F.struct(F.col("_stem").alias("key"), F.lit(0).alias("is_own"))
    rows = base.select("doc_key", "order", "_wall", F.inline(F.array(own, ask))).where("key <> ''")
    seen = W.partitionBy("doc_key", "key").orderBy("order", "is_own").rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("at", F.last(F.when(F.col("is_own") == 1, F.col("order")), True).over(seen)).where("is_own = 0")
    found = found.where((F.col("order") - F.col("at") <= P.MAX_PARENT_DISTANCE) & (F.col("_wall").isNull() | (F.col("_wall") < F.col("at"))))
    return sections.join(found.select("doc_key", "order", F.col("at").alias("parent")), ["doc_key", "order"], "left")


def nest_lettered(sections: DataFrame) -> DataFrame:
    """Lettered items go under the section before them that is not lettered, unless it is an attachment."""
    anchor = F.last(F.when(F.col("rule") != "lettered", F.struct("order", T.is_attachment(F.col("title")).alias("att"))), True).over(before())
    under = F.when((F.col("rule") == "lettered") & F.col("parent").isNull() & ~F.col("_a.att"), F.col("_a.order"))
    return sections.withColumn("_a", anchor).withColumn("parent", F.coalesce("parent", under)).drop("_a")


def _renumber(kept: DataFrame) -> DataFrame:
    """Dense order again; parents follow, and parents that went are null."""
    new = (F.row_number().over(up()) - 1).alias("_new")
    moved = kept.withColumn("_new", new)
    of = F.map_from_entries(F.collect_list(F.struct("order", "_new")).over(doc()))
    parent = F.when(F.col("parent").isNotNull(), F.try_element_at(F.col("_of"), F.col("parent")))
    return moved.withColumn("_of", of).withColumn("parent", parent).withColumn("order", F.col("_new")).drop("_new", "_of")


def collapse_label_runs(sections: DataFrame, run: int = 6, body: int = 400) -> DataFrame:
    """Six or more short entries in a row by one rule become the first of them.

    Entries under authored Markdown headings and numbered titles are not collapsed.
    """
    small = (
        (F.col("title") != "") & (T.effective_body(F.col("text")) < body) & (X.word_count(F.col("title")) <= 8)
        & (F.col("rule") != "heading") & ~X.strip(F.col("title")).rlike(r"^\d")
    )
    out = sections.withColumn("_s", small)
    joins = F.col("_s") & F.coalesce(F.lag("_s").over(up()), F.lit(False)) & (F.lag("rule").over(up()) == F.col("rule"))
    out = out.withColumn("_isle", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(up().rowsBetween(W.unboundedPreceding, 0)))
    isle = W.partitionBy("doc_key", "_isle")
    out = out.withColumns({"_n": F.count(F.lit(1)).over(isle), "_k": F.row_number().over(isle.orderBy("order"))})
    gone = F.col("_s") & (F.col("_n") >= run) & (F.col("_k") > 1)
    extra = F.collect_list(F.when(F.col("_s") & (F.col("_n") >= run) & (F.col("_k") > 1), F.concat(F.lit("\n"), "title", F.lit(" "), "text"))).over(isle.orderBy("order").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    text = F.when(F.col("_k") == 1, F.concat("text", F.array_join(F.col("_x"), ""))).otherwise(F.col("text"))
    out = out.withColumn("_x", extra).withColumn("text", text).withColumn("_gone", gone).where("NOT _gone")
    return _renumber(out.drop("_s", "_isle", "_n", "_k", "_x", "_gone"))


def name_long_untitled(sections: DataFrame) -> DataFrame:
    """A bare number or a preamble with a long body takes a name from its bold or capital lead."""
    t = X.strip(F.col("title"))
    bare = t.rlike(P.NUMBER_ONLY)
    body = F.regexp_replace(F.col("text"), P.U + r"^\s*\(?\d{1,2}(?:\.\d{1,3})*\)?[.):]?\s+", "")
    name = F.coalesce(T.name_from_bold(body), T.name_from_caps(body))
    named = F.when(bare, F.concat(F.regexp_replace(t, r"\.+$", ""), F.lit(" "), name)).otherwise(name)
    return sections.withColumn("title", F.when((bare | t.startswith("[preamble")) & (F.length(body) > 100) & name.isNotNull(), named).otherwise(F.col("title")))


def nest_under_attachments(sections: DataFrame) -> DataFrame:
    """What follows an attachment marker and has no parent goes under it."""
    marker = T.is_attachment(F.col("title"))
    open_ = F.last(F.when(marker, F.col("order")), True).over(before())
    return sections.withColumn("_o", open_).withColumn("parent", F.coalesce("parent", F.when(~marker, F.col("_o")))).drop("_o")


def _with_children(sections: DataFrame) -> DataFrame:
    parents = F.collect_set("parent").over(doc())
    return sections.withColumn("_p", parents).withColumns({"has_child": F.array_contains("_p", F.col("order")), "nests": F.size("_p") > 0}).drop("_p")


def container_only(sections: DataFrame) -> DataFrame:
    """Sections of fewer than six words that some section names as its parent."""
    return _with_children(sections).withColumn("container_only", (F.col("words") < 6) & F.col("has_child")).drop("has_child", "nests")


def drop_captions(sections: DataFrame) -> DataFrame:
    """Guessed titles that turn out to be running heads, captions or page furniture go."""
    guessed = F.col("rule").isin("caps", "inferred", "block-lead")
    out = _with_children(sections).withColumn("_key", F.when(guessed, T.fold(F.col("title"))))
    group = W.partitionBy("doc_key", "_key")
    bare = (F.col("words") < 10) & ~F.col("has_child")
    out = out.withColumns({"_n": F.count(F.lit(1)).over(group), "_all": F.min(bare.cast("int")).over(group)})
    running = (F.col("_n") >= 3) & (F.col("_all") == 1)
    tables, figures = F.size("tables") > 0, F.size("figures") > 0
    caption = (F.col("words") < 60) & figures & ~tables
    empty = ~tables & ~figures & F.when(F.col("words") < 4, T.is_attachment(F.col("title")) | F.col("nests")).otherwise((F.col("rule") == "caps") & F.col("nests") & (F.col("words") < 12))
    out = out.withColumn("_gone", guessed & ~F.col("has_child") & (running | caption | empty)).where("NOT _gone")
    return _renumber(out.drop("_gone", "_key", "_n", "_all", "has_child", "nests"))


def merge_numbered_lists(sections: DataFrame) -> DataFrame:
    """Three or more short list items in a row, ascending by at most four, fold into the first.

    Off by default: no plan calls it.
    """
    n = F.when((F.length("text") < 240), X.first(X.strip(F.col("title")), P.LIST_ITEM).cast("int"))
    out = sections.withColumn("_n", n)
    joins = F.coalesce(F.col("_n").between(F.lag("_n").over(up()) + 1, F.lag("_n").over(up()) + 4), F.lit(False))
    out = out.withColumn("_isle", F.sum((~joins).cast("int")).over(up().rowsBetween(W.unboundedPreceding, 0)))
    isle = W.partitionBy("doc_key", "_isle")
    every = isle.orderBy("order").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = out.withColumns({"_c": F.count(F.lit(1)).over(isle), "_k": F.row_number().over(isle.orderBy("order")), "_x": F.collect_list(F.struct("title", "text")).over(every)})
    folded = X.strip(F.concat("text", F.array_join(F.transform(F.slice("_x", 2, F.greatest(F.col("_c").cast("int") - 1, F.lit(0))), lambda x: F.concat(F.lit(" "), x["title"], F.lit(" "), x["text"])), "")))
    out = out.withColumn("text", F.when((F.col("_k") == 1) & (F.col("_c") >= 3), folded).otherwise(F.col("text"))).where("NOT (_c >= 3 AND _k > 1)")
    out = out.withColumn("words", X.word_count(F.col("text")))
    return _renumber(out.drop("_n", "_isle", "_c", "_k", "_x"))


def allowed_titles(text: Column) -> Column:
    """Distinct numbered titles of the document, longest first."""
    titles = F.array_distinct(F.transform(X.every(text, P.ALLOWED, 2), X.strip))
    keyed = F.transform(titles, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def prepared(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """``docs(doc_key, raw)`` with regime (of the raw text), masked text, flags and allow list."""
    spark = docs.sparkSession
    base = survey.signals(docs.select("doc_key", F.col(text_col).alias("raw"))).select("doc_key", "raw", "regime")
    flags = survey.regime_rules(spark).withColumnRenamed("caps", "caps_on")
    out = masking.masked_by_columns(base).join(F.broadcast(flags), "regime")  # eight rows
    return out.withColumns(
        {
            "label": F.col("label") | ((F.col("regime") == "clauses") & (F.length("masked") <= P.LABELS_BELOW_CHARS)),
            "allow": F.when(F.col("clause"), allowed_titles(F.col("masked"))).otherwise(F.expr("CAST(array() AS array<string>)")),
            "single_series": X.count(F.col("masked"), P.RESTART) <= 1,
        }
    )


def sectionise(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """Sections of every document, with their tables, figures and prose.

    Columns: ``doc_key, order, id, title, number, parent, rule, words, container_only, text,
    full, tables, figures``. Null text is empty: one section. ``doc_key`` must be unique.
    """
    return document.sections(docs, text_col)


def sectionise_by_windows(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """The same by windows over lines: what :func:`sectionise` is held against in the tests."""
    # Written at three places: a plan of all windows takes longer to analyse than to run, and a
    # lost executor repeats one part of the way only.
    lines = durable(document_lines(durable(prepared(docs, text_col))))
    found = durable(assemble(rules.mark_lines(lines)))
    found = nest_under_attachments(name_long_untitled(collapse_label_runs(nest_lettered(nest_numbers(found)))))
    found = durable(container_only(found))
    full = masking.restored(F.regexp_replace("text", r"(?m)^\x00BLK\x00$\n?", ""), F.col("blocks"))
    out = found.withColumn("title", X.strip(F.replace("title", F.lit(P.BLOCK), F.lit("")))).withColumn("full", full)
    out = out.withColumns({"tables": masking.section_tables(F.col("full")), "figures": masking.section_figures(F.col("full"))})
    out = out.withColumn("text", masking.without_bare_number(F.col("title"), masking.section_prose(F.col("full")))).withColumn("words", X.word_count(F.col("text")))
    out = drop_captions(out.drop("blocks"))
    return out.select("doc_key", "order", "id", "title", "number", "parent", "rule", "words", "container_only", "text", "full", "tables", "figures")
