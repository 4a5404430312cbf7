"""Masking of tables and figures, and giving them back to the sections that hold them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import document


def anchors_to_blocks(text: Column) -> Column:
    """Layout anchors become a block-boundary line."""
    return F.regexp_replace(text, P.ANCHOR, f"\n{P.BLOCK}\n")


def without_furniture(text: Column) -> Column:
    """Without envelope, page-break and page-number lines and empty figure markers."""
    for pattern in (*P.FURNITURE, P.EMPTY_VISION):
        text = F.regexp_replace(text, pattern, "")
    return text


def _hide(text: Column, pattern: str, first: Column, keep_newline: bool = False) -> tuple[Column, Column]:
    """Replace the matches by numbered tokens; returns the text and the matches.

    The text is split at the matches and put together again around the tokens, so the
    numbering is a fold inside the row.
    """
    found = X.every(text, pattern)
    pieces = F.split(text, pattern, -1)
    tail = (lambda body: F.when(body.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))) if keep_newline else (lambda body: F.lit(""))
    tokens = F.transform(found, lambda body, k: F.concat(F.lit("(block) MASK"), F.lpad((k + first).cast("string"), 5, "0"), tail(body)))
    joined = F.aggregate(
        F.arrays_zip(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("piece"), tokens.alias("token")),
        F.element_at(pieces, 1),
        lambda acc, x: F.concat(acc, F.coalesce(x["token"], F.lit("")), F.coalesce(x["piece"], F.lit(""))),
    )
    return F.when(F.size(found) > 0, joined).otherwise(text), found


_MASKED = pa.struct([("masked", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def _masked(texts: pa.Array) -> pa.Array:
    found = (document.masked((t.as_py() or b"").decode("utf-8", "replace")) for t in texts)
    return pa.array([{"masked": text.encode(), "blocks": [b.encode() for b in blocks]} for text, blocks in found], _MASKED)


def masked(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """``docs`` with ``masked`` (text to sectionise) and ``blocks`` (what the tokens stand for).

    Tables first, then pipe tables, then figures; a figure may hold a table's token. The
    newline that a pipe table's pattern takes in is put back after its token, so the next
    line stays a line of its own. One pass over the text: as columns, each pattern repeats
    the ones before it in the plan.
    """
    hide = F.arrow_udf(_masked, "struct<masked: binary, blocks: array<binary>>")
    out = docs.withColumn("_m", hide(F.col(text_col).cast("string").cast("binary")))
    return out.withColumns({"masked": F.col("_m.masked").cast("string"), "blocks": F.transform("_m.blocks", lambda b: b.cast("string"))}).drop("_m")


def masked_by_columns(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """The same as column expressions: what :func:`masked` is held against in the tests."""
    out = docs.withColumn("masked", without_furniture(anchors_to_blocks(F.coalesce(F.col(text_col), F.lit("")))))
    out = out.withColumn("blocks", F.expr("CAST(array() AS array<string>)"))
    for pattern in (P.HTML_TABLE, P.PIPE_TABLE, P.VISION):
        text, found = _hide(F.col("masked"), pattern, F.size("blocks"), keep_newline=pattern == P.PIPE_TABLE)
        out = out.withColumn("_m", F.struct(text.alias("t"), F.concat("blocks", found).alias("b"))).withColumns({"masked": F.col("_m.t"), "blocks": F.col("_m.b")}).drop("_m")
    return out.withColumn("masked", F.regexp_replace("masked", r"\n{3,}", "\n\n"))


def restored(text: Column, blocks: Column) -> Column:
    """Tokens replaced by their blocks. Figures come last and may hold tables: the last block goes first."""
    numbered = F.reverse(F.transform(blocks, lambda b, k: F.struct(F.concat(F.lit("MASK"), F.lpad(k.cast("string"), 5, "0")).alias("token"), b.alias("body"))))
    full = F.aggregate(numbered, text, lambda acc, x: F.replace(acc, x["token"], x["body"]))
    return F.when(text.contains("MASK"), full).otherwise(text)


def section_tables(full: Column) -> Column:
    """HTML tables, then pipe tables with more than four pipes."""
    piped = F.filter(X.every(full, P.PIPE_TABLE), lambda t: F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) > 4)
    return F.concat(X.every(full, P.HTML_TABLE), piped)


def section_figures(full: Column) -> Column:
    return X.every(full, P.VISION, 1)


def section_prose(full: Column) -> Column:
    """Without figures, tables, tags and tokens, in single spaces."""
    for pattern in (P.HTML_TABLE, P.VISION, P.PIPE_TABLE, r"<[^>]+>", r"\(block\)|" + P.MASK_TOKEN, r"\x00BLK\x00|\x00", r"(?<![A-Za-z])BLK(?![A-Za-z])"):
        full = F.regexp_replace(full, pattern, " ")
    return X.one_space(full)


def without_bare_number(title: Column, prose: Column) -> Column:
    """Where the title is only a clause number, the prose without that number at its head."""
    number = X.first(title, P.U + r"^(\d{1,2}(?:\.\d{1,3})*)\.?$")
    head = F.regexp_extract(prose, P.U + r"^\(?(\d{1,2}(?:\.\d{1,3})*)\)?[.):]?\s+", 1)
    return F.when(number.isNotNull() & (head == number), F.regexp_replace(prose, P.U + r"^\(?\d{1,2}(?:\.\d{1,3})*\)?[.):]?\s+", "")).otherwise(prose)
