"""Exact deduplication by a 128-bit content hash, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, only_rows, row_key

#: Deleted before texts are compared.
WHITE_SPACE = r"[ \t\n\x0b\f\r]+"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row of each set of equal texts stays; one row out per row in.

    Texts are equal when identical without white space. They are grouped by the 128-bit
    hash *and* the normalised bytes, so the grouping itself compares bytes inside a hash
    group and two texts that merely collide stay apart. Copies are combined before the
    shuffle, so a group with a third of all rows sends one row per map task. The row with
    the most code points stays, then the smallest id.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text: equals the empty text (and any text of white space). Null id: ordered after
    all ids. Rows repeated with the same id: each returns a row; those equal to the row
    that stays are all ``kept``. Empty table: empty result. Other columns are ignored,
    whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        normalised(F.col(text_col)).alias("norm"),
    ).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    # The content hash is the first half of the digest that is reported anyway.
    h128 = F.substring("sha", 1, 16).alias("h128")
    order = F.struct(F.col("points"), (-F.coalesce(F.col("doc_id"), F.lit(NULL_ID))).alias("neg_id"))
    groups = (
        rows.groupBy(h128, "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best"))
        .select(F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "group_size", "best")
    )
    # The whole digest names the byte-compared group on the narrow side.
    narrow = rows.select("doc_id", "points", "sha")
    keep = F.nullif(-F.col("best.neg_id"), F.lit(NULL_ID))
    return narrow.join(groups, "sha").select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(keep) & (F.col("points") == F.col("best.points"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each set of equal texts, with its columns: that which :func:`exact_dedup` keeps.

    Rows are told apart by id and text, so null and repeated ids bring no copy back; of rows
    that agree in both, one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = row_key(F.col(id_col), F.col(text_col)).alias("key")
    rows = docs.select(F.length(text).alias("points"), (-F.coalesce(F.col(id_col), F.lit(NULL_ID))).alias("neg_id"), key, normalised(F.col(text_col)).alias("norm"))
    h128 = F.substring(F.unhex(F.sha2("norm", 256)), 1, 16).alias("h128")
    best = rows.groupBy(h128, "norm").agg(F.max(F.struct("points", "neg_id", "key")).alias("best"))
    return only_rows(docs, best.select(F.col("best.key").alias("key")), id_col, text_col)


#: DuckDB SQL for the query over ``documents``.
EXACT_DEDUP_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
groups_ AS (
  SELECT norm, count(*) AS group_size, max(points) AS most FROM rows_ GROUP BY norm),
keepers AS (
  SELECT g.norm, g.group_size, min(r.doc_id) AS keep_id
  FROM groups_ g JOIN rows_ r ON r.norm = g.norm AND r.points = g.most GROUP BY 1, 2)
SELECT r.doc_id, k.keep_id, k.group_size, r.doc_id = k.keep_id AS kept, sha256(r.norm) AS text_sha256
FROM rows_ r JOIN keepers k ON r.norm = k.norm
"""
