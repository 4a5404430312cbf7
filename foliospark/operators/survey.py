"""Structural signals of a document and the class of rules they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X


def matched_marks(text: Column) -> Column:
    """Whole-line emphasis whose opening and closing marks are the same characters."""
    return F.filter(
        X.pairs(text, P.BOLD_ONLY, 1, 3),
        lambda m: F.array_sort(F.split(m["g1"], "")) == F.array_sort(F.split(m["g3"], "")),
    )


def clause_cover(text: Column) -> Column:
    """Distinct top-level clause numbers over the largest; none, or only zero: 0."""
    tops = F.transform(X.every(text, P.CLAUSE, 1), lambda n: F.substring_index(n, ".", 1).cast("int"))
    cover = lambda tops: F.when(F.array_max(tops) > 0, F.size(tops) / F.array_max(tops)).otherwise(F.lit(0.0))
    return X.let(F.array_distinct(tops), cover)


def signals(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """``docs`` with its signal counts, densities (rounded half to even) and ``regime``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    keys = list(P.SIGNATURE_KEYS)
    out = docs.withColumns(
        {
            "chars": F.length(t),
            "md_headings": X.count(t, P.MD_HEADING),
            "clauses": X.count(t, P.CLAUSE),
            "bold_only": F.size(matched_marks(t)),
            "articles": X.count(t, P.ARTICLE),
            "fields": F.size(F.filter(X.every(t, P.FIELD, 1), lambda n: ~F.lower(F.trim(n)).isin(keys))),
            "labels": X.count(t, P.LABEL_ONLY),
            "restarts": X.count(t, P.RESTART),
            "salutation": X.count(t, P.SALUTATION),
            "closing": X.count(t, P.CLOSING),
            "clause_cover": F.bround(clause_cover(t), 2),
        }
    )
    kb = F.greatest(F.lit(1.0), F.col("chars") / 1000.0)
    out = out.withColumns(
        {
            "clauses_per_kb": F.bround(F.col("clauses") / kb, 2),
            "headings_per_kb": F.bround(F.col("md_headings") / kb, 2),
            "articles_per_kb": F.bround(F.col("articles") / kb, 3),
        }
    )
    return out.withColumn("regime", regime())


def regime() -> Column:
    """The first class whose condition holds; thresholds test the rounded densities."""
    c = F.col
    spine = (c("clauses_per_kb") >= 0.15) | (c("clause_cover") >= 0.5)
    backbone = (c("articles") >= 5) & (c("articles_per_kb") >= 0.02)
    fields = F.when((c("md_headings") == 0) & (c("labels") < 3), "flat").otherwise("fields")
    return (
        F.when(((c("clauses") >= 20) & spine) | backbone, "clauses")
        .when((c("clauses") >= 20) | (c("articles") >= 5), "deck")
        .when((c("md_headings") >= 5) & (c("headings_per_kb") >= 0.16), "headings")
        .when((c("clauses") >= 5) & ~spine, "deck")
        .when(c("md_headings") >= 2, "sparse")
        .when(c("clauses") >= 5, "clauses")
        .when((c("bold_only") >= 8) & (c("bold_only") > c("fields")), "clauses")
        .when(c("fields") >= 10, fields)
        .when(c("labels") >= 3, "labels")
        .when((c("salutation") > 0) & (c("closing") > 0), "letter")
        .otherwise("flat")
    )


def regime_rules(spark: SparkSession) -> DataFrame:
    """The rule flags of each regime, a table of fixed size."""
    schema = T.StructType([T.StructField("regime", T.StringType()), *(T.StructField(f, T.BooleanType()) for f in P.FLAGS)])
    return spark.createDataFrame([(r, *(f in on for f in P.FLAGS)) for r, on in P.REGIME_RULES.items()], schema)
