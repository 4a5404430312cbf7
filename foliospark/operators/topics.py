"""Topic labels: candidates by document type, a scorer's probabilities, and a lexical gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import text as X
from .polarity import _cut


def topic_words(text: Column) -> Column:
    """Lower-case words of three letters or more; compounds give their parts as well."""
    one = lambda w: F.concat(F.array(X.trim_of(w, "-")), F.when(w.contains("-"), F.filter(F.split(w, "-"), lambda p: F.length(p) > 2)).otherwise(F.expr("CAST(array() AS array<string>)")))
    return F.flatten(F.transform(X.every(F.lower(text), P.TOPIC_WORD), one))


def stem_topic(word: Column) -> Column:
    """Stem for topics: one suffix off a stem of five letters, of three for one-letter suffixes."""
    return X.let(F.lower(word), lambda w: _cut(w, P.TOPIC_ENDINGS, {"s": 3, "e": 3}))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(topic_words(text), stem_topic))


def topic_anchors(label: Column, short: Column, topic: Column) -> Column:
    """Stems of a topic's names, stop words left out."""
    words = topic_words(F.concat_ws(" ", label, short, F.replace(topic, F.lit("_"), F.lit(" "))))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(list(P.TOPIC_STOP))), stem_topic))


def grounded(anchors: Column, text: Column) -> Column:
    return F.arrays_overlap(anchors, stems(text))


def folder_doctype(folder: Column, types: dict[str, str] = P.FOLDER_TYPES) -> Column:
    """The type of documents that a folder holds; agreements where ``types`` does not say."""
    return F.coalesce(*(F.when(folder == k, F.lit(v)) for k, v in types.items()), F.lit("agreements"))


def topic_candidates(sections: DataFrame, topics: DataFrame, doctype_col: str = "doctype") -> DataFrame:
    """Each section with the topics of its document type, or with all where its type has none.

    The vocabulary is a small dimension (tens of rows a type) and is joined by broadcast on
    the type; types without topics meet the whole vocabulary under a type of their own.
    """
    by_type = topics.select("topic", "label", "label_short", F.explode("doctypes").alias("_t")).distinct()
    types = by_type.select("_t").distinct().withColumn("_has", F.lit(True))
    typed = sections.join(F.broadcast(types), sections[doctype_col] == types["_t"], "left").drop("_t")
    typed = typed.withColumn("_key", F.when(F.col("_has"), F.col(doctype_col)).otherwise("*"))
    every = topics.select("topic", "label", "label_short", F.lit("*").alias("_t"))
    vocabulary = by_type.unionByName(every).withColumn("anchors", topic_anchors(F.col("label"), F.col("label_short"), F.col("topic")))
    return typed.join(F.broadcast(vocabulary), F.col("_key") == F.col("_t")).drop("_key", "_t", "_has")


def top_topics(scored: DataFrame, keys: list[str], least: float = P.TOPIC_LEAST, most: int = P.TOPIC_MOST, gate: bool = True) -> DataFrame:
    """The best topics of each section: ``scored(keys, topic, anchors, title, passage, prob)``."""
    out = scored.withColumn("prob", F.bround("prob", 3)).where(F.col("prob") >= least)
    if gate:
        out = out.where(grounded(F.col("anchors"), F.concat_ws(" ", F.coalesce("title", F.lit("")), "passage")))
    order = W.partitionBy(*keys).orderBy(F.col("prob").desc(), "topic")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
