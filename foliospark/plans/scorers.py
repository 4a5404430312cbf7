"""Where a model plugs in: drafts and entailment scores from vectorised functions.

A scorer takes and gives pandas series, batch by batch; its factory runs once a worker, so
weights are loaded there. The stand-ins are deterministic and need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import safety, topics

Draft = Callable[[pd.Series], pd.Series]
Entail = Callable[[pd.Series, pd.Series], pd.Series]


def with_drafts(sections: DataFrame, load: Callable[[], Draft] | None = None, text_col: str = "text", out: str = "draft") -> DataFrame:
    """``sections`` with a draft for each text; no scorer: a quote of the text."""
    if load is None:
        return sections.withColumn(out, safety.verbatim(F.col(text_col)))

    @F.pandas_udf("string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        draft = load()
        for batch in batches:
            yield draft(batch)

    return sections.withColumn(out, score(F.col(text_col)))


def overlap_score(passage: Column, hypothesis: Column) -> Column:
    """Stand-in for entailment: the share of the hypothesis' stems that the passage has."""
    of = lambda h: F.when(F.size(h) > 0, F.size(F.array_intersect(h, topics.stems(passage))) / F.size(h)).otherwise(F.lit(0.0))
    return X.let(topics.stems(hypothesis), of)


def with_entailment(pairs: DataFrame, load: Callable[[], Entail] | None = None, passage_col: str = "passage", hypothesis_col: str = "hypothesis", out: str = "prob") -> DataFrame:
    """``pairs`` with the probability that the passage entails the hypothesis."""
    if load is None:
        return pairs.withColumn(out, overlap_score(F.col(passage_col), F.col(hypothesis_col)))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        entail = load()
        for passage, hypothesis in batches:
            yield entail(passage, hypothesis)

    return pairs.withColumn(out, score(F.col(passage_col), F.col(hypothesis_col)))


def central(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Of each group the row nearest to the group's mean direction: ``(group, key, cosine)``.

    The mean is summed coordinate by coordinate with map-side combining.
    """
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    joined = vectors.join(means, group)
    cosine = dot(F.col(vector), F.col("mean")) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("mean"), F.col("mean")))
    best = joined.select(group, key, F.bround(cosine, 6).alias("cosine")).groupBy(group).agg(F.max(F.struct("cosine", (-F.col(key)).alias("k"))).alias("b"))
    return best.select(group, (-F.col("b.k")).alias(key), F.col("b.cosine").alias("cosine"))
