"""Checks of published text against its section, facets, and the audit of amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def verify(summary: Column, section: Column) -> Column:
    """Distinct findings ``(kind, token, source)`` in order: tokens not in the section, changed
    case, inserted spaces, clause numbers the section does not declare."""
    summary = F.coalesce(summary, F.lit(""))
    src = F.regexp_replace(F.coalesce(section, F.lit("")), P.U + r"\s+", " ")
    finding = lambda kind, token, source: F.struct(F.lit(kind).alias("kind"), token.alias("token"), source.alias("source"))
    nothing = F.lit(None).cast("string")

    def of(low: Column) -> Column:
        absent = F.filter(X.every(F.regexp_replace(summary, P.U + r"\s+", " "), P.VERIFY_TOKEN), lambda t: ~t.isin(list(P.VERIFY_STOP)) & ~low.contains(F.lower(t)))
        cased = F.filter(X.every(summary, P.CAMEL), lambda t: ~src.contains(t) & low.contains(F.lower(t)))
        there = lambda t: F.substring(src, F.instr(low, F.lower(t)), F.length(t))
        solid = lambda m: F.regexp_replace(m, r"\.? ", "")
        split = F.filter(X.every(summary, P.SPACED_TOKEN, 0), lambda m: low.contains(F.lower(solid(m))) & ~low.contains(F.lower(m)))
        declared = X.every(src, P.CLAUSE_NUMBER)
        cited = F.filter(X.every(summary, P.CLAUSE_NUMBER), lambda c: ~F.array_contains(declared, c))
        return F.array_distinct(
            F.concat(
                F.transform(absent, lambda t: finding("not-in-section", t, nothing)),
                F.transform(cased, lambda t: finding("case-changed", t, there(t))),
                F.transform(split, lambda t: finding("space-inserted", t, solid(t))),
                F.transform(cited, lambda t: finding("clause-not-declared", t, nothing)),
            )
        )

    return X.let(F.lower(src), of)


def facet_flags(text: Column) -> dict[str, Column]:
    """A boolean for each facet."""
    t = F.coalesce(text, F.lit(""))
    return {name: X.any_of(t, found) for name, found in P.FACETS.items()}


def facets(text: Column) -> Column:
    """The facets that hold, in fixed order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in facet_flags(text).items())))


def money_audit(texts: DataFrame, sources: DataFrame, key: str = "doc_key") -> DataFrame:
    """Per document the amounts in ``texts(key, text)`` and those whose digits the source lacks."""
    amounts = texts.select(key, F.explode(X.every(F.col("text"), r"\$\s?[\d,]+(?:\.\d+)?")).alias("amount"))
    digits = F.regexp_replace("amount", r"[$,\s]", "")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("raw"), F.lit("")), r"<[^>]+>", " "), P.U + r"[\s,]+", "")
    joined = amounts.withColumn("digits", digits).where(F.length("digits") >= 2).join(sources.select(key, bare.alias("bare")), key)
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("bare").contains(F.col("digits"))).alias("invented"))


def near_verbatim(summary: Column, source: Column, run: int = 12) -> Column:
    """Whether twelve words in a row come from the source."""

    def grams(text: Column) -> Column:
        return X.let(X.words(F.lower(text)), lambda w: F.transform(F.when(F.size(w) >= run, F.sequence(F.lit(1), F.size(w) - run + 1)).otherwise(F.expr("CAST(array() AS array<int>)")), lambda k: F.array_join(F.slice(w, k, run), " ")))

    return F.arrays_overlap(grams(summary), grams(source))
