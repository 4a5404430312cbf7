"""Figure descriptions: what kind of figure, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def strip_visual(text: Column) -> Column:
    """Without words about how the figure looks."""
    for pattern, by in ((P.VISUAL, " "), (r"\(\s*\)", " "), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return X.trim_of(F.regexp_replace(text, r"\s+([,.;:])", "$1"), " -–—:;,")


def order_date(text: Column) -> Column:
    """``(y, m, d, txt)`` that sorts in time, day 0 where none is given; no year: null."""
    low = F.lower(text)
    # The month that comes first in the calendar, as several may be named.
    month = F.coalesce(*(F.when(low.contains(m), F.lit(k)) for k, m in enumerate(P.MONTHS, 1)))
    tail = F.coalesce(*(F.when(low.contains(m), F.regexp_extract(low, rf"(?s){m}(.*)$", 1)) for m in P.MONTHS))
    full = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    year = X.first(tail, r"(20\d\d|\d\d)").cast("int")
    day = F.coalesce(X.first(low, r"^\s*(\d{1,2})[-/ ]").cast("int"), F.lit(0))
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})"
    part = lambda k: F.regexp_extract(low, slash, k).try_cast("int")
    named = F.struct(full(year).alias("y"), month.alias("m"), day.alias("d"), text.alias("txt"))
    numeric = F.struct(full(part(3)).alias("y"), part(1).alias("m"), part(2).alias("d"), text.alias("txt"))
    return F.when(month.isNotNull() & year.isNotNull(), named).when(month.isNull() & low.rlike(slash), numeric)


def signature_meaning(d: Column) -> Column:
    """Who signed, as what, for whom and when."""
    unsigned = d.rlike(r"(?i)\bunsigned\b|\[unsigned\]|do not sign")
    signed = F.when(unsigned, "Unsigned").otherwise("Signed")
    names = list(P.NOT_SIGNERS)

    def signer(pattern: str) -> Column:
        found = F.regexp_replace(X.strip(X.first(d, pattern)), r"[ .,]+$", "")
        return X.let(found, lambda n: F.when((n != "") & ~F.substring_index(n, " ", 1).isin(names) & ~n.isin(names), n))

    who = F.coalesce(*map(signer, P.SIGNER))
    titles = [X.let(X.first(d, p), lambda t: F.when(~X.trim_of(t, " _-").isin("", "___"), X.trim_of(t, " _-,"))) for p in P.SIGNER_TITLE]
    party = F.coalesce(*(F.regexp_replace(X.strip(X.first(d, p)), ",+$", "") for p in P.SIGNER_PARTY))
    when = X.first(d, P.U + P.FIGURE_DATE, 0)
    bits = F.array_compact(F.array(F.concat(F.lit("for "), party), F.concat(F.lit("by "), who), F.concat(F.lit("("), F.coalesce(*titles), F.lit(")")), F.concat(F.lit("on "), when)))
    blank = F.concat(signed, F.lit(" signature block without a readable name; it may be a blank template."))
    return X.let(bits, lambda b: F.when(F.size(b) == 0, blank).otherwise(F.concat(signed, F.lit(" "), F.array_join(b, " "), F.lit("."))))


def schedule_meaning(d: Column) -> Column:
    """Title, span and dated milestones of a timeline."""
    dates = X.every(d, P.U + P.FIGURE_DATE)
    named = lambda p, n: F.transform(F.slice(X.pairs(d, p, 1, 2), 1, n), lambda m: X.strip(F.concat(X.strip(m["g1"]), F.lit(" "), m["g2"])))
    stones = F.slice(F.array_distinct(F.concat(named(P.MILESTONE, 6), named(P.BARE_MILESTONE, 4))), 1, 6)
    keyed = F.array_sort(F.array_compact(F.transform(dates, order_date)))
    span = lambda k: F.when(F.size(k) > 1, F.concat(F.lit("It runs "), F.element_at(k, 1)["txt"], F.lit(" to "), F.element_at(k, -1)["txt"], F.lit("."))).otherwise("")
    what = F.substring(F.element_at(F.split(strip_visual(d), "[.:]"), 1), 1, 90)
    tail = X.let(stones, lambda s: F.when(F.size(s) > 0, F.concat(F.lit(" Dated milestones: "), F.array_join(s, "; "), F.lit("."))).when(F.size(dates) > 0, F.concat(F.lit(" "), F.size(dates).cast("string"), F.lit(" dated points in it."))).otherwise(""))
    return X.one_space(F.concat(F.lit("A schedule. "), what, F.lit(" "), X.let(keyed, span), tail))


def diagram_meaning(d: Column) -> Column:
    """What a diagram groups, or else what it names."""
    groups = F.array_distinct(X.every(d, r"-\s*([A-Z][A-Za-z /&]{3,44}?)\s*\((?:[a-z ]+)\s*(?:square|box)\)", 1))
    halves = F.array_distinct(X.every(d, r"([A-Z][A-Za-z]+ Managed)", 1))
    named = F.array_distinct(X.every(strip_visual(d), r"\b([A-Z][A-Za-z]{2,}(?: [A-Z][A-Za-z]{2,}){0,3})\b", 1))
    keep = F.slice(F.filter(named, lambda n: ~F.lower(n).isin("the", "legend", "diagram", "section")), 1, 8)
    lead = F.lit("A diagram of systems and how they are grouped.")
    some = F.concat(
        lead,
        F.when(F.size(groups) > 0, F.concat(F.lit(" It separates: "), F.array_join(groups, ", "), F.lit("."))).otherwise(""),
        F.when(F.size(halves) > 0, F.concat(F.lit(" Split between "), F.array_join(halves, " and "), F.lit("."))).otherwise(""),
    )
    none = F.lit("A diagram, but the description carries no readable content - it needs re-reading at higher resolution.")
    things = X.let(keep, lambda k: F.when(F.size(k) > 0, F.concat(lead, F.lit(" Things named in it: "), F.array_join(k, ", "), F.lit("."))).otherwise(none))
    return F.when((F.size(groups) > 0) | (F.size(halves) > 0), some).otherwise(things)


def interpret(figures: DataFrame, text_col: str = "description") -> DataFrame:
    """``figures`` with ``kind`` and ``meaning``."""
    out = figures.withColumn("_d", X.one_space(F.coalesce(F.col(text_col), F.lit(""))))
    d, low = F.col("_d"), F.lower("_d")
    kind = (
        F.when(d == "", "unknown")
        .when(low.contains("digital signature") | low.contains("docusigned by") | low.startswith("attestation"), "signature")
        .when(low.contains("gantt") | low.contains("timeline") | low.contains("transition plan"), "schedule")
        .when(low.contains("diagram") | low.contains("landscape") | low.contains("network"), "diagram")
        .when(F.length(strip_visual(d)) < 25, "unreadable")
        .otherwise("other")
    )
    out = out.withColumn("kind", kind).withColumn("_c", strip_visual(d))
    thin = F.concat(F.lit("The description is too thin to interpret ('"), F.col("_c"), F.lit("') - this figure needs re-reading."))
    meaning = (
        F.when(F.col("kind") == "unknown", "").when(F.col("kind") == "signature", signature_meaning(d)).when(F.col("kind") == "schedule", schedule_meaning(d))
        .when(F.col("kind") == "diagram", diagram_meaning(d)).when(F.col("kind") == "unreadable", thin).otherwise(F.substring("_c", 1, 300))
    )
    return out.withColumn("meaning", meaning).drop("_d", "_c")
