"""Reports over section indexes: document records, totals, comparisons, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import verify
from ..storage import durable

#: Thresholds, in words, that a sweep tries.
THRESHOLDS = (0, 10, 15, 20, 25, 30, 40, 50, 60)
FALLBACKS = ("faithful", "faithful-depolarised", "verbatim")


def doc_meta(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts and routes of each document of ``index``; ``docs`` has the sources.

    The index is written once; what is counted and what is audited read it back.
    """
    index, docs = durable(index), durable(docs)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    total = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    facts = {
        "sections": F.count(F.lit(1)), "prose": n(F.col("summary").isNotNull()), "tables": total(F.col("table_summaries")), "pictures": total(F.col("figure_summaries")),
        "bad_token_sections": n(F.size("findings") > 0), "polarity_dropped": total(F.col("polarity_dropped")),
    }
    routes = index.groupBy("doc_key", F.coalesce("chosen", F.lit("none")).alias("chosen")).agg(*(c.alias(k) for k, c in facts.items()))
    choice = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chosen", "sections")))).alias("summary_choice")
    counts = routes.groupBy("doc_key").agg(*(F.sum(k).alias(k) for k in facts), choice)
    none = F.expr("CAST(array() AS array<string>)")
    texts = index.select("doc_key", F.explode(F.array_compact(F.concat(F.array("summary"), F.coalesce("table_summaries", none), F.coalesce(F.transform("parts", lambda p: p["summary"]), none)))).alias("text"))
    money = verify.money_audit(texts, docs)
    sources = docs.select("doc_key", "doc_type", F.length("raw").alias("chars"), F.regexp_count("raw", F.lit("<table")).alias("source_tables"), F.regexp_count("raw", F.lit("<::")).alias("source_pictures"))
    out = sources.join(counts, "doc_key").join(money, "doc_key", "left")
    return out.withColumns({"money_real": F.coalesce(F.col("checked") - F.col("invented"), F.lit(0)), "money_invented": F.coalesce("invented", F.lit(0))}).drop("checked", "invented")


def run_totals(meta: DataFrame) -> DataFrame:
    """Sections, prose sections, tables, pictures and invented amounts of a whole run."""
    return meta.agg(*(F.sum(c).alias(c) for c in ("sections", "prose", "tables", "pictures", "money_invented")))


def outline_meta(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Outline counts of each document beside the tables and pictures its source has."""
    sources = docs.select("doc_key", F.regexp_count("raw", F.lit("<table")).alias("source_tables"), F.regexp_count("raw", F.lit("<::")).alias("source_pictures"))
    return stats.join(sources, "doc_key")


def parser_compare(index: DataFrame) -> DataFrame:
    """Counts of each document by the parser that made its text, parsers side by side.

    ``index(doc_key, parser, words, summary, tables, figures)`` holds the runs of all parsers.
    """
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    facts = index.groupBy("doc_key", "parser").agg(
        F.count(F.lit(1)).alias("sections"), F.count("summary").alias("prose"), F.sum("words").alias("words"), size("tables").alias("tables"), size("figures").alias("figures")
    )
    return facts.groupBy("doc_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parser", F.struct("sections", "prose", "words", "tables", "figures").alias("facts"))))).alias("parsers"))


def split_renders(index: DataFrame) -> DataFrame:
    """``(doc_key, sections_text, summaries_text)``: section texts and summaries as two files."""
    title = F.coalesce(F.nullif(X.strip(F.col("title")), F.lit("")), F.lit("(no header)"))
    held = F.array_sort(F.collect_list(F.struct("order", title.alias("title"), F.coalesce("text", F.lit("")).alias("text"), "summary")))
    part = lambda name: F.array_join(F.transform(F.filter("h", lambda x: x[name].isNotNull()), lambda x: F.concat(x["title"], F.lit("\n"), x[name])), "\n\n")
    return index.groupBy("doc_key").agg(held.alias("h")).select("doc_key", part("text").alias("sections_text"), part("summary").alias("summaries_text"))


def type_rollup(meta: DataFrame, *sums: str) -> DataFrame:
    """Sums by document type and in total, the total under a null type."""
    return meta.rollup("doc_type").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in sums))


def routes_of(meta: DataFrame) -> DataFrame:
    """Prose sections, rewritten, fallen back and quoted for length, from the route counts."""
    pairs = F.map_entries("summary_choice")
    total = lambda test: F.aggregate(F.filter(pairs, lambda e: test(e["key"])), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return meta.withColumns({"prose_n": total(lambda k: k != "none"), "rewritten": total(lambda k: k.startswith("abstractive")), "fell_back": total(lambda k: k.isin(list(FALLBACKS))), "quoted": total(lambda k: k == "extractive-short")})


def run_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' document records side by side: rates of rewriting and outlines that shrank.

    Documents of one run only are kept, with ``side`` saying which; their figures are null.
    """
    cols = ["doc_type", "sections", "prose_n", "rewritten", "fell_back", "quoted"]
    left = routes_of(a).select("doc_key", *(F.col(c).alias(f"{c}_a") for c in cols))
    right = routes_of(b).select("doc_key", *(F.col(c).alias(f"{c}_b") for c in cols))
    rate = lambda s: F.when(F.col(f"prose_n_{s}") > 0, 100.0 * F.col(f"rewritten_{s}") / F.col(f"prose_n_{s}")).otherwise(0.0)
    both = F.col("sections_a").isNotNull() & F.col("sections_b").isNotNull()
    out = left.join(right, "doc_key", "full_outer")
    return out.withColumns(
        {
            "side": F.when(both, "both").when(F.col("sections_a").isNotNull(), "baseline").otherwise("final"),
            "delta": F.when(both, F.bround(rate("b") - rate("a"), 1)),
            "shrank": F.when(both, F.col("sections_b") < F.col("sections_a")),
        }
    )


def threshold_sweep(index: DataFrame) -> DataFrame:
    """What other length thresholds would have done with the quoted sections of a run.

    Sections released to the rewriter are credited at its measured pass rate; thresholds above
    the run's own cannot be inferred.
    """
    prose = index.where("summary IS NOT NULL")
    n = lambda c: F.sum(c.cast("long"))
    quoted = F.col("chosen") == "extractive-short"
    tests = [n(quoted & (F.col("words") <= t)).alias(f"q{t}") for t in THRESHOLDS]
    facts = prose.agg(F.count(F.lit(1)).alias("total"), n(quoted).alias("quoted_now"), n(F.col("chosen").startswith("abstractive")).alias("rew"), n(F.col("chosen").isin(list(FALLBACKS))).alias("hard"), F.max(F.when(quoted, F.col("words"))).alias("cur"), *tests)
    rows = facts.select("*", F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"q{t}").alias("_q")) for t in THRESHOLDS))))
    above = F.col("threshold") >= F.coalesce("cur", F.lit(0))
    q = F.when(above, F.col("quoted_now")).otherwise(F.col("_q"))
    success = F.when(F.col("rew") + F.col("hard") > 0, F.col("rew") / (F.col("rew") + F.col("hard"))).otherwise(1.0)
    rewritten = F.col("rew") + F.bround((F.col("quoted_now") - q) * success).cast("long")
    rows = rows.select("threshold", q.alias("quoted"), rewritten.alias("rewritten"), "total", (F.col("threshold") > F.coalesce("cur", F.lit(0))).alias("not_inferable"))
    return rows.withColumn("rate", F.bround(100.0 * F.col("rewritten") / F.col("total"), 1))


def severe_findings(findings: DataFrame, cap: int = 7) -> DataFrame:
    """Critical and high findings ranked within their packet; ``verified`` marks the first ``cap``."""
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    order = W.partitionBy("packet").orderBy(rank, "claim_id")
    return findings.where(F.col("severity").isin("critical", "high")).withColumn("verified", F.row_number().over(order) <= cap)


def majority_vote(votes: DataFrame, needed: int = 2) -> DataFrame:
    """A claim stands when at least ``needed`` valid votes do not refute it; missing votes drop out."""
    stands = F.count_if(~F.col("refuted")) >= needed
    return votes.groupBy("claim_id").agg(F.count("refuted").alias("votes"), F.count_if(~F.col("refuted")).alias("upheld"), stands.alias("stands"))


def blind_packets(index: DataFrame) -> DataFrame:
    """Sections with a summary, renumbered within the document; nothing tells how it was made."""
    n = F.row_number().over(W.partitionBy("doc_key").orderBy("order"))
    title = F.coalesce(F.nullif(X.strip(F.col("title")), F.lit("")), F.lit("(no header)"))
    return index.where("summary IS NOT NULL AND summary <> ''").select("doc_key", n.alias("n"), title.alias("section_title"), X.one_space(F.col("summary")).alias("published_summary"))


def grouped_outlines(outlines: DataFrame) -> DataFrame:
    """``(doc_type, text)``: the outline files of a type one after the other, by file name."""
    held = F.array_sort(F.collect_list(F.struct("file", "text")))
    head = F.concat(F.repeat(F.lit("#"), 78), F.lit("\n#  "), F.upper("doc_type"), F.lit("  -  "), F.count(F.lit(1)).cast("string"), F.lit(" files\n"), F.repeat(F.lit("#"), 78))
    return outlines.groupBy("doc_type").agg(F.concat_ws("\n\n", head, F.array_join(F.transform(held, lambda x: x["text"]), "\n\n")).alias("text"))


def type_order(doc_type: Column, first: tuple[str, ...] = ("reports", "bills", "contracts", "legal_data")) -> Column:
    """Sort key of types: the preferred ones in their order, then the others by name."""
    place = F.coalesce(*(F.when(doc_type == t, F.lit(k)) for k, t in enumerate(first)), F.lit(len(first)))
    return F.struct(place.alias("place"), doc_type.alias("name"))


def readable_line(spark: SparkSession, scores: bool = False) -> Column:
    """A section as one line: title, facet letters, payload and topics."""
    letters = F.create_map(*(F.lit(v) for pair in (("PAY", "M"), ("EXPIRY", "D"), ("PARTY", "W"), ("PERM", "P"), ("OBLIG", "O")) for v in pair))
    marks = F.array_join(F.transform("facets", lambda f: letters[f]), "")
    topic = lambda t: F.concat(t["topic"], F.concat(F.lit(" "), F.format_number(t["prob"], 2)) if scores else F.lit(""))
    return F.concat_ws("  ", F.rpad(F.coalesce("title", F.lit("")), 60, " "), F.rpad(marks, 5, " "), F.array_join(F.transform("topics", topic), ", "))
