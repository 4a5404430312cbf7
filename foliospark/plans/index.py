"""From documents to a published section index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import chunking, figures, safety, tables, topics, verify
from ..operators.sections import sectionise
from ..storage import durable
from . import scorers


@dataclass(frozen=True)
class Options:
    """Settings of a run; the defaults are those the results are defined with."""

    short_words: int = 25
    least_words: int = 12
    cover: bool = True
    abstractive: bool = True
    cap: int | None = None
    input_limit: int = 1024
    topic_least: float = P.TOPIC_LEAST
    topic_most: int = P.TOPIC_MOST
    topic_gate: bool = True


def routed(sections: DataFrame, options: Options = Options()) -> DataFrame:
    """``sections`` with ``route``: none, extractive-short or model, and ``skipped_for_time``."""
    over = F.lit(False) if options.cap is None else F.col("order") >= options.cap
    useful = (F.col("text") != "") & (F.col("words") > options.least_words) & ~F.col("container_only") & ~over
    short = useful & (F.lit(options.short_words) > 0) & (F.col("words") <= options.short_words)
    route = F.when(short, "extractive-short").when(useful, "model").otherwise("none")
    return sections.withColumns({"route": route, "skipped_for_time": over & (F.col("words") > options.least_words)})


def payloads(sections: DataFrame) -> DataFrame:
    """``(doc_key, order, table_summaries, figure_kinds, figure_summaries)`` of sections that have any."""
    keys = ["doc_key", "order"]
    # Null summaries are left out by the aggregate: a filter before it is pushed down to the
    # tables, with every expression the summary is made of put in once for each use.
    tabs = tables.table_summaries(sections.select(*keys, F.posexplode("tables").alias("n", "body")))
    told = F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("n", "summary"))))
    tabs = tabs.groupBy(*keys).agg(F.transform(told, lambda x: x["summary"]).alias("_t")).where(F.size("_t") > 0).withColumnRenamed("_t", "table_summaries")
    figs = figures.interpret(sections.select(*keys, F.posexplode("figures").alias("n", "description")))
    held = F.array_sort(F.collect_list(F.struct("n", "kind", "meaning")))
    figs = figs.groupBy(*keys).agg(F.transform(held, lambda x: x["kind"]).alias("figure_kinds"), F.transform(held, lambda x: x["meaning"]).alias("figure_summaries"))
    return tabs.join(figs, keys, "full_outer")


def drafted(sections: DataFrame, options: Options, faithful: Callable | None, abstractive: Callable | None) -> DataFrame:
    """Sections routed to the model with parts, both drafts and the published text.

    Long sections are drafted part by part; the stitched parts are drafted again, and safety
    is judged against the whole section.
    """
    split = chunking.coverage_parts if options.cover else chunking.split_parts
    parts = sections.select("doc_key", "order", F.posexplode(split(F.col("text"), options.input_limit)).alias("n", "part"))
    parts = scorers.with_drafts(parts, faithful, "part", "summary")
    held = F.array_sort(F.collect_list(F.struct("n", X.word_count(F.col("part")).alias("words"), "summary", "part")))
    parts = parts.groupBy("doc_key", "order").agg(held.alias("p"))
    label = lambda x, total: F.concat(F.lit("part "), (x["n"] + 1).cast("string"), F.lit(" of "), total.cast("string"))
    total = F.size("p")
    listed = F.transform("p", lambda x: F.struct(label(x, total).alias("label"), x["words"].alias("words"), x["summary"].alias("summary")))
    stitched = F.array_join(F.transform("p", lambda x: x["summary"]), " ")
    parts = parts.select("doc_key", "order", F.when(total > 1, listed).otherwise(F.slice(listed, 1, 0)).alias("parts"), F.when(total > 1, stitched).alias("stitched"))
    out = sections.join(parts, ["doc_key", "order"]).withColumn("_in", F.coalesce("stitched", "text"))
    out = scorers.with_drafts(out, faithful, "_in", "faithful")
    out = scorers.with_drafts(out, abstractive, "_in", "abstractive") if options.abstractive and abstractive else out.withColumn("abstractive", F.lit(None).cast("string"))
    return safety.choose(out, section="text").withColumnRenamed("published", "summary").withColumnRenamed("faithful", "summary_extractive").drop("_in", "stitched", "abstractive")


def section_index(docs: DataFrame, options: Options = Options(), faithful: Callable | None = None, abstractive: Callable | None = None) -> DataFrame:
    """The index row of every section of ``docs(doc_key, raw)``; see :func:`routed` for routes.

    Sections, drafts and payloads are written on the way, so no later step computes them again.
    """
    base = durable(routed(sectionise(docs), options))  # read by every route below
    reason = F.concat(F.lit("section is "), F.col("words").cast("string"), F.lit(" words; quoting it is more faithful than rewording it and no longer"))
    short = base.where("route = 'extractive-short'").withColumns({"summary": safety.verbatim(F.col("text"), 3), "chosen": F.lit("extractive-short"), "reason": reason})
    short = short.withColumn("summary_extractive", F.col("summary"))
    model = durable(drafted(base.where("route = 'model'"), options, faithful, abstractive))
    rest = base.where("route = 'none'")
    out = short.unionByName(model, True).unionByName(rest, True)
    findings = F.when(F.col("route") == "model", F.transform(verify.verify(F.col("summary"), F.col("text")), lambda f: f["token"])).otherwise(F.expr("CAST(array() AS array<string>)"))
    out = out.withColumns({"findings": findings, "facets": verify.facets(F.col("full"))})
    return out.join(durable(payloads(base)), ["doc_key", "order"], "left")


def label_topics(sections: DataFrame, vocabulary: DataFrame, options: Options = Options(), entail: Callable | None = None) -> DataFrame:
    """``(doc_key, order, topics)``: up to three labels, best first, for sections with text."""
    keys = ["doc_key", "order"]
    base = sections.where(X.strip(F.coalesce("full", F.lit(""))) != "").select(*keys, "title", "doctype", F.substring("full", 1, P.PASSAGE_CHARS).alias("passage"))
    pairs = topics.topic_candidates(base, vocabulary)
    hypothesis = F.concat(F.lit("This section is about "), F.coalesce("label", F.replace("topic", F.lit("_"), F.lit(" "))), F.lit("."))
    scored = scorers.with_entailment(pairs.withColumn("hypothesis", hypothesis), entail)
    best = topics.top_topics(scored, keys, options.topic_least, options.topic_most, options.topic_gate)
    held = F.array_sort(F.collect_list(F.struct("rank", "topic", "prob")))
    return best.groupBy(*keys).agg(F.transform(held, lambda x: F.struct(x["topic"].alias("topic"), x["prob"].alias("prob"))).alias("topics"))
