"""The rule cascade: which lines open a section, under what title and by which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import text as X
from . import titles as T


def block_lead() -> Column:
    """The line as the title of the layout block it opens; else null."""
    t = F.col("stripped")
    w = X.words(t)
    last_lower = (F.size(w) >= 5) & X.starts_lower(F.try_element_at(w, F.lit(-1))) & ~t.rlike(r"[?!]$")
    starts = t.rlike(r"^\p{L}") | (t.rlike(P.ENUMERATOR) & X.starts_upper(F.regexp_replace(t, P.ENUMERATOR, "")))
    fits = (
        F.col("after_block") & F.length(t).between(2, 70) & (F.size(w) <= 9) & ~t.rlike(P.FURNITURE_LINE) & ~t.rlike(r"[.,;:]$")
        & (F.col("fold_count") < P.RUNNING_REPEATS) & ~t.rlike(P.TRAILING_MONEY) & ~last_lower & starts & ~T.lead_noise(t) & ~t.contains("  ")
        & ((F.col("body_here") >= 60) | (F.col("body_next") >= 120)) & ~F.col("is_caption")
    )
    return F.when(fits, t)


def _good(t: Column, most: int) -> Column:
    return (t != "") & ~F.lower(t).isin(list(P.SIGNATURE_KEYS)) & (X.word_count(t) <= most) & ~T.looks_like_content(t)


def shapes(lines: DataFrame) -> DataFrame:
    """``lines`` (with the regime's flags) and the title each rule would give, null where none.

    ``allow`` holds the numbered titles of the document, longest first; ``single_series`` says
    that its clause numbers restart at most once.
    """
    s, line = F.col("stripped"), F.col("line")
    nonempty = lambda t: F.when(t != "", t)
    lead_same = s.rlike(P.BOLD_LEAD) & T.same_marks(F.regexp_extract(s, P.BOLD_LEAD, 1), F.regexp_extract(s, P.BOLD_LEAD, 3))
    leads = lead_same & (X.strip(F.regexp_extract(s, P.BOLD_LEAD, 4)) != "")
    only_same = s.rlike(P.BOLD_ONLY) & T.same_marks(F.regexp_extract(s, P.BOLD_ONLY, 1), F.regexp_extract(s, P.BOLD_ONLY, 3))
    good = lambda t: F.when(_good(t, 14), t)
    html = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, P.HEADING_HTML, 2), r"<[^>]+>", " "), P.U + r"\s{2,}", " ")
    caps_ok = (
        ~F.regexp_replace(F.lower(X.strip(F.col("caps"))), r":+$", "").isin(list(P.BANNERS))
        & ~(F.col("banner") & (F.col("caps_count") >= P.RUNNING_REPEATS)) & ~(F.col("fold_count") >= P.RECURRING_REPEATS) & ~F.col("is_caption")
    )
    hit = F.try_element_at(F.filter("allow", lambda a: s.startswith(a) & (F.length(s) > F.length(a))), F.lit(1))

    def clause(t: Column) -> Column:
        number = F.concat(F.regexp_extract(t, P.NUMBER_PREFIX, 1), F.lit("."))
        other = X.let(T.numbered_prose(t), lambda prose: F.when(F.col("single_series") & prose, number).when(F.col("single_series") | ~prose, F.substring(t, 1, 120)))
        return F.when((t != "") & ~T.looks_like_content(t), F.coalesce(T.inline_title(t), other))

    return lines.withColumns(
        {
            "t_heading": F.when(line.rlike(P.HEADING_LINE), X.let(T.strip_emphasis(F.regexp_extract(line, P.HEADING_LINE, 2)), nonempty)),
            "t_html": F.when(line.rlike(P.HEADING_HTML), X.let(T.strip_emphasis(html), nonempty)),
            "t_block": F.when(F.col("blocklead") & F.col("after_block"), block_lead()),
            "t_bold_lead": F.when(F.col("bold") & leads, X.let(T.strip_emphasis(F.regexp_extract(s, P.BOLD_LEAD, 2)), lambda t: F.when((t != "") & (X.word_count(t) <= 12), t))),
            "t_bold_only": F.when(F.col("bold") & ~leads & only_same, X.let(X.strip(T.strip_emphasis(F.regexp_extract(s, P.BOLD_ONLY, 2))), good)),
            "t_decimal": F.when(F.col("decimal"), T.decimal_title(s)),
            "t_label": F.when(F.col("label") & s.rlike(P.LABEL_ONLY), X.let(X.strip(T.strip_emphasis(F.regexp_extract(s, P.LABEL_ONLY, 1))), good)),
            "t_caps": F.when(F.col("caps_on") & caps_ok, F.col("caps")),
            "t_lettered": F.when(F.col("lettered") & ~F.col("is_caption"), T.lettered_title(s)),
            "t_allow": F.when(F.col("clause"), hit),
            "t_infer": F.when(F.col("infer") & (F.length(s) < 90) & ~F.col("is_caption"), T.clause_heading(s)),
            "t_clause": F.when(F.col("clause") & s.rlike(P.CLAUSE_LINE), X.let(T.strip_emphasis(s), clause)),
        }
    )


def cascade() -> Column:
    """The rule that claims the line, with its title; precedence is the order of the branches."""
    claim = lambda rule, title: F.struct(F.lit(rule).alias("rule"), title.alias("title"))
    c = F.col
    return (
        F.when(c("in_toc"), None)
        .when(c("is_signature"), claim("signature", F.lit("signature block")))
        .when(c("t_heading").isNotNull(), claim("heading", c("t_heading")))
        .when(c("t_html").isNotNull(), claim("html-heading", c("t_html")))
        .when((c("stripped") == "") | c("is_block"), None)
        .when(c("t_block").isNotNull(), claim("block-lead", c("t_block")))
        .when(c("t_bold_lead").isNotNull(), claim("bold-lead", c("t_bold_lead")))
        .when(c("t_bold_only").isNotNull(), claim("bold-only", c("t_bold_only")))
        .when(c("t_decimal").isNotNull(), claim("decimal", c("t_decimal")))
        .when(c("t_label").isNotNull(), claim("label", c("t_label")))
        .when(c("t_caps").isNotNull(), claim("caps", c("t_caps")))
        .when(c("t_lettered").isNotNull(), claim("lettered", c("t_lettered")))
        .when(c("t_allow").isNotNull(), claim("allowlist", c("t_allow")))
        .when(c("infer") & (F.length("stripped") < 90), F.when(c("t_infer").isNotNull(), claim("inferred", c("t_infer"))))
        .when(c("t_clause").isNotNull(), claim("clause", c("t_clause")))
    )


def _kept_caps(found: Column, line_no: Column, spans: Column) -> Column:
    """Whether a line of capitals is kept, given all with its key: the last *kept* one counts."""
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.expr("CAST(array() AS array<int>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        gap = x["line_no"] - acc["last"]
        near = spans & ((gap <= P.NEAR_LINES) | ((gap <= P.PAGE_SPAN) & x["brk"]))
        drop = acc["last"].isNotNull() & (x["cont"] | near)
        return F.struct(F.when(drop, acc["last"]).otherwise(x["line_no"]).alias("last"), F.when(drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["line_no"]))).alias("kept"))

    return F.array_contains(F.aggregate(found, zero, step, lambda acc: acc["kept"]), line_no)


def mark_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``title`` and ``rule`` where a line opens a section, null elsewhere.

    ``lines`` carry the flags, ``allow`` and ``single_series``. Repeats: block leads and bold
    lines share one memory of titles seen in the classes that read layout blocks; capitals
    have their own; then any mark that continues the one before it under its key goes, and
    of a dense run of inferred marks the first stays. Marks that go become null, so lines
    are computed once and never joined with themselves.
    """
    live = F.col("rule").isNotNull()

    def without(df: DataFrame, gone: Column) -> DataFrame:
        df = df.withColumn("rule", F.when(~F.coalesce(gone, F.lit(False)), F.col("rule")))
        return df.withColumn("key", F.when(live, F.col("key")))

    out = shapes(lines).withColumn("claim", cascade()).select(
        "doc_key", "line_no", "line", "stripped", "blocks", "after_break", "furniture", "blocklead", "repeats", F.col("claim.rule").alias("rule"), F.col("claim.title").alias("title")
    )
    out = out.withColumns({"key": T.fold(F.col("title")), "cont": T.says_continued(F.col("title"))})
    leads = F.col("blocklead") & F.col("rule").isin("block-lead", "bold-lead", "bold-only")
    furniture = leads & (F.col("rule") != "block-lead") & F.array_contains("furniture", F.col("key"))
    money = leads & (F.col("rule") == "bold-lead") & F.col("title").rlike(P.TRAILING_MONEY)
    out = without(out, furniture | money).drop("furniture").withColumn("lead", F.coalesce(leads, F.lit(False)))
    nth = F.row_number().over(W.partitionBy("doc_key", "key", "lead").orderBy("line_no"))
    again = F.col("lead") & (nth > 1) & (~F.col("repeats") | F.col("cont"))
    is_caps = F.col("rule") == "caps"
    group = W.partitionBy("doc_key", "key")
    caps = F.array_sort(F.collect_list(F.when(is_caps, F.struct("line_no", "cont", F.col("after_break").alias("brk")))).over(group))
    out = out.withColumns({"_again": again, "_caps": F.when(is_caps, caps)})
    out = without(out, F.col("_again") | (is_caps & ~_kept_caps(F.col("_caps"), F.col("line_no"), ~F.col("repeats")))).drop("_again", "_caps")
    gap = F.when(live, F.col("line_no") - F.lag("line_no").over(group.orderBy("line_no")))
    out = out.withColumn("_gap", gap)
    near = ~F.col("repeats") & ((F.col("_gap") <= P.NEAR_LINES) | ((F.col("_gap") <= P.PAGE_SPAN) & F.col("after_break")))
    out = without(out, F.col("_gap").isNotNull() & (F.col("cont") | near)).withColumn("_live", live)
    order = W.partitionBy("doc_key", "_live").orderBy("line_no")
    joins = live & (F.col("rule") == "inferred") & (F.lag("rule").over(order) == "inferred") & (F.col("line_no") - F.lag("line_no").over(order) <= 2)
    out = out.withColumn("_j", F.coalesce(joins, F.lit(False))).withColumn("_run", F.sum((~F.col("_j")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("doc_key", "_live", "_run")))
    out = without(out, F.col("_j") & (F.col("_n") >= 3))
    return out.select("doc_key", "line_no", "line", "stripped", "blocks", F.when(live, F.col("title")).alias("title"), "rule")


def marks(lines: DataFrame) -> DataFrame:
    """``(doc_key, line_no, title, rule)`` of the lines that open a section."""
    return mark_lines(lines).where("rule IS NOT NULL").select("doc_key", "line_no", "title", "rule")
