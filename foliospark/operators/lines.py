"""Lines of a masked document with the context that heading rules ask for.

Every operator works on all documents at once. All windows partition by document (or by
document and key), so one exchange on ``doc_key`` serves them; nothing looks ahead with an
unbounded frame: what comes next is carried back over the reversed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import text as X
from . import titles as T


def doc():
    return W.partitionBy("doc_key")


def up():
    return doc().orderBy("line_no")


def before():
    return up().rowsBetween(W.unboundedPreceding, -1)


def after():
    """Everything later in the document, latest first."""
    return doc().orderBy(F.col("line_no").desc()).rowsBetween(W.unboundedPreceding, -1)


def explode_lines(docs: DataFrame, text_col: str = "masked") -> DataFrame:
    """``(doc_key, ..., line_no, line)``; other columns are kept."""
    kept = [c for c in docs.columns if c not in ("raw", "masked")]
    out = docs.select(*kept, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    if "blocks" not in kept:
        return out
    # The masked blocks travel once a document, on its first line.
    return out.withColumn("blocks", F.when(F.col("line_no") == 0, F.col("blocks")))


def contents_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``in_toc``: inside an accepted list of contents.

    A list runs from its declaration to the last paged line before the next line that stops
    it; it is accepted with eight paged entries that are 40 % of all.
    """
    kind = T.toc_class(F.col("line"))
    out = lines.withColumn("_k", kind).withColumn("_seg", F.sum((F.col("_k") == "stop").cast("int")).over(up().rowsBetween(W.unboundedPreceding, 0)))
    seg = W.partitionBy("doc_key", "_seg")
    so_far = seg.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("_last", F.max(F.when(F.col("_k") == "paged", F.col("line_no"))).over(seg))
    listed = F.col("line_no") <= F.col("_last")
    paged, plain = (F.col("_k") == "paged").cast("int"), ((F.col("_k") == "plain") & listed).cast("int")
    out = out.withColumns({"_p": F.sum(paged).over(seg) - F.sum(paged).over(so_far), "_q": F.sum(plain).over(seg) - F.sum(plain).over(so_far)})
    opens = F.col("line").rlike(P.TOC_DECLARES) & (F.col("_p") >= 8) & (F.col("_p") >= 0.4 * (F.col("_p") + F.col("_q")))
    opened = F.max(opens.cast("int")).over(seg.orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("in_toc", F.coalesce((opened == 1) & listed, F.lit(False))).drop("_k", "_seg", "_last", "_p", "_q")


def join_split_numbers(lines: DataFrame) -> DataFrame:
    """Numbers and divisions that stand alone joined with the title on the next line.

    A bare-number heading joins the shallower heading above it. A line that is taken as a
    title takes none itself, so of a chain of candidates every second one is taken. Line
    count and numbering stay; the line that is joined becomes empty.
    """
    line, filled = F.col("line"), F.when(X.strip(F.col("line")) != "", F.struct("line_no", "line"))
    out = lines.withColumns({"_next": F.last(filled, True).over(after()), "_prev": F.last(filled, True).over(before())})
    free = ~F.col("in_toc")
    nxt, prev = X.strip(F.col("_next.line")), F.col("_prev.line")
    # a bare-number heading under a shallower titled one
    level = lambda c: F.length(F.regexp_extract(c, P.HEADING_LINE, 1))
    head = lambda c: X.strip(F.regexp_extract(c, P.HEADING_LINE, 2))
    bare = free & line.rlike(P.HEADING_LINE) & head(line).rlike(P.BARE_NUMBER)
    above = prev.rlike(P.HEADING_LINE) & (level(prev) < level(line)) & (head(prev) != "") & ~head(prev).rlike(r"^\d")
    out = out.withColumn("_up", F.coalesce(bare & above, F.lit(False)))
    # a division or a number alone before its title
    division = (
        free & line.rlike(P.DIVISION_ALONE) & F.length(nxt).between(3, 90) & ~nxt.endswith(".") & (X.word_count(nxt) <= 12) & X.starts_upper(nxt)
        & ~nxt.rlike(P.HEADING_LINE) & (nxt != P.BLOCK) & ~nxt.rlike(P.NO_DIVISION_TITLE) & ~nxt.rlike(P.MASKED_BLOCK)
    )
    titled = T.inline_title(F.concat(F.regexp_extract(line, P.NUMBER_ALONE, 1), F.lit(". "), nxt)).isNotNull()
    number = (
        free & line.rlike(P.NUMBER_ALONE) & ~nxt.rlike(P.NUMBER_ALONE) & (nxt != P.BLOCK) & (F.length(nxt).between(3, 90) | titled)
        & ~nxt.rlike(r"^(?:<a id=|<::|<table|\(block\)|- |\* |MASK\d{5})") & ~((F.length(nxt) <= 90) & nxt.endswith(".")) & ~X.starts_lower(nxt)
    )
    out = out.withColumns({"_div": F.coalesce(division, F.lit(False)), "_num": F.coalesce(number, F.lit(False))})
    out = out.withColumn("_takes", F.col("_div") | F.col("_num"))
    full = X.strip(line) != ""
    run = F.sum((full & ~F.col("_takes")).cast("int")).over(up().rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_run", run)
    nth = F.sum((full & F.col("_takes")).cast("int")).over(W.partitionBy("doc_key", "_run").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_takes", F.col("_takes") & (nth % 2 == 1))
    taken = F.lag("_takes").over(W.partitionBy("doc_key", "_full").orderBy("line_no"))
    out = out.withColumn("_full", full).withColumn("_gone", F.col("_up") | (F.col("_full") & F.coalesce(taken, F.lit(False))))
    raised = F.lead(F.struct("_up", "line")).over(W.partitionBy("doc_key", "_full").orderBy("line_no"))
    out = out.withColumn("_raise", F.when(F.col("_full"), raised))
    joined = (
        F.when(F.col("_gone"), "")
        .when(F.col("_raise._up"), F.concat(F.regexp_extract(line, P.HEADING_LINE, 1), F.lit(" "), F.regexp_replace(head(F.col("_raise.line")), r"\.+$", ""), F.lit(" "), head(line)))
        .when(F.col("_takes") & F.col("_div"), F.concat(F.regexp_extract(line, P.DIVISION_ALONE, 1), F.regexp_extract(line, P.DIVISION_ALONE, 2), F.lit(" "), nxt))
        .when(F.col("_takes"), F.concat(F.regexp_extract(line, P.NUMBER_ALONE, 1), F.lit(". "), nxt))
        .otherwise(line)
    )
    return out.withColumn("line", joined).drop("_next", "_prev", "_up", "_div", "_num", "_takes", "_run", "_full", "_gone", "_raise")


def kept_starts(found: Column) -> Column:
    """Of ``(line_no, witness)`` candidates in order, the lines where a signature block starts.

    A witness clause covers 12 lines and a field block 14; a start within 25 lines of the
    last kept one is dropped.
    """
    zero = F.struct(F.lit(-1).alias("skip"), F.lit(-1000).alias("last"), F.expr("CAST(array() AS array<int>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        open_ = x["line_no"] >= acc["skip"]
        keep = open_ & (x["line_no"] - acc["last"] > 25)
        return F.struct(
            F.when(open_, x["line_no"] + F.when(x["witness"], 12).otherwise(14)).otherwise(acc["skip"]).alias("skip"),
            F.when(keep, x["line_no"]).otherwise(acc["last"]).alias("last"),
            F.when(keep, F.concat(acc["kept"], F.array(x["line_no"]))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(found, zero, step, lambda acc: acc["kept"])


def signature_starts(lines: DataFrame) -> DataFrame:
    """``lines`` with ``is_signature``: where a signature block starts."""
    field = F.col("line").rlike(P.SIGNATURE_FIELD)
    witness = F.col("line").rlike(P.WITNESS)
    near = F.sum(field.cast("int")).over(up().rowsBetween(0, 13))
    out = lines.withColumn("_c", F.when(witness | (field & (near >= 3)), F.struct("line_no", witness.alias("witness"))))
    starts = kept_starts(F.array_sort(F.collect_list("_c").over(doc())))
    return out.withColumn("is_signature", F.when(F.col("_c").isNotNull(), F.array_contains(starts, F.col("line_no"))).otherwise(False)).drop("_c")


def with_context(lines: DataFrame) -> DataFrame:
    """``lines`` with repeat counts, captions, block boundaries and the text that follows."""
    s = X.strip(F.col("line"))
    out = lines.withColumns({"stripped": s, "folded": T.fold(F.col("line")), "caps": T.caps_title(s)})
    out = out.withColumns({"is_block": F.col("stripped") == P.BLOCK, "caps_folded": T.fold(F.col("caps"))})
    short = F.length("stripped").between(1, 70)
    out = out.withColumn("fold_count", F.sum(short.cast("int")).over(W.partitionBy("doc_key", "folded")))
    real = F.col("caps").isNotNull() & ~F.col("is_block")
    out = out.withColumn("caps_count", F.when(real, F.sum(real.cast("int")).over(W.partitionBy("doc_key", "caps_folded"))).otherwise(0))
    following = F.last(F.when(F.col("stripped") != "", F.col("stripped")), True).over(after())
    out = out.withColumns(
        {
            "is_caption": F.coalesce(following.rlike(P.MASKED_BLOCK), F.lit(False)),
            "after_block": F.coalesce(F.lag("is_block").over(up()), F.lit(False)),
            "after_break": F.coalesce(F.max(F.col("line").rlike(P.PAGE_BREAK).cast("int")).over(up().rowsBetween(-3, -1)) == 1, F.lit(False)),
            "block_no": F.sum(F.col("is_block").cast("int")).over(up().rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    weight = F.when(F.col("is_block"), 0).when(F.col("stripped").contains("MASK"), 300).otherwise(F.length("stripped"))
    same, ahead = up().rowsBetween(1, 39), up().rowsBetween(1, 59)
    out = out.withColumn("_w", weight)
    own = F.collect_list(F.struct("block_no", "_w"))
    total = lambda frame, block: F.aggregate(F.filter(own.over(frame), lambda x: x["block_no"] == block), F.lit(0), lambda a, x: a + x["_w"])
    lead = F.col("after_block") & (F.col("stripped") != "")
    out = out.withColumns({"body_here": F.when(lead, total(same, F.col("block_no"))).otherwise(0), "body_next": F.when(lead, total(ahead, F.col("block_no") + 1)).otherwise(0)})
    running = F.when(F.col("fold_count") >= P.RUNNING_REPEATS, F.col("folded"))
    return out.withColumn("furniture", F.collect_set(running).over(doc())).drop("_w")


def document_lines(masked_docs: DataFrame) -> DataFrame:
    """From ``(doc_key, masked, ...)`` to lines with all context columns."""
    return with_context(signature_starts(join_split_numbers(contents_lines(explode_lines(masked_docs)))))
