"""Tables: grids, amounts, purpose, summary and reconciliation.

A grid is an array of rows of cells; all of it stays inside the row, in higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _cell(body: Column) -> Column:
    body = F.regexp_replace(body, r"<[^>]*>", "")
    for name, character in _ENTITIES:
        body = F.replace(body, F.lit(name), F.lit(character))
    return X.one_space(body)


def parse_html_table(html: Column) -> Column:
    """Rows of cells in single spaces, common entities decoded; rows of empty cells go."""
    rows = X.every(html, P.USI + r"<tr\b[^>]*>(.*?)</tr\s*>", 1)
    grid = F.transform(rows, lambda r: F.transform(X.every(r, P.USI + r"<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", 1), _cell))
    return F.filter(grid, lambda r: F.exists(r, lambda c: c != ""))


def parse_pipe_table(text: Column) -> Column:
    """The first block of pipe rows, rulers left out."""
    lines = F.split(text, "\n")
    flagged = F.transform(lines, lambda x: x.rlike(P.PIPE_ROW))
    first = F.array_position(flagged, True)
    rest = F.slice(lines, F.greatest(first.cast("int"), F.lit(1)), F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(P.PIPE_ROW)), False)
    block = F.when(first == 0, F.slice(lines, 1, 0)).when(stop == 0, rest).otherwise(F.slice(rest, 1, F.greatest(stop.cast("int") - 1, F.lit(0))))
    inner = F.filter(F.transform(block, lambda x: F.regexp_extract(x, P.PIPE_ROW, 1)), lambda x: ~x.rlike(P.RULER_ROW))
    return F.transform(inner, lambda x: F.transform(F.split(x, r"\|", -1), X.strip))


def parse_table(body: Column) -> Column:
    piped = ~F.lower(body).contains("<table") & body.contains("|")
    return F.when(piped, parse_pipe_table(body)).otherwise(parse_html_table(body))


def parse_money(cell: Column) -> Column:
    """An amount with its own dollar mark, negative in parentheses; else null."""

    def of(c: Column) -> Column:
        v = F.regexp_replace(F.regexp_extract(c, P.AMOUNT, 1), ",", "").try_cast("double")
        return F.when(c.rlike(P.AMOUNT), F.when(c.startswith("("), -v).otherwise(v))

    return X.let(X.strip(F.coalesce(cell, F.lit(""))), of)


def money_or_dash(cell: Column) -> Column:
    bare = F.replace(X.strip(F.coalesce(cell, F.lit(""))), F.lit(" "), F.lit(""))
    return F.when(bare.isin("$-", "$", "-"), F.lit(0.0)).otherwise(parse_money(cell))


def exact_money(cell: Column) -> Column:
    """The amount as a decimal, for exact reporting."""
    v = F.regexp_replace(F.regexp_extract(X.strip(cell), P.AMOUNT, 1), ",", "").try_cast("decimal(38,2)")
    return F.when(X.strip(cell).startswith("("), -v).otherwise(v)


def format_money(v: Column) -> Column:
    """No decimals within half a cent of a whole number, else two; null is a dash."""
    whole = F.abs(v - F.bround(v)) < 0.005
    return F.when(v.isNull(), "-").otherwise(F.concat(F.lit("$"), F.when(whole, F.format_number(v, 0)).otherwise(F.format_number(v, 2))))


def table_facts(tables: DataFrame, body_col: str = "body", caption_col: str | None = None) -> DataFrame:
    """``tables`` with grid, header, item and total rows, amounts and sums of each table."""
    caption = F.coalesce(F.col(caption_col), F.lit("")) if caption_col else F.lit("")
    label = lambda r: X.strip(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit("")))
    out = tables.withColumns({"caption": X.strip(caption), "grid": parse_table(F.col(body_col))})
    first = F.try_element_at(F.col("grid"), F.lit(1))
    out = out.withColumn("headerless", F.coalesce(label(first).rlike(r"^\d+$"), F.lit(False)))
    headed = ~F.col("headerless") & F.exists(first, lambda c: c != "")
    out = out.withColumn("header", F.when(headed, first).otherwise(F.expr("CAST(array() AS array<string>)")))
    out = out.withColumn("rows", F.when(F.size("header") > 0, F.slice("grid", 2, F.size("grid"))).otherwise(F.col("grid")))
    out = out.withColumns(
        {
            "n_cols": F.array_max(F.transform("grid", lambda r: F.size(r))),
            "items": F.filter("rows", lambda r: ~label(r).rlike(P.TOTAL_LABEL)),
            "totals": F.filter("rows", lambda r: label(r).rlike(P.TOTAL_LABEL)),
            "total_cols": F.filter(F.transform("header", lambda h, j: F.when(h.rlike(P.TOTAL_LABEL), j)), lambda j: j.isNotNull()),
        }
    )
    line_amounts = F.flatten(F.transform("items", lambda r: F.transform(r, lambda c, j: F.when((j > 0) & ~F.array_contains("total_cols", j), parse_money(c)))))
    at = lambda r, j: F.try_element_at(r, j + 1)
    ends = F.when(F.size("total_cols") > 0, F.col("total_cols")).otherwise(F.expr("CAST(null AS array<int>)"))
    stated = F.flatten(F.transform("totals", lambda r: F.transform(F.coalesce(ends, F.array(F.size(r) - 1)), lambda j: parse_money(at(r, j)))))
    sums = F.flatten(F.transform("items", lambda r: F.transform("total_cols", lambda j: money_or_dash(at(r, j)))))
    out = out.withColumns(
        {
            "amounts": F.array_compact(line_amounts),
            "stated": F.try_element_at(F.filter(stated, lambda v: v.isNotNull() & (v != 0)), F.lit(-1)),
            "computed": F.aggregate(F.array_compact(sums), F.lit(0.0), lambda a, v: a + v),
        }
    )
    within = F.abs(F.col("computed") - F.col("stated")) < F.greatest(F.lit(2.0), 0.005 * F.abs("stated"))
    return out.withColumns(
        {
            "least": F.array_min("amounts"),
            "most": F.array_max("amounts"),
            "reconciles": F.when(F.col("stated").isNotNull() & (F.col("computed") != 0), within),
        }
    )


def table_purpose(parties: tuple[str, ...] = ()) -> Column:
    """What a table of :func:`table_facts` is for, in a sentence; null where nothing tells.

    ``parties`` are names that mark a column as a party's, beside the common words.
    """
    named = "|".join([P.ROLE_HEADER, *(P.UI + rf"\b\Q{p}\E\b" for p in parties)])
    head = F.concat_ws(" ", F.filter("header", lambda c: c != ""))
    later = F.filter(F.slice(F.filter("header", lambda c: c != ""), 2, F.greatest(F.size("header"), F.lit(1))), lambda c: c.rlike(P.PERIOD))
    rows = F.size("rows")
    labels = F.size(F.filter("rows", lambda r: X.strip(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(""))) != ""))
    cells = F.flatten(F.transform("rows", lambda r: F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))))
    money = head.rlike(P.MONEY_HEADER) | F.exists(cells, lambda c: parse_money(c).isNotNull())
    ticks = F.exists(F.flatten("rows"), lambda c: F.upper(X.strip(c)).isin("X", "✓", "YES"))
    unit = F.when(head.contains("FY"), "financial year").when(head.rlike(r"\bQ[1-4]\b"), "quarter").when(head.rlike("(?i)month|Jan|Feb|Mar"), "month").otherwise("period")
    step = F.when(head.rlike("(?i)wave"), "wave").when(head.rlike("(?i)phase"), "phase").otherwise("period")
    thing = F.lower(F.regexp_extract(head, P.INVENTORY_HEADER, 1))
    return (
        F.when(money & (F.size(later) > 0), F.format_string("This is a cost breakdown: %d cost lines priced across %d %ss.", labels, F.size(later), unit))
        .when(money, F.format_string("This is a pricing table: %d rows with amounts against them.", rows))
        .when(head.rlike(named) & ticks, F.format_string("This is a split of who does what: %d activities, ticked against the party responsible.", rows))
        .when(F.size(later) >= 2, F.format_string("This is a timetable: %d rows scheduled across %d %ss.", rows, F.size(later), step))
        .when(head.rlike(P.DELIVERABLE_HEADER), F.format_string("This is a list of deliverables or activities: %d of them.", rows))
        .when(head.rlike(P.INVENTORY_HEADER), F.format_string("This is an inventory: %d %ss listed, one per row.", rows, thing))
        .when(F.col("caption") != "", F.concat(F.lit("This table covers "), F.substring("caption", 1, 80), F.lit(".")))
    )


def table_summaries(tables: DataFrame, body_col: str = "body", caption_col: str | None = None) -> DataFrame:
    """:func:`table_facts` with ``purpose`` and ``summary``; a table without rows has none."""
    out = table_facts(tables, body_col, caption_col).withColumn("purpose", table_purpose())
    label = lambda r: X.strip(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit("")))
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    out = out.withColumns(
        {
            "_names": F.filter(F.transform("items", label), lambda n: n != ""),
            "_cols": F.filter(F.transform("header", lambda h, j: F.when((j > 0) & (h != "") & ~F.array_contains("total_cols", j), h)), lambda h: h.isNotNull()),
        }
    )
    rows, more = F.size("rows"), F.size("_names") - 8
    last = label(F.try_element_at(F.col("rows"), F.lit(-1)))
    shown = F.array_join(F.transform(F.slice("_names", 1, 8), lambda n: F.substring(n, 1, 40)), ", ")
    money = lambda c: format_money(F.col(c))
    parts = F.array_compact(
        F.array(
            F.when(F.col("headerless"), F.format_string("A continuation of the table before it: the same columns, %d more rows (%s to %s).", rows, label(F.try_element_at(F.col("grid"), F.lit(1))), F.coalesce(F.nullif(last, F.lit("")), F.lit("?")))),
            F.col("purpose"),
            F.concat(F.lit("A table of "), many(rows, "row"), F.lit(" and "), many(F.col("n_cols"), "column"), F.when(F.col("caption") != "", F.concat(F.lit(" -- "), F.substring("caption", 1, 90))).otherwise(""), F.lit(".")),
            F.when(F.size("_names") > 0, F.concat(F.lit("It lists: "), shown, F.lit("."), F.when(more > 0, F.format_string(" (and %d more)", more)).otherwise(""))),
            F.when(F.size("_cols") > 0, F.concat(F.lit("Across: "), F.array_join(F.transform(F.slice("_cols", 1, 9), lambda c: F.substring(c, 1, 26)), ", "), F.lit("."))),
            F.when(F.size("amounts") > 0, F.concat(F.lit("Amounts run from "), money("least"), F.lit(" to "), money("most"), F.lit("."))),
            F.when(F.col("reconciles"), F.concat(F.lit("The table states a total of "), money("stated"), F.lit(", and the line items add up to that.")))
            .when(~F.col("reconciles"), F.concat(F.lit("The table states a total of "), money("stated"), F.lit(", but its line items add up to "), money("computed"), F.lit(" -- a difference of "), format_money(F.abs(F.col("stated") - F.col("computed"))), F.lit(", so the table does not reconcile.")))
            .when(F.col("stated").isNotNull(), F.concat(F.lit("The table states a total of "), money("stated"), F.lit("."))),
        )
    )
    text = F.when(F.size("grid") == 0, None).when(rows == 0, F.concat(F.lit("A table of "), many(F.col("n_cols"), "column"), F.lit(" and no data rows."))).otherwise(F.array_join(parts, " "))
    return out.withColumn("summary", text).drop("_names", "_cols")


def cells(tables: DataFrame, keys: list[str], body_col: str = "body") -> DataFrame:
    """``(keys, r, c, text, amount)``: one row a cell."""
    rows = tables.select(*keys, F.posexplode(parse_table(F.col(body_col))).alias("r", "row"))
    return rows.select(*keys, "r", F.posexplode("row").alias("c", "text")).withColumn("amount", parse_money(F.col("text")))
