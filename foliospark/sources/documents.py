"""Document sources and sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..storage import durable


def doc_key(doc_type: Column, file: Column) -> Column:
    """Type and file stem; other characters become an underscore, 90 characters at most."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_"), 1, 90)
    return F.concat_ws("__", doc_type, F.regexp_replace(stem, "_+$", ""))


def scan_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_key, doc_type, file, path, raw, chars)`` of ``folder/*/*.md`` on any file system.

    Malformed UTF-8 is replaced. Resource forks (``._*``) are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{folder.rstrip('/')}/*/")
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("doc_type"), F.element_at(parts, -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    return drop_sidecars(out).select(doc_key(F.col("doc_type"), F.col("file")).alias("doc_key"), "doc_type", "file", "path", "raw", F.length("raw").alias("chars"))


def drop_sidecars(files: DataFrame) -> DataFrame:
    return files.where(~F.col("file").startswith("._"))


def pick_docs(files: DataFrame, pattern: str, path_col: str = "path") -> DataFrame:
    """Files whose path contains one of the ``|``-separated patterns, whatever the case.

    No pattern: all files. A pattern that matches nothing is an error.
    """
    wanted = [p.strip().lower() for p in pattern.split("|") if p.strip()]
    if not wanted:
        return files
    test = F.lit(False)
    for p in wanted:
        test = test | F.lower(path_col).contains(p)
    found = files.where(test)
    if found.isEmpty():
        raise ValueError(f"no file matches {pattern!r}")
    return found


def list_docs(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with ``n``, their place in the whole list by path, from 1.

    The list is sorted over all partitions and numbered within them; only the partitions'
    sizes are added up, so no task sees the whole list.
    """
    ordered = durable(files.orderBy(path_col).withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_s"))  # a row a partition
    within = F.row_number().over(W.partitionBy("_p").orderBy(path_col))
    return ordered.join(F.broadcast(starts), "_p").withColumn("n", (F.col("_s") + within).cast("long")).drop("_p", "_s")


def select_docs(files: DataFrame, wanted: str, path_col: str = "path") -> DataFrame:
    """Files by ``all``, by their number in :func:`list_docs`, or by a regular expression on the path."""
    if wanted == "all":
        return files
    if wanted.isdigit():
        return list_docs(files, path_col).where(F.col("n") == int(wanted)).select(*files.columns)
    return files.where(F.col(path_col).rlike(f"(?i){wanted}"))


def resume_antijoin(files: DataFrame, done: DataFrame, force: bool = False, least_bytes: int = 200) -> DataFrame:
    """Files without an output of more than ``least_bytes`` in ``done(doc_key, bytes)``."""
    return files if force else files.join(done.where(F.col("bytes") > least_bytes), "doc_key", "left_anti")


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic vocabulary from JSON: an object with ``topics`` or a bare list; rows need a topic."""
    schema = "topic string, label string, label_short string, doctypes array<string>"
    text = spark.read.text(path, wholetext=True).select("value")
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.topics"), f"array<struct<{schema.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>"), F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>"))
    return text.select(F.inline(rows)).where("topic IS NOT NULL")


def write_json(rows: DataFrame, path: str, *by: str) -> None:
    """One JSON row a document, partitioned by ``by``."""
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").json(path)


def write_text(rows: DataFrame, path: str, *by: str, text_col: str = "text") -> None:
    rows = rows.select(*by, F.col(text_col).alias("value"))
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").text(path)


def outline_file(file: Column, stats: dict[str, Column], outline: Column) -> Column:
    """A header of two lines, a rule and the outline."""
    counts = F.format_string("%d sections, %d nested, %d with no header, %d tables, %d pictures", *(stats[k] for k in ("sections", "nested", "no_header", "tables", "figures")))
    return F.concat_ws("\n", file, counts, F.repeat(F.lit("="), 78), outline)


TASK_ROWS = 10_000


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """``rows`` of a table dealt out before each becomes ``each`` rows, ``TASK_ROWS`` of them a task.

    A table of a few MB is one or two tasks by its bytes, whatever is made of its rows.
    """
    return rows.repartition(max(1, math.ceil(rows.count() * each / TASK_ROWS)), key)


# -- Markdown composed from the star schema, whose structure is known by construction ------------


def order_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order: heading, fields, and a table of its lines with a total."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    amount = lambda x: F.concat(F.lit("$"), F.format_number(x["l_extendedprice"], 2))
    row = lambda x: F.concat(F.lit("<tr><td>Part "), x["l_partkey"].cast("string"), F.lit("</td><td>"), amount(x), F.lit("</td><td>"), amount(x), F.lit("</td></tr>"))
    held = lines.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), row), "").alias("body"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"),
    )
    total = F.concat(F.lit("<tr><td>Total</td><td></td><td>$"), F.format_number(F.col("total").cast("double"), 2), F.lit("</td></tr>"))
    table = F.when(F.col("body").isNotNull(), F.concat(F.lit("\n\n<table><tr><th>Item</th><th>Price</th><th>Total</th></tr>"), "body", total, F.lit("</table>"))).otherwise("")
    text = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\n\nCustomer: C"), F.col("o_custkey").cast("string"), F.lit("\nStatus: "), "o_orderstatus", table, F.lit("\n\n# Delivery\n\nThe supplier shall deliver the parts within 30 days.\n"))
    joined = orders.join(held, orders["o_orderkey"] == held["l_orderkey"], "left")
    return joined.select(F.concat(F.lit("order__"), F.col("o_orderkey").cast("string")).alias("doc_key"), F.lit("reports").alias("doc_type"), text.alias("raw"))


def clause_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agreement for each customer: an ARTICLE line and a numbered clause with sub-clauses for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")

    def clause(order: Column, k: Column) -> Column:
        n = (k + 1).cast("string")
        return F.concat(
            n, F.lit(". Order "), order.cast("string"), F.lit(" Terms\n"), n, F.lit(".1 Delivery Scope\nThe seller may deliver at any time before the due date and will give notice.\n"),
            n, F.lit(".2 Payment Terms\nThe buyer shall pay the invoice in full when the goods have arrived at the site.\n"),
        )

    held = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return held.select(F.concat(F.lit("clause__"), F.col("o_custkey").cast("string")).alias("doc_key"), F.lit("agreements").alias("doc_type"), F.array_join(F.transform("keys", clause), "\n").alias("raw"))


def label_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each nation: a colon label and a sentence for each of its suppliers."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")
    one = F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), F.lit(" Details:\n\nThe supplier known as "), "s_name", F.lit(" agrees to the terms set out above and must keep them.\n"))
    body = supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("t")))), lambda x: x["t"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("This notice goes to every supplier of the nation.\n\n"), "body")
    return nation.join(body, nation["n_nationkey"] == body["s_nationkey"]).select(F.concat(F.lit("label__"), F.col("n_nationkey").cast("string")).alias("doc_key"), F.lit("statements").alias("doc_type"), text.alias("raw"))


def page_text(html: Column) -> Column:
    """Pages with block tags on lines of their own, as Markdown-side text."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1>", "")
    return X.strip(F.regexp_replace(F.regexp_replace(text, r"(?i)(<(?:p|h[1-6]|div|article)\b)", "\n$1"), r"(?i)(</(?:p|h[1-6]|div|article)>)", "$1\n"))
