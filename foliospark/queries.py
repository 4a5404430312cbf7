"""Queries of the document-structure engine over the synthetic tables, and their SQL.

Structural queries run on Markdown composed from the star schema, whose structure is known
by construction: their SQL computes it from the base tables. Scalar operators run on texts
built from table columns in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases
from .functions import patterns as P
from .functions import text as X
from .operators import chunking, document, figures, masking, outline, polarity, safety, sections, survey, tables, titles, topics, verify
from .plans import index, reports, scorers
from .sources import documents as D

FLAGSHIP = "outline_order_md"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(name: str, source: str, key: str, value: Callable[[], Column], sql: str) -> None:
    """A query ``(key, value)`` of one column expression over a table."""
    query(f"SELECT {key}, {sql} AS value FROM {source}", name)(lambda spark, sf, v=value: table(spark, sf, source).select(key, v().alias("value")))


def built(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


# -- structure -------------------------------------------------------------------------------

_ORDER_LINES = """
WITH o AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
"""


@query(_ORDER_LINES + """
SELECT 'order__' || o_orderkey AS doc_key, 0 AS line_no, 0 AS depth, 'Order ' || o_orderkey || CASE WHEN n > 0 THEN '   [1 table]' ELSE '' END AS line FROM o
UNION ALL SELECT 'order__' || o_orderkey, 1, 0, 'Delivery' FROM o""")
def outline_order_md(spark, sf):
    return outline.outline_lines(sections.sectionise(D.order_md(spark, sf)))


@query(_ORDER_LINES + "SELECT 'order__' || o_orderkey AS doc_key, 2 AS md_headings, 2 AS fields, 0 AS clauses, 0 AS labels, 0 AS articles, 0 AS restarts, 'sparse' AS regime FROM o")
def signals(spark, sf):
    return survey.signals(D.order_md(spark, sf)).select("doc_key", "md_headings", "fields", "clauses", "labels", "articles", "restarts", "regime")


@query("SELECT regime, count(*) AS docs FROM (SELECT CASE WHEN count(*) >= 2 THEN 'clauses' ELSE 'flat' END AS regime FROM orders GROUP BY o_custkey) GROUP BY 1")
def regime(spark, sf):
    return survey.signals(D.clause_md(spark, sf)).groupBy("regime").agg(F.count(F.lit(1)).alias("docs"))


_CLAUSES = """
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (
  SELECT o_custkey, 3 * n - 3 AS "order", n || '. Order ' || o_orderkey || ' Terms' AS title, n || '' AS number, NULL AS parent FROM n
  UNION ALL SELECT o_custkey, 3 * n - 2, n || '.1 Delivery Scope', n || '.1', 3 * n - 3 FROM n
  UNION ALL SELECT o_custkey, 3 * n - 1, n || '.2 Payment Terms', n || '.2', 3 * n - 3 FROM n)
"""


@query(_CLAUSES + "SELECT 'clause__' || o_custkey AS doc_key, \"order\", title, number, parent FROM s")
def nest_numbers(spark, sf):
    return sections.sectionise(D.clause_md(spark, sf)).select("doc_key", "order", "title", "number", "parent")


@query(_CLAUSES + "SELECT 'clause__' || o_custkey AS doc_key, count(*) AS sections, count(parent) AS nested, 0 AS no_header, 0 AS tables, 0 AS figures FROM s GROUP BY 1")
def outline_stats(spark, sf):
    return outline.outline_stats(sections.sectionise(D.clause_md(spark, sf)))


@query(_CLAUSES + "SELECT 'clause__' || o_custkey AS doc_key, CAST(\"order\" AS INT) AS line_no, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN parent IS NULL THEN '' ELSE '  |_ ' END || title AS line FROM s")
def outline_tree(spark, sf):
    return outline.outline_lines(sections.sectionise(D.clause_md(spark, sf)))


@query("""
WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'label__' || s_nationkey AS doc_key, CASE WHEN n >= 6 THEN 2 ELSE n + 1 END AS sections FROM n JOIN nation ON n_nationkey = s_nationkey""")
def collapse_runs(spark, sf):
    return sections.sectionise(D.label_md(spark, sf)).groupBy("doc_key").agg(F.count(F.lit(1)).alias("sections"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(['html-heading']) AS rule FROM pages) GROUP BY 1")
def rule_html_heading(spark, sf):
    docs = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_key"), D.page_text(F.col("html")).alias("raw"))
    return sections.sectionise(docs).where("rule = 'html-heading'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -- tables and figures ----------------------------------------------------------------------

_LINES = "lineitem GROUP BY l_orderkey"


def _order_tables(spark, sf) -> DataFrame:
    docs = D.order_md(spark, sf)
    return docs.select("doc_key", F.posexplode(masking.section_tables(F.col("raw"))).alias("table_no", "body"))


@query("SELECT 'order__' || l_orderkey AS doc_key, count(*) + 2 AS n_rows, 3 AS n_cols FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def parse_html_table(spark, sf):
    return tables.table_facts(_order_tables(spark, sf)).select("doc_key", F.size("grid").alias("n_rows"), "n_cols")


@query("SELECT 'order__' || l_orderkey AS doc_key, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def table_minmax(spark, sf):
    return tables.table_facts(_order_tables(spark, sf)).select("doc_key", "least", "most")


@query("SELECT 'order__' || l_orderkey AS doc_key, round(sum(l_extendedprice), 2) AS stated, round(sum(l_extendedprice), 2) AS computed, true AS reconciles FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def table_reconcile(spark, sf):
    return tables.table_facts(_order_tables(spark, sf)).select("doc_key", F.round("stated", 2).alias("stated"), F.round("computed", 2).alias("computed"), "reconciles")


@query("SELECT 'order__' || l_orderkey AS doc_key, 'This is a pricing table: ' || (count(*) + 1) || ' rows with amounts against them.' AS purpose FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def table_purpose(spark, sf):
    return tables.table_summaries(_order_tables(spark, sf)).select("doc_key", "purpose")


@query("SELECT 'order__' || l_orderkey AS doc_key, count(*) AS items FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def table_summary(spark, sf):
    text = tables.table_summaries(_order_tables(spark, sf))
    rows = F.regexp_extract("summary", r"A table of (\d+) rows? and 3 columns", 1).cast("long") - 1
    return text.select("doc_key", rows.alias("items"))


@query("SELECT l_orderkey, sum(l_extendedprice)::DECIMAL(38, 2)::DOUBLE AS amount FROM lineitem GROUP BY 1")
def table_cells(spark, sf):
    body = built("| a | b |\n|---|---|\n| x | $", F.format_number("l_extendedprice", 2), " |")
    rows = table(spark, sf, "lineitem").select("l_orderkey", body.alias("body"))
    return tables.cells(rows, ["l_orderkey"]).where("amount IS NOT NULL").groupBy("l_orderkey").agg(F.sum(tables.exact_money(F.col("text"))).cast("double").alias("amount"))


@query(_ORDER_LINES + "SELECT 'order__' || o_orderkey AS doc_key, CASE WHEN n > 0 THEN 1 ELSE 0 END AS blocks FROM o")
def mask_tables(spark, sf):
    return masking.masked(D.order_md(spark, sf)).where(~F.col("masked").contains("<table")).select("doc_key", F.size("blocks").alias("blocks"))


@query(_ORDER_LINES + "SELECT 'order__' || o_orderkey AS doc_key, true AS same FROM o")
def unmask(spark, sf):
    docs = masking.masked(D.order_md(spark, sf))
    back = F.replace(masking.restored(F.col("masked"), F.col("blocks")), F.lit("(block) "), F.lit(""))
    return docs.select("doc_key", (back == F.col("raw")).alias("same"))


scalar("parse_money", "lineitem", "l_orderkey", lambda: tables.parse_money(built("($", F.format_number("l_extendedprice", 2), ")")), "-l_extendedprice")
scalar("money_or_dash", "part", "p_partkey", lambda: tables.money_or_dash(F.when(F.col("p_size") > 25, "$ -").otherwise(built("US$ ", F.format_number("p_retailprice", 2)))), "CASE WHEN p_size > 25 THEN 0.0 ELSE p_retailprice END")
scalar("format_money", "customer", "c_custkey", lambda: tables.format_money(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 1.0)), "CASE WHEN c_custkey % 2 = 0 THEN '$' || format('{:,}', c_custkey) ELSE '-' END")
scalar("parse_pipe_table", "part", "p_partkey", lambda: F.size(tables.parse_pipe_table(built("text\n| a | b |\n|---|:-:|\n", F.repeat(F.lit("| x | y |\n"), F.col("p_size")), "\n| other | block |"))).cast("long"), "p_size + 1")
scalar("order_date", "orders", "o_orderkey", lambda: F.array_join(F.array(*(figures.order_date(F.date_format("o_orderdate", "MMMM yyyy"))[k].cast("string") for k in ("y", "m", "d"))), "-"), "CASE WHEN year(o_orderdate) < 2000 THEN 2019 ELSE year(o_orderdate) END || '-' || month(o_orderdate) || '-0'")


@query("SELECT o_orderkey, 'schedule' AS kind, 'A schedule. Gantt of work It runs January ' || year(o_orderdate) || ' to December ' || year(o_orderdate) || '. 2 dated points in it.' AS meaning FROM orders")
def figure_schedule(spark, sf):
    year = F.date_format("o_orderdate", "yyyy")
    rows = table(spark, sf, "orders").select("o_orderkey", built("Gantt of work. From December ", year, " back to January ", year).alias("description"))
    return figures.interpret(rows).select("o_orderkey", "kind", "meaning")


@query("SELECT s_suppkey, 'signature' AS kind, 'Signed by Ann Lee on 3/4/' || (2000 + s_nationkey) || '.' AS meaning FROM supplier")
def figure_signature(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", built("DocuSigned by: Ann Lee Date 3/4/", (F.lit(2000) + F.col("s_nationkey")).cast("string")).alias("description"))
    return figures.interpret(rows).select("s_suppkey", "kind", "meaning")


@query("SELECT p_partkey, 'diagram' AS kind, 'A diagram of systems and how they are grouped. Split between Acme Managed.' AS meaning FROM part")
def figure_diagram(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", built("Network diagram of ", F.col("p_name"), " Acme Managed").alias("description"))
    return figures.interpret(rows).select("p_partkey", "kind", "meaning")


# -- titles ----------------------------------------------------------------------------------

_NAME, _UP = (lambda: F.col("p_name")), (lambda: F.upper("p_name"))
scalar("make_section", "part", "p_partkey", lambda: titles.section_id(_NAME()), "substr(sha1(p_name), 1, 8)")

for _name, (_of, _cases) in cases.SCALARS.items():
    query(cases.case_sql([want for _, want in _cases]), _name)(
        lambda spark, sf, of=_of, found=_cases: cases.case_rows(spark, sf, [text for text, _ in found]).select("p_partkey", "n", of(F.col("text")).cast("string").alias("value"))
    )

for _name, (_use, _cases) in cases.FRAMES.items():
    query(cases.case_sql([want for _, want in _cases]), _name)(
        lambda spark, sf, use=_use, found=_cases: use(cases.case_rows(spark, sf, [text for text, _ in found])).select("p_partkey", "n", "value")
    )

# -- text ------------------------------------------------------------------------------------

scalar("word_count", "documents", "doc_id", lambda: F.size(F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != "")).cast("long"), r"len(list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))")
scalar("sentences", "documents", "doc_id", lambda: F.size(chunking.sentences(F.col("text"))).cast("long"), r"len(regexp_extract_all(text, '[.!?]\s+[A-Z(]')) + 1")
scalar("token_budget", "lineitem", "l_orderkey", lambda: chunking.token_budget(F.col("l_quantity") * 20, F.col("l_quantity") * 10), "CAST(least(greatest(48, least(260, floor(l_quantity * 20 * 0.3 * 1.35))), greatest(24, floor(l_quantity * 10 * 1.35 * 0.85))) AS INT)")
scalar("norm_num", "lineitem", "l_orderkey", lambda: safety.norm_num(built("$", F.format_number("l_extendedprice", 2), "%")), "printf('%.2f', l_extendedprice)")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'faithful' WHEN p_size > 20 THEN 'abstractive-repaired' ELSE 'abstractive' END AS chosen FROM part")
def choose_route(spark, sf):
    draft = F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 20, "The seller delivers goods for $99 at the site.").otherwise("The seller delivers goods at the site.")
    rows = table(spark, sf, "part").select("p_partkey", F.lit("The seller delivers goods.").alias("faithful"), draft.alias("abstractive"), F.lit("The seller delivers goods at the site on time.").alias("section"))
    return safety.choose(rows).select("p_partkey", "chosen")


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN 0 ELSE 1 END AS findings FROM part")
def verify_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(verify.verify(built("It is ", F.col("p_size").cast("string"), "."), F.lit("It is 7."))).alias("findings"))


@query("SELECT 'order__' || l_orderkey AS doc_key, 1 AS checked, 0 AS invented FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def money_audit(spark, sf):
    docs = D.order_md(spark, sf)
    most = tables.table_facts(_order_tables(spark, sf)).select("doc_key", built("The largest is ", tables.format_money(F.col("most")), ".").alias("text"))
    return verify.money_audit(most, docs)


@query()
def chunk_parts(spark, sf):
    parts = chunking.split_parts(F.col("text"), 256)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("n", "part"))


@query()
def coverage_parts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.coverage_parts(F.col("text"), 256)).alias("n", "part"))


@query()
def section_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("text").alias("raw"))
    return index.section_index(docs).select("doc_key", "order", "title", "words", "route", "summary", "chosen", "findings", "facets")


# -- topics and scorers ----------------------------------------------------------------------

_TOPICS = [("steel_bolt", "bolts of steel", "bolt", ["parts"]), ("red_ring", "rings in red", "ring", ["parts"]), ("payment", "payment terms", "payment", ["agreements"])]


@query("SELECT p_partkey, count(*) AS candidates FROM part, (VALUES (1), (2)) v(x) GROUP BY 1")
def topic_candidates(spark, sf):
    vocabulary = spark.createDataFrame(_TOPICS, "topic string, label string, label_short string, doctypes array<string>")
    rows = table(spark, sf, "part").select("p_partkey", F.lit("parts").alias("doctype"))
    return topics.topic_candidates(rows, vocabulary).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("candidates"))


@query("SELECT p_partkey, p_name LIKE '%ring%' AS value FROM part", "grounded")
def grounded(spark, sf):
    return table(spark, sf, "part").select("p_partkey", topics.grounded(topics.topic_anchors(F.lit("rings"), F.lit("ring"), F.lit("ring")), F.col("p_name")).alias("value"))


@query("""
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS topic, prob, CAST(rank AS INT) AS rank FROM (
  SELECT l_orderkey, l_linenumber, prob, row_number() OVER (PARTITION BY l_orderkey ORDER BY prob DESC, CAST(l_linenumber AS VARCHAR)) AS rank
  FROM (SELECT l_orderkey, l_linenumber, round(max(l_discount) * 10, 3) AS prob FROM lineitem GROUP BY 1, 2) WHERE prob >= 0.55) WHERE rank <= 3""")
def topic_topk(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") * 10).alias("prob"))
    scored = rows.select("l_orderkey", F.col("l_linenumber").cast("string").alias("topic"), "prob")
    return topics.top_topics(scored, ["l_orderkey"], gate=False).select("l_orderkey", "topic", "prob", "rank")


@query("""
WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT v.label, vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS r FROM c)
SELECT label, vec_id, cosine FROM r WHERE r = 1""")
def extract_central(spark, sf):
    return scorers.central(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


# -- reports ---------------------------------------------------------------------------------


def _votes(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("refuted"))


@query("""
SELECT l_orderkey AS claim_id, count(*) FILTER (l_returnflag <> 'N') AS votes, count(*) FILTER (l_returnflag NOT IN ('N', 'R')) AS upheld,
       count(*) FILTER (l_returnflag NOT IN ('N', 'R')) >= 2 AS stands FROM lineitem GROUP BY 1""")
def majority_vote(spark, sf):
    return reports.majority_vote(_votes(spark, sf))


@query("""
SELECT claim_id, packet, row_number() OVER (PARTITION BY packet ORDER BY severity, claim_id) <= 7 AS verified FROM (
  SELECT o_orderkey AS claim_id, o_custkey AS packet, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS severity FROM orders WHERE o_orderstatus IN ('F', 'O'))""")
def severity_filter(spark, sf):
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "high").otherwise("low")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("packet"), severity.alias("severity"))
    return reports.severe_findings(rows).select("claim_id", "packet", "verified")


def _index(spark, sf) -> DataFrame:
    """A section index from orders: length from the key, route from the status."""
    words = (F.col("o_orderkey") % 80).cast("int")
    chosen = F.when(words <= 25, "extractive-short").when(F.col("o_orderstatus") == "F", "abstractive").when(F.col("o_orderstatus") == "O", "faithful").otherwise("verbatim")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_key"), F.col("o_orderkey").alias("order"), words.alias("words"), chosen.alias("chosen"), F.when(F.col("o_orderpriority") != "5-LOW", F.lit("text")).alias("summary"), F.col("o_orderpriority").alias("title"))


_INDEX = """
WITH i AS (SELECT o_custkey AS doc_key, o_orderkey AS "order", o_orderkey % 80 AS words, o_orderpriority AS title,
  CASE WHEN o_orderkey % 80 <= 25 THEN 'extractive-short' WHEN o_orderstatus = 'F' THEN 'abstractive' WHEN o_orderstatus = 'O' THEN 'faithful' ELSE 'verbatim' END AS chosen
  FROM orders), p AS (SELECT * FROM i WHERE title <> '5-LOW'),
f AS (SELECT count(*) AS total, count(*) FILTER (chosen = 'extractive-short') AS quoted_now, count(*) FILTER (chosen = 'abstractive') AS rew,
  count(*) FILTER (chosen IN ('faithful', 'verbatim')) AS hard, coalesce(max(words) FILTER (chosen = 'extractive-short'), 0) AS cur FROM p),
t AS (SELECT threshold, CASE WHEN threshold >= cur THEN quoted_now ELSE (SELECT count(*) FROM p WHERE chosen = 'extractive-short' AND words <= threshold) END AS quoted, f.*
  FROM (VALUES (0), (10), (15), (20), (25), (30), (40), (50), (60)) v(threshold), f)
"""


@query(_INDEX + """
, r AS (SELECT threshold, quoted, rew + CAST(round_even((quoted_now - quoted) * (CASE WHEN rew + hard > 0 THEN rew / (rew + hard) ELSE 1.0 END), 0) AS BIGINT) AS rewritten, total, threshold > cur AS not_inferable FROM t)
SELECT *, round_even(100.0 * rewritten / total, 1)::DOUBLE AS rate FROM r""")
def threshold_sweep(spark, sf):
    return reports.threshold_sweep(_index(spark, sf))


@query(_INDEX + "SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY \"order\") AS n, title AS section_title, 'text' AS published_summary FROM p")
def blind_packet(spark, sf):
    return reports.blind_packets(_index(spark, sf))


def _meta(spark, sf, run: int) -> DataFrame:
    """A run's document records from customers."""
    rewritten = F.col("c_nationkey") % (5 + run)
    choice = F.create_map(F.lit("abstractive"), rewritten.cast("long"), F.lit("verbatim"), F.lit(3).cast("long"), F.lit("none"), F.lit(9).cast("long"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_key"), F.col("c_mktsegment").alias("doc_type"), (F.lit(20) + F.col("c_custkey") % 7 + F.lit(run) * (F.col("c_custkey") % 3 - 1)).alias("sections"), choice.alias("summary_choice"))
    return rows.where(F.col("doc_key") % 10 != run + 7)


@query("""
WITH m AS (SELECT c_custkey AS doc_key, 20 + c_custkey % 7 AS s, c_nationkey % 5 AS r5, c_nationkey % 6 AS r6, c_custkey % 3 - 1 AS d FROM customer)
SELECT doc_key, CASE WHEN doc_key % 10 = 7 THEN 'final' WHEN doc_key % 10 = 8 THEN 'baseline' ELSE 'both' END AS side,
  CASE WHEN doc_key % 10 NOT IN (7, 8) THEN round_even(100.0 * r6 / (r6 + 3) - 100.0 * r5 / (r5 + 3), 1) END::DOUBLE AS delta,
  CASE WHEN doc_key % 10 NOT IN (7, 8) THEN d < 0 END AS shrank FROM m""")
def run_compare(spark, sf):
    return reports.run_compare(_meta(spark, sf, 0), _meta(spark, sf, 1)).select("doc_key", "side", "delta", "shrank")


@query("SELECT c_mktsegment AS doc_type, count(*) AS docs, sum(c_custkey) AS total FROM customer GROUP BY ROLLUP (c_mktsegment)")
def type_rollup(spark, sf):
    meta = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("doc_type"), F.col("c_custkey").alias("total"))
    return reports.type_rollup(meta, "total")


@query("SELECT o_orderkey AS doc_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) * 50 > 200)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key")).agg((F.count(F.lit(1)) * 50).alias("bytes"))
    return D.resume_antijoin(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_key")), done)


@query("SELECT p_partkey, p_name AS path FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%bolt%'")
def pick_docs(spark, sf):
    return D.pick_docs(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("path")), "RING| bolt")


@query("SELECT 'order__' || o_orderkey AS doc_key, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 1 ELSE 0 END AS tables, 2 AS sections FROM orders")
def doc_meta(spark, sf):
    docs = D.order_md(spark, sf)
    return reports.doc_meta(index.section_index(docs), docs).select("doc_key", F.col("tables").cast("int").alias("tables"), F.col("sections").cast("int").alias("sections"))


@query("SELECT sum(20 + c_custkey % 7) AS sections, sum(c_nationkey) AS prose, count(*) AS tables, count(*) AS pictures, sum(c_custkey) AS money_invented FROM customer")
def run_totals(spark, sf):
    meta = table(spark, sf, "customer").select((F.lit(20) + F.col("c_custkey") % 7).alias("sections"), F.col("c_nationkey").alias("prose"), F.lit(1).alias("tables"), F.lit(1).alias("pictures"), F.col("c_custkey").alias("money_invented"))
    return reports.run_totals(meta)


@query("""
SELECT o_custkey AS doc_key, count(*) FILTER (o_orderstatus = 'F') AS sections_a, count(*) FILTER (o_orderstatus <> 'F') AS sections_b,
       count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS prose_a FROM orders GROUP BY 1 HAVING sections_a > 0 AND sections_b > 0""")
def parser_compare(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_key"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("parser"), F.lit(1).alias("words"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit("s")).alias("summary"), F.array(F.lit("t")).alias("tables"), F.array().cast("array<string>").alias("figures"),
    )
    of = lambda p, f: F.col("parsers")[p][f]
    out = reports.parser_compare(rows).where(F.size("parsers") == 2)
    return out.select("doc_key", of("a", "sections").alias("sections_a"), of("b", "sections").alias("sections_b"), of("a", "prose").alias("prose_a"))


@query("SELECT o_custkey AS doc_key, string_agg(o_orderpriority || chr(10) || 'text', chr(10) || chr(10) ORDER BY o_orderkey) AS summaries_text FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def split_renders(spark, sf):
    rows = _index(spark, sf).withColumn("text", F.lit("body"))
    return reports.split_renders(rows).where("summaries_text <> ''").select("doc_key", "summaries_text")


@query("SELECT 'order__' || o_orderkey AS doc_key, CASE WHEN n > 0 THEN 1 ELSE 0 END AS source_tables, 0 AS source_pictures FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def outline_meta(spark, sf):
    docs = D.order_md(spark, sf)
    return reports.outline_meta(docs.select("doc_key"), docs)


@query("SELECT o_custkey, 'order__' || o_orderkey AS doc_key FROM orders", "doc_key")
def doc_keys(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", D.doc_key(F.lit("order"), built(F.col("o_orderkey").cast("string"), "!.md")).alias("doc_key"))


# -- rule cascade: documents of each class, and the sections they are made of ------------------

_BODY = "The parties have agreed on all of the terms that are set out in this part of it.\n\n"
#: The third article is long, so the short ones are no run of six that would be collapsed.
_ARTICLES = "".join(f"ARTICLE {n}\n{t}\n\n{_BODY * (6 if n == 'III' else 1)}" for n, t in (("I", "DEFINITIONS"), ("II", "SALE OF @U"), ("III", "PRICE"), ("IV", "TERM"), ("V", "NOTICES")))
#: Case: text with the part's name put in for @N and @U, and (title, rule, parent) of its sections.
CASES: dict[str, tuple[str, list[tuple[str, str, int | None]]]] = {
    "letter": ("Dear Customer\n\nThe @N is on its way.\n\nSincerely,\n\nThe Seller\n", [("no header", "whole-document", None)]),
    "headings": (
        '# One\n\n# Two\n\n# Three\n\n# Four\n\n# @N\n\n(a) **Scope** applies to all.\n(b) "Goods" means all of it.\n',
        [(t, "heading", None) for t in ("One", "Two", "Three", "Four", "@N")] + [("(a) Scope", "lettered", 4), ("(b) Goods", "lettered", 4)],
    ),
    "sparse": (
        "# Top\n\n# @N\n\n<a id='a1'></a>\nMarket Outlook Now\n" + _BODY + "<a id='a2'></a>\nMarket Outlook Now\n" + _BODY,
        [("Top", "heading", None), ("@N", "heading", None), ("Market Outlook Now", "block-lead", None)],
    ),
    "flat": (
        "@U TERMS\n\n" + _BODY + "**Delivery**\n\n" + _BODY + "**Price:** the price is agreed in writing by both of the parties here.\n\nReturns:\n\n" + _BODY + "2.1 Late Payment. Interest is due on all sums that are paid too late.\n",
        [("@U TERMS", "caps", None), ("Delivery", "bold-only", None), ("Price", "bold-lead", None), ("Returns", "label", None), ("2.1 Late Payment", "decimal", None)],
    ),
    "clauses": (
        _ARTICLES + "EXHIBIT A\n\n" + _BODY + "IN WITNESS WHEREOF, the parties sign.\n\nBy: A\nName: B\nTitle: C\n",
        [("ARTICLE I DEFINITIONS", "caps", None), ("ARTICLE II SALE OF @U", "caps", None), ("ARTICLE III PRICE", "caps", None), ("ARTICLE IV TERM", "caps", None), ("ARTICLE V NOTICES", "caps", None), ("EXHIBIT A", "caps", None), ("signature block", "signature", 5)],
    ),
    "html": ("<h2>@N</h2>\n\n" + _BODY + "<h3>Next <b>Part</b></h3>\n" + _BODY, [("@N", "html-heading", None), ("Next Part", "html-heading", None)]),
    "allowlist": (
        "1. Scope Of @N\n\n" + _BODY + "".join(f"{k}. {t} Of Goods\n\n{_BODY}" for k, t in ((2, "Price"), (3, "Place"), (4, "Time"), (5, "Risk"))) + "Scope Of @N is settled by what is set out here.\n\n" + _BODY,
        [("1. Scope Of @N", "clause", None), ("2. Price Of Goods", "clause", None), ("3. Place Of Goods", "clause", None), ("4. Time Of Goods", "clause", None), ("5. Risk Of Goods", "clause", None), ("Scope Of @N", "allowlist", None)],
    ),
    "runs": ("Alpha Item\nBeta Item\n@N\n" + _BODY, [("Alpha Item", "inferred", None)]),
    "caption": ("Sales Figures\n<table><tr><td>@N</td></tr></table>\n\nOther Title\n\n" + _BODY, [("[preamble - before first heading]", "preamble", None), ("Other Title", "inferred", None)]),
    "banner": (_ARTICLES + "FOR RELEASE\n\n" + _BODY, [("ARTICLE I DEFINITIONS", "caps", None), ("ARTICLE II SALE OF @U", "caps", None), ("ARTICLE III PRICE", "caps", None), ("ARTICLE IV TERM", "caps", None), ("ARTICLE V NOTICES", "caps", None)]),
    "continued": ("@U TERMS\n\n" + _BODY + "@U TERMS (CONTINUED)\n\n" + _BODY + "@U TERMS\n\n" + _BODY, [("@U TERMS", "caps", None)]),
    "unnamed": (
        "".join(f"{k}. The seller of the goods must **Duty {c}** see to all of it in good time.\n{_BODY}" for k, c in zip(range(1, 6), "ABCDE")),
        [(f"{k} Duty {c}", "clause", None) for k, c in zip(range(1, 6), "ABCDE")],
    ),
    "nested": (
        "1. Scope Of @N\n\n1.1 Delivery Duty\n" + _BODY + "2. Price\n\n2.1 Payment Duty\n" + _BODY + "2.1.1 Late Duty\n" + _BODY + "3. End Terms\n\n" + _BODY,
        [("1. Scope Of @N", "clause", None), ("1.1 Delivery Duty", "decimal", 0), ("2. Price", "clause", None), ("2.1 Payment Duty", "decimal", 2), ("2.1.1 Late Duty", "decimal", 3), ("3. End Terms", "clause", None)],
    ),
    "contents": ("Contents\n" + "".join(f"Alpha Item .... {k}\n" for k in range(8)) + "\n**@N**\n\n" + _BODY, [("Contents", "inferred", None), ("@N", "bold-only", None)]),
}


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case for every part."""
    parts = D.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", len(CASES)).select("p_partkey", F.initcap("p_name").alias("n"), F.upper("p_name").alias("u"))
    texts = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, (t, _) in CASES.items()))
    rows = parts.select("*", F.inline(texts))
    return rows.select(F.concat_ws("__", "c", F.col("p_partkey").cast("string")).alias("doc_key"), F.replace(F.replace("t", F.lit("@N"), F.col("n")), F.lit("@U"), F.col("u")).alias("raw"))


def _case_values() -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({quote(c)}, {k}, {quote(t)}, {quote(r)}, {quote(p)})" for c, (_, want) in CASES.items() for k, (t, r, p) in enumerate(want))


_CASE_SQL = f"""
WITH n AS (SELECT p_partkey, upper(p_name) AS u, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM part),
w(c, ord, title, rule, parent) AS (VALUES {_case_values()}),
s AS (SELECT c || '__' || p_partkey AS doc_key, c, ord, replace(replace(title, '@N', n), '@U', u) AS title, rule, CAST(parent AS INT) AS parent FROM n, w)
"""


@query(_CASE_SQL + 'SELECT doc_key, CAST(ord AS INT) AS "order", title, rule, parent FROM s')
def rule_cascade(spark, sf):
    return sections.sectionise(case_documents(spark, sf)).select("doc_key", "order", "title", "rule", "parent")


@query(_CASE_SQL + "SELECT rule, count(*) AS n FROM s GROUP BY 1")
def rule_counts(spark, sf):
    return sections.sectionise(case_documents(spark, sf)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(_CASE_SQL + """SELECT DISTINCT doc_key, CASE WHEN c IN ('contents', 'html', 'runs', 'caption', 'continued') THEN 'flat'
  WHEN c IN ('allowlist', 'banner', 'unnamed', 'nested') THEN 'clauses' ELSE c END AS regime FROM s""")
def regime_cases(spark, sf):
    return survey.signals(case_documents(spark, sf)).select("doc_key", "regime")


def _case_lines(spark, sf) -> DataFrame:
    return document.document_lines(case_documents(spark, sf))


@query(_CASE_SQL + "SELECT DISTINCT doc_key, 8 AS toc_lines FROM s WHERE c = 'contents'")
def toc_span(spark, sf):
    return _case_lines(spark, sf).where("in_toc").groupBy("doc_key").agg(F.count(F.lit(1)).alias("toc_lines"))


@query(_CASE_SQL + "SELECT DISTINCT doc_key, 1 AS starts FROM s WHERE c = 'clauses'")
def signature_starts(spark, sf):
    return _case_lines(spark, sf).where("is_signature").groupBy("doc_key").agg(F.count(F.lit(1)).alias("starts"))


@query(_CASE_SQL + "SELECT doc_key, title AS line FROM s WHERE c = 'clauses' AND title LIKE 'ARTICLE %'")
def join_numbers(spark, sf):
    # other cases have articles too
    return _case_lines(spark, sf).where("split_part(doc_key, '__', 1) = 'clauses' AND line LIKE 'ARTICLE %'").select("doc_key", "line")


@query(_CASE_SQL + "SELECT doc_key, title AS line FROM s WHERE rule = 'block-lead'")
def block_leads(spark, sf):
    return _case_lines(spark, sf).where("rule = 'block-lead'").select("doc_key", F.col("title").alias("line"))


@query(_CASE_SQL + "SELECT doc_key, count(*) AS lettered FROM s WHERE rule = 'lettered' AND parent = 4 GROUP BY 1")
def nest_lettered(spark, sf):
    return sections.sectionise(case_documents(spark, sf)).where("rule = 'lettered' AND parent = 4").groupBy("doc_key").agg(F.count(F.lit(1)).alias("lettered"))


@query(_CASE_SQL + "SELECT doc_key, parent FROM s WHERE rule = 'signature'")
def nest_attachments(spark, sf):
    return sections.sectionise(case_documents(spark, sf)).where("rule = 'signature'").select("doc_key", "parent")


_NESTED = "SELECT doc_key, CAST(ord AS INT) AS \"order\", CAST(CASE WHEN rule = 'clause' THEN 0 WHEN title LIKE '_._._ %' THEN 2 ELSE 1 END AS INT) AS depth, ord IN (0, 2) AS container_only FROM s WHERE c = 'nested'"


@query(_CASE_SQL + _NESTED)
def container_only(spark, sf):
    found = sections.sectionise(case_documents(spark, sf).where("doc_key LIKE 'nested%'"))
    return outline.with_paths(found.select("doc_key", "order", "parent", "container_only")).select("doc_key", "order", "depth", "container_only")


@query(_CASE_SQL + """SELECT doc_key, CAST(ord AS INT) AS line_no, CASE WHEN c = 'nested' AND rule = 'decimal' THEN repeat('  ', CASE WHEN title LIKE '_._._ %' THEN 2 ELSE 1 END) || '|_ ' ELSE '' END
  || CASE WHEN rule IN ('whole-document', 'preamble') THEN 'no header' ELSE title END || CASE WHEN rule = 'preamble' THEN '   [1 table]' ELSE '' END AS line
  FROM s WHERE c IN ('nested', 'letter', 'caption')""")
def outline_cases(spark, sf):
    found = case_documents(spark, sf).where("split_part(doc_key, '__', 1) IN ('nested', 'letter', 'caption')")
    return outline.outline_lines(sections.sectionise(found)).select("doc_key", "line_no", "line")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS n FROM customer")
def list_docs(spark, sf):
    return D.list_docs(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", "n")


@query("""SELECT c_custkey, 'n' AS by FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS n FROM customer) WHERE n = 12
UNION ALL SELECT c_custkey, 're' FROM customer WHERE regexp_matches(c_name, '(?i)1.0$')""")
def select_docs(spark, sf):
    files = table(spark, sf, "customer").select("c_custkey", "c_name")
    picked = lambda w, by: D.select_docs(files, w, "c_name").select("c_custkey", F.lit(by).alias("by"))
    return picked("12", "n").union(picked("1.0$", "re"))
