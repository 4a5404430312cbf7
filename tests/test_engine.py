"""Operators of the document engine on small cases of our own."""

import json
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliospark import queries as engine
from foliospark.operators import chunking, figures, masking, outline, polarity, safety, sections, tables, titles, topics, verify
from foliospark.plans import index, reports, scorers
from foliospark.sources import documents as D
from foliospark.streaming import ingest

SF = "/root/testdata/sf0.001"
SLOW = {"nest_numbers", "outline_stats", "collapse_runs", "rule_html_heading", "outline_order_md", "doc_meta", "rule_counts", "nest_lettered", "nest_attachments", "block_leads"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(spark, cases, expr, schema="a string, b string"):
    """``expr`` over rows of cases, in order."""
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, " + schema)
    return [r.v for r in frame.select("k", expr.alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize("name", sorted(set(engine.ORACLE_SQL) - SLOW))
def test_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(engine.ORACLE_SQL[name])
    got = engine.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else list(v) if isinstance(v, tuple) else v
    order = sorted(got.columns)
    a = sorted(repr([plain(v) for v in r]) for r in got.select(*order).collect())
    b = sorted(repr([plain(v) for v in r]) for r in want.select(*(f'"{c}"' for c in order)).fetchall())
    assert a == b


def test_articles_of_each_case_are_joined(spark):
    of = lambda df, n: sorted(r.line for r in df.where(F.col("doc_key") == n).collect())
    got = engine.join_numbers(spark, SF).persist()
    every = engine._case_lines(spark, SF).where("line LIKE 'ARTICLE %' AND doc_key LIKE '%!_!_7' ESCAPE '!'").persist()
    assert {r.c for r in got.select(F.split_part("doc_key", F.lit("__"), F.lit(1)).alias("c")).distinct().collect()} == {"clauses"}
    assert len(of(got, "clauses__7")) == 5 and of(got, "clauses__7") == of(every, "clauses__7") == of(every, "banner__7")


def test_entry_has_its_queries():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert engine.FLAGSHIP in found and set(sql) <= set(found)


# -- support of names and figures ------------------------------------------------------------

SECTION = "Northwind Traders and the Buyer agree on a Master-Service plan worth $72,500 by March 3. The Annual Reviews are held in Lower Falls."
SUPPORT = [
    ("The Northwind Traders signed.", False), ("However, Northwind agreed.", False), ("The Annual Review is held.", False), ("A Master Service plan is held.", False),
    ("Northwind's plan is worth $72,500.", False), ("It is held in LowerFalls.", False), ("It starts on March 3.", False),
    ("The Northwynd Traders signed.", True), ("Contoso agreed.", True), ("It is worth $72.500.", True), ("It is worth 15%.", True), ("It starts on June 9.", True),
]


@pytest.mark.parametrize("summary,flagged", SUPPORT)
def test_unsupported(spark, summary, flagged):
    assert bool(values(spark, [(summary, SECTION)], safety.unsupported(F.col("a"), F.col("b")))[0]) == flagged


POLARITY = [
    ("The buyer shall not resell the goods.", "The buyer shall not resell the goods.", False),
    ("The seller includes spare parts without limitation.", "The seller includes spare parts.", False),
    ("Clause No. 4 governs delivery.", "Clause 4 governs delivery.", False),
    ("The fee is not less than ten.", "The fee is not less than ten euros.", False),
    ("The seller shall not deliver samples.", "The seller shall deliver samples to the site.", True),
    ("The buyer shall disclose the plans.", "The buyer shall not disclose the plans to others.", True),
    ("The seller may deliver, except on Sundays.", "The seller shall not deliver on Sundays.", False),
]


@pytest.mark.parametrize("candidate,source,flagged", POLARITY)
def test_flips(spark, candidate, source, flagged):
    assert bool(values(spark, [(candidate, source)], polarity.flips(F.col("a"), polarity.polarity_index(F.col("b"))))[0]) == flagged


def test_depolarise_drops_whole_sentences(spark):
    text = "The goods arrive in spring. The seller shall not deliver samples."
    found = polarity.flips(F.col("a"), polarity.polarity_index(F.col("b")))
    assert values(spark, [(text, "The seller shall deliver samples.")], polarity.depolarise(F.col("a"), found)) == ["The goods arrive in spring."]


TIDY = [
    ("allgoods arrive", "all goods arrive"), ("It ends.. Then more", "It ends. Then more"), ("the goods. arrive late", "the goods arrive late"), ("**Bold** text", "Bold text"),
    ("The ANNuAL fee", "The ANNUAL fee"), ("It stops . Here", "It stops. Here"),
    ("Acme Ltd. agrees", "Acme Ltd. agrees"), ("agreements matter", "agreements matter"), ("see para. four", "see para. four"), ("One. Two", "One. Two"),
]


@pytest.mark.parametrize("given,want", TIDY)
def test_tidy(spark, given, want):
    section = "All goods arrive under the agreements, which matter to Acme Ltd."
    assert values(spark, [(given, section)], safety.tidy(F.col("a"), F.col("b"))) == [want]


# -- lines and titles ------------------------------------------------------------------------


def test_title_functions(spark):
    one = lambda text, expr: values(spark, [(text, "")], expr)[0]
    a = F.col("a")
    assert one("T E R M S", titles.caps_title(a)) == "T E R M S"
    assert one("PLAIN TEXT HERE", titles.caps_title(a)) == "PLAIN TEXT HERE" and one("Mixed Case", titles.caps_title(a)) is None
    assert one("SIGNATURE", titles.caps_title(a)) is None and one("TITLE", titles.caps_title(a)) == "TITLE"
    assert one("P.O. Box 12", titles.looks_like_content(a)) and not one("Scope of Work", titles.looks_like_content(a))
    assert one("3. Fees: each month", titles.inline_title(a)) == "3. Fees" and one("3. the fees. each", titles.inline_title(a)) is None
    assert one("(b) \"Goods\" means all", titles.lettered_title(a)) == "(b) Goods" and one("(b) goods are here", titles.lettered_title(a)) is None
    assert one("x" * 150 + " " + "y" * 100, titles.clean_title(a)) == "x" * 150 + "…"
    assert one("12", titles.toc_class(a)) == "paged" and one("https://x.example", titles.toc_class(a)) == "skip" and one("# A", titles.toc_class(a)) == "stop"
    assert one("1.2.0.0", titles.canonical_number(a)) == "1.2"
    assert one("Schedule 3 - Fees", titles.is_attachment(a)) and not one("Scheduled work", titles.is_attachment(a))


MARKDOWN = """Note before any heading.

# Report

Owner: Sales
| Item | Total |
|---|---|
| a | $5 |
| b | $7 |
| Total | $12 |
<::A network diagram of the Billing Managed part::>

# Second

<table><tr><th>x</th></tr><tr><td>&amp; y</td></tr></table>
"""


@pytest.fixture(scope="module")
def sectioned(spark):
    docs = [("a", MARKDOWN), ("none", None), ("empty", ""), ("crlf", "# A\r\n\r\ntext\r\n")]
    return sections.sectionise(spark.createDataFrame(docs, "doc_key string, raw string")).persist()


def test_sections_of_a_report(sectioned):
    got = {(r.doc_key, r.order): r for r in sectioned.collect()}
    assert [got["a", k].title for k in range(3)] == ["[preamble - before first heading]", "Report", "Second"]
    assert len(got["a", 1].tables) == 1 and len(got["a", 1].figures) == 1 and len(got["a", 2].tables) == 1
    assert "MASK" not in got["a", 1].text and "MASK" not in got["a", 1].full
    assert got["none", 0].rule == got["empty", 0].rule == "whole-document"
    assert got["crlf", 0].title == "A"


def test_outline_invariants(sectioned):
    lines = outline.outline_lines(sectioned)
    held = sectioned.collect()
    assert lines.count() == len(held)
    for r in held:
        assert r.parent is None or r.parent < r.order
    for key in {r.doc_key for r in held}:
        assert sorted(r.order for r in held if r.doc_key == key) == list(range(sum(r.doc_key == key for r in held)))
    text = {r.doc_key: r.outline for r in outline.outline_text(sectioned).collect()}
    assert text["a"].split("\n") == ["no header", "Report   [1 table, 1 picture]", "Second   [1 table]"]


def test_masked_blocks_come_back(spark):
    text = "a\n<::fig <table><tr><td>in</td></tr></table>::>\n| x | y |\n| 1 | 2 |\n# Next\n"
    docs = masking.masked(spark.createDataFrame([("d", text)], "doc_key string, raw string"))
    row = docs.select("masked", "blocks", masking.restored(F.col("masked"), F.col("blocks")).alias("back")).first()
    assert len(row.blocks) == 3 and "# Next" in row.masked.split("\n") and "<table>" in row.back and "MASK" not in row.back


# -- tables, figures, chunks -----------------------------------------------------------------


def test_table_that_does_not_reconcile(spark):
    body = "| Item | Jan | Total |\n|---|---|---|\n| a | $10 | $10 |\n| b | ($4) | $(4) |\n| Total | | $90 |"
    row = tables.table_summaries(spark.createDataFrame([(body,)], "body string")).first()
    assert row.reconciles is False and (row.least, row.most) == (-4.0, 10.0)
    assert "does not reconcile" in row.summary and "cost breakdown" in row.summary


def test_tables_without_rows(spark):
    frame = spark.createDataFrame([("",), ("<table></table>",), ("| a | b |",), (None,)], "body string")
    assert [r.summary for r in tables.table_summaries(frame.fillna("")).collect()][2] == "A table of 2 columns and no data rows."


@pytest.mark.parametrize("text,kind", [("", "unknown"), ("blue box", "unreadable"), ("DocuSigned by: unsigned", "signature"), ("Project timeline from Jan 2024", "schedule"), ("A photograph of a long bridge over water", "other")])
def test_figure_kinds(spark, text, kind):
    assert figures.interpret(spark.createDataFrame([(text,)], "description string")).first().kind == kind


def test_chunks_cover_the_text(spark):
    text = " ".join(f"Sentence number {k} says something about the goods that were sold." for k in range(40))
    items = " ".join(f"({c}) Item {c} has a rather long list of words that go on." for c in "abcdefgh")
    for t in (text, items, "Short text.", "no stop " * 100):
        for parts in values(spark, [(t, "")], F.array(chunking.split_parts(F.col("a"), 60), chunking.coverage_parts(F.col("a"), 60))):
            for p in parts:
                assert " ".join(" ".join(p).split()) == " ".join(t.split())
    whole = values(spark, [(text, "")], chunking.split_parts(F.col("a"), 60))[0]
    assert all(len(p.split()) <= 60 for p in whole)


# -- drafts, verification, topics ------------------------------------------------------------


def test_choose_routes(spark):
    section = "The seller shall deliver goods to the site by the third week of each quarter without delay."
    drafts = [
        ("The seller shall deliver goods.", "Goods are delivered by the seller to the site.", section), ("The seller shall deliver goods.", "The seller gets $99 for goods that it delivers to the site.", section),
        ("The seller shall deliver goods.", "Contoso delivers.", section), ("Contoso delivers.", "Fabrikam delivers.", section), ("The seller shall deliver goods.", None, section), (None, None, None),
    ]
    frame = spark.createDataFrame([(k, *d) for k, d in enumerate(drafts)], "k int, faithful string, abstractive string, section string")
    assert [r.chosen for r in safety.choose(frame).orderBy("k").collect()] == ["abstractive", "abstractive-repaired", "faithful", "verbatim", "faithful", "verbatim"]


def test_verbatim_is_bounded(spark):
    long = "The seller of goods shall deliver " + "very " * 90 + "many goods on time."
    got = values(spark, [(long, ""), ("", ""), ("HEADING ONLY", "")], safety.verbatim(F.col("a")))
    assert len(got[0].split()) == 61 and got[0].endswith(" ...") and got[1:] == ["", "HEADING ONLY"]


def test_verify_findings(spark):
    got = values(spark, [("The openAI P C plan of 4.2 costs $9.", "The OpenAI PC plan of 4.1 costs $8.")], verify.verify(F.col("a"), F.col("b")))[0]
    assert {(f.kind, f.token) for f in got} >= {("case-changed", "openAI"), ("space-inserted", "P C"), ("clause-not-declared", "4.2"), ("not-in-section", "$9.")}


def test_copying_is_a_run_of_twelve_words(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen"
    assert values(spark, [(words, "zero " + words), (words[:40], words), ("", "")], verify.near_verbatim(F.col("a"), F.col("b"))) == [True, False, False]


def test_topics_are_gated_and_ranked(spark):
    vocabulary = spark.createDataFrame([("delivery", "delivery of goods", None, ["agreements"]), ("tax", "taxes", None, ["agreements"]), ("bills", "bills", None, ["statements"])], "topic string, label string, label_short string, doctypes array<string>")
    docs = spark.createDataFrame([("a", 0, "Delivery", "agreements", "The goods are delivered."), ("b", 0, "x", "unknown", "bills")], "doc_key string, order int, title string, doctype string, full string")
    got = {r.doc_key: [t.topic for t in r.topics] for r in index.label_topics(docs, vocabulary, index.Options(topic_least=0.15)).collect()}
    assert got == {"a": ["delivery"], "b": ["bills"]}


def test_scorers_plug_in(spark):
    frame = spark.createDataFrame([("a b",), (None,)], "text string")

    def load():
        return lambda batch: batch.fillna("").str.upper()

    assert sorted(r.draft for r in scorers.with_drafts(frame, load).collect()) == ["", "A B"]


# -- sources, reports, streams ---------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    for name, text in (("bills/one.md", b"# One\n\ntext \xff here\n"), ("bills/._one.md", b"x"), ("legal/a b!.md", b"# Two\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    return str(tmp_path)


def test_scan_picks_and_numbers(spark, folder):
    docs = D.scan_docs(spark, folder)
    assert {r.doc_key for r in docs.collect()} == {"bills__one", "legal__a_b"}
    assert "�" in docs.where("doc_type = 'bills'").first().raw
    assert [r.doc_key for r in D.pick_docs(docs, "ONE|zzz").collect()] == ["bills__one"]
    with pytest.raises(ValueError):
        D.pick_docs(docs, "zzz")
    listed = {r.n: r.path for r in D.list_docs(docs).collect()}
    assert sorted(listed) == list(range(1, len(listed) + 1)) and [listed[k] for k in sorted(listed)] == sorted(listed.values())
    assert D.select_docs(docs, "all").count() == len(listed)
    assert [r.path for r in D.select_docs(docs, "2").collect()] == [listed[2]]
    assert [r.doc_key for r in D.select_docs(docs, "/O.E").collect()] == ["bills__one"]


@pytest.mark.parametrize("wrap", [True, False])
def test_topic_files(spark, tmp_path, wrap):
    recs = [{"topic": "t", "label": "l", "doctypes": ["x"]}, {"label": "none"}]
    (tmp_path / "t.json").write_text(json.dumps({"topics": recs} if wrap else recs))
    assert rows(D.load_topics(spark, str(tmp_path / "t.json"))) == [("t", "l", None, ["x"])]


def test_stream_writes_sections_once(spark, folder, tmp_path_factory):
    target, mark = (str(tmp_path_factory.mktemp(n)) for n in ("out", "mark"))
    simple = lambda batch: batch.select("doc_key", "doc_type", F.length("raw").alias("n"))
    for _ in range(2):
        ingest.write_sections(ingest.read_stream(spark, folder), target, mark, simple).awaitTermination()
    assert sorted(r.doc_key for r in spark.read.parquet(f"{target}/batch=*").collect()) == ["bills__one", "legal__a_b"]


def test_votes_and_grouping(spark):
    votes = spark.createDataFrame([(1, False), (1, False), (1, True), (2, False), (2, None), (2, True)], "claim_id int, refuted boolean")
    assert rows(reports.majority_vote(votes)) == [(1, 3, 2, True), (2, 2, 1, False)]
    outlines = spark.createDataFrame([("bills", "b.md", "B"), ("bills", "a.md", "A")], "doc_type string, file string, text string")
    assert reports.grouped_outlines(outlines).first().text.split("\n")[-3:] == ["A", "", "B"]
    order = spark.createDataFrame([("zeta",), ("bills",), ("reports",), ("alpha",)], "t string").orderBy(reports.type_order(F.col("t")))
    assert [r.t for r in order.collect()] == ["reports", "bills", "alpha", "zeta"]


def test_stems_differ_by_use(spark):
    assert values(spark, [("responsibility", "")], polarity.stem_legal(F.col("a"))) == ["responsible"]
