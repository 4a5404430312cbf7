"""Window operators of lines and sections on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark import cases, queries
from foliospark.operators import document, lines, masking, outline, sections, survey
from foliospark.plans import index
from foliospark.sources.documents import spread


def joined(spark, texts):
    """Lines after split numbers are joined, by document."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key int, masked string")
    out = lines.join_split_numbers(lines.contents_lines(lines.explode_lines(docs)))
    found = {}
    for r in out.orderBy("doc_key", "line_no").collect():
        found.setdefault(r.doc_key, []).append(r.line)
    return [found[k] for k in range(len(texts))]


def test_numbers_join_their_titles(spark):
    got = joined(spark, ["1.\n\nScope of Work\nbody", "ARTICLE I\nDefinitions\nx", "# Terms\n\n## 2.1\ntext", "1.\n2.\nAlpha", "3.\nlower case", "4.\nEnds here."])
    assert got[0] == ["1. Scope of Work", "", "", "body"]
    assert got[1] == ["ARTICLE I Definitions", "", "x"]
    assert got[2] == ["# 2.1 Terms", "", "", "text"]
    assert got[3] == ["1.", "2. Alpha", ""]
    assert got[4] == ["3.", "lower case"] and got[5] == ["4.", "Ends here."]


def test_a_title_that_was_taken_takes_none(spark):
    assert joined(spark, ["1.\nARTICLE II\nDefinitions\nend"])[0] == ["1. ARTICLE II", "", "Definitions", "end"]


@pytest.mark.parametrize("paged,plain,accepted", [(8, 0, True), (7, 0, False), (8, 12, True), (8, 13, False)])
def test_contents_need_paged_entries(spark, paged, plain, accepted):
    body = "".join(f"Topic Alpha\n" for _ in range(plain)) + "".join(f"Item Beta ..... {k}\n" for k in range(paged))
    docs = spark.createDataFrame([(1, "Table of Contents\n" + body + "# Start\n")], "doc_key int, masked string")
    out = lines.contents_lines(lines.explode_lines(docs)).where("in_toc").count()
    assert out == (paged + plain if accepted else 0)


@pytest.mark.parametrize("candidates,kept", [([(0, True), (11, False), (30, False)], [0, 30]), ([(0, False), (13, False), (14, False), (20, True), (27, False), (39, True)], [0, 39]), ([], [])])
def test_signature_starts_are_greedy(spark, candidates, kept):
    frame = spark.createDataFrame([(candidates,)], "c array<struct<line_no:int, witness:boolean>>")
    assert frame.select(lines.kept_starts(F.col("c")).alias("k")).first().k == kept


SECTION = "doc_key int, `order` int, title string, rule string, text string, words int, number string, parent int, tables array<string>, figures array<string>"


def section(order, title, rule="clause", text="some text that is here", number=None, parent=None, tables=(), figures=()):
    return (1, order, title, rule, text, len(text.split()), number, parent, list(tables), list(figures))


def parents(df):
    return [r.parent for r in df.orderBy("order").collect()]


def test_numbers_nest_up_to_a_wall_and_a_distance(spark):
    numbered = [section(0, "1. A", number="1"), section(1, "1.1 B", number="1.1"), section(2, "1.1.1 C", number="1.1.1"), section(3, "EXHIBIT A"), section(4, "1.2 D", number="1.2"), section(5, "1.0", number="1.0"), section(6, "1.3 E", number="1.3")]
    out = sections.nest_numbers(spark.createDataFrame(numbered, SECTION).drop("parent"))
    assert parents(out) == [None, 0, 1, None, None, None, 5]
    far = [section(0, "1. A", number="1"), *(section(k, f"x{k}") for k in range(1, 60)), section(60, "1.1 B", number="1.1"), section(61, "1.2 C", number="1.2")]
    assert parents(sections.nest_numbers(spark.createDataFrame(far, SECTION).drop("parent")))[60:] == [0, None]


def test_lettered_items_nest_unless_under_an_attachment(spark):
    rows = [section(0, "A"), section(1, "(a) x", "lettered"), section(2, "(b) y", "lettered"), section(3, "SCHEDULE 1"), section(4, "(a) z", "lettered")]
    assert parents(sections.nest_lettered(spark.createDataFrame(rows, SECTION))) == [None, 0, 0, None, None]


def test_what_follows_an_attachment_goes_under_it(spark):
    rows = [section(0, "A"), section(1, "ANNEX B"), section(2, "C"), section(3, "D", parent=2), section(4, "EXHIBIT E"), section(5, "F")]
    assert parents(sections.nest_under_attachments(spark.createDataFrame(rows, SECTION))) == [None, None, 1, 2, None, 4]


@pytest.mark.parametrize("n,left", [(5, 7), (6, 3)])
def test_runs_of_short_entries_collapse(spark, n, left):
    rows = [section(0, "Top", "heading"), *(section(k, f"Label {chr(64 + k)}", "label") for k in range(1, n + 1)), section(n + 1, "1. End", parent=2)]
    out = sections.collapse_label_runs(spark.createDataFrame(rows, SECTION)).orderBy("order").collect()
    assert len(out) == left and [r.order for r in out] == list(range(left))
    assert out[-1].parent == (2 if n == 5 else None)
    assert ("Label F" in out[1].text) == (n == 6)


def test_captions_and_running_heads_go(spark):
    rows = [
        section(0, "1. Real"), section(1, "RUNNING HEAD", "caps", "RUNNING HEAD x"), section(2, "1.1 Child", parent=0), section(3, "RUNNING HEAD", "caps", "RUNNING HEAD x"),
        section(4, "Figure words", "inferred", figures=["f"]), section(5, "RUNNING HEAD", "caps", "RUNNING HEAD x"), section(6, "KEPT WITH TABLE", "caps", "KEPT", tables=["t"]), section(7, "Authored", "heading", "x"),
    ]
    out = sections.drop_captions(spark.createDataFrame(rows, SECTION)).orderBy("order").collect()
    assert [r.title for r in out] == ["1. Real", "1.1 Child", "KEPT WITH TABLE", "Authored"]
    assert [r.parent for r in out] == [None, 0, None, None]


def test_long_untitled_sections_take_a_name(spark):
    body = "4. **Late Fees** are due " + "on all of the sums " * 8
    rows = [section(0, "4.", text=body), section(1, sections.PREAMBLE, "preamble", "NORTH WIND LTD, the seller " + "word " * 30), section(2, "5.", text="5. **Short**")]
    assert [r.title for r in sections.name_long_untitled(spark.createDataFrame(rows, SECTION)).orderBy("order").collect()] == ["4 Late Fees", "NORTH WIND LTD", "5."]


def test_numbered_lists_fold_when_asked(spark):
    rows = [section(0, "Top", "heading"), section(1, "1. one"), section(2, "2. two"), section(3, "4. four"), section(4, "End", "heading")]
    out = sections.merge_numbered_lists(spark.createDataFrame(rows, SECTION)).orderBy("order").collect()
    assert [r.title for r in out] == ["Top", "1. one", "End"] and "four" in out[1].text


def test_containers_are_short_and_have_children(spark):
    rows = [section(0, "A", text="A"), section(1, "B", parent=0), section(2, "C", text="C")]
    assert [r.container_only for r in sections.container_only(spark.createDataFrame(rows, SECTION)).orderBy("order").collect()] == [True, False, False]


# -- one pass over a document ------------------------------------------------------------------

_ODD = ["", "", "", "  ", "# One", "# Two Terms", "## 2.1", "### 3.", "#", "# ", "#no", "1.", "2.", "1. Scope Of Work", "2. Price Of Goods", "3. the seller delivers all of it.", "1.1 Delivery Duty", "2.1 Payment. The buyer pays", "2.1.1 Late Duty", "4 Foo: bar baz", "10.2.3. **Big Term** here", "1.0 Zero",
 "ARTICLE I", "ARTICLE II", "ARTICLE III DEFINITIONS", "Section 4", "SECTION", "CHAPTER 2.", "PART A:", "DEFINITIONS", "SALE OF GOODS", "SALE OF GOODS (CONTINUED)", "Terms - cont.", "FOR IMMEDIATE RELEASE", "PRESS RELEASE:", "T E R M S", "**BOLD CAPS**", "**Bold Line**", "__Odd Line**", "**Lead Here** and text", "**Price:** is $5", "*_x y_*", "***Both Marks***:",
 "Alpha Item", "Beta Item", "Gamma Thing Here", "Alpha Item:", "Beta Item: x", "Name: B", "By: A", "Title: C", "Date: 1/2/2024", "IN WITNESS WHEREOF, the parties sign.", "Signature:", "Dear Ann", "Dear", "Sincerely,", "Regards", "(a) **Scope** applies", '(b) "Goods" means all', "(c) plain", "b) **Lower.** x", "EXHIBIT A", "Schedule 3 - Fees", "ANNEX", "Appendix B: Rates",
 "<h2>Head</h2>", "<H3>Next <b>Part</b></h3>", "<a id='a1'></a>", "<a id='b2'></a>Market Outlook Now", "<table><tr><td>$5</td></tr></table>", "<table>\n<tr></tr>\n</table> tail", "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |", "| a |", "<::pic of it::>", "<::fig <table><tr><td>in</td></tr></table> end::>", "<::>", "<:: ::>",
 "Contents", "Table of Contents", "Alpha Item .... 3", "Beta ..... 12", "12", "iv", "Intro...5", "https://x.example/a", "Page 4", "Page 5 of 9", "<!-- PAGE BREAK -->", "DocuSign Envelope ID: 123", "P.O. Box 12", "555-123-4567", "12345 67", "The parties have agreed on all of the terms that are set out in this part of it.", "Short body text.", "lower case line", "ends with money $5,000",
 "Running Head", "RUNNING HEAD", "KEPT WITH", "source of it", "Note 12 Here", "5 Jan Review", "12/05 Term", "1.\tTabbed Term", "  padded  ", "Café Étude", "Жизнь И То", "中文 标题", "line\rwith cr", "x\x1cy", "Title²", "MASK00001", "(block) MASK00000", "\x00BLK\x00", "BLK", "Kİ DOT", "naïve — dash:", "Scope Of Work is settled here.", "Price Of Goods and more", "Late Fees:", "This is a long line " + "of words " * 20, "A B C D E F G H I J K L", " sep", ":", ",", "**", "****", "NORTH WIND LTD, the seller of goods", "1. A", "1. B", "11. “Quoted”", '12. (x) y', "III", "IV. Roman", "2", "3) list item"]


def odd_documents(n, seed=1):
    """Texts of lines that one rule or another asks for, of every class and of any order."""
    r = random.Random(seed)
    for k in range(n):
        pool = r.sample(_ODD, r.choice([4, 8, 20, 60, len(_ODD)]))
        text = [r.choice(pool) for _ in range(r.choice([1, 2, 3, 5, 8, 15, 30, 60, 120]))]
        if r.random() < 0.3:
            text = [f"{i + 1}. {r.choice(['Scope', 'Price', 'Duty'])} Of {r.choice(['Goods', 'Work'])}" if r.random() < 0.4 else x for i, x in enumerate(text)]
        if r.random() < 0.15:
            text[:0] = ["Contents", *(f"Item {i} .... {i}" for i in range(r.randint(5, 12)))]
        if r.random() < 0.2:
            text = [x for y in text for x in (y, "")]
        if r.random() < 0.15:
            text = [x for y in text for x in ("<a id='z'></a>", y, "Some words of a body that follow on it, and they are long enough to count for it.")]
        if k % 10 == 0:
            text += ["word " * 9000] + [f"{r.randint(60, 99)}. Deck Item {i % 3}" for i in range(r.choice([5, 6, 24]))] + ["PRESS RELEASE NOW"] * r.randint(0, 9)
            r.shuffle(text)
        yield "\n".join(text) + r.choice(["", "\n", "\r\n"])


def test_one_pass_gives_the_sections_of_the_windows(spark):
    texts = list(odd_documents(300))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key int, raw string").repartition(4).persist()
    classes = {r.doc_key: r.regime for r in survey.signals(docs).select("doc_key", "regime").collect()}
    assert len(set(classes.values())) >= 6 and all(document.regime_of(t) == classes[k] for k, t in enumerate(texts))
    of = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_key"], r["order"]))
    assert of(sections.sectionise(docs)) == of(sections.sectionise_by_windows(docs))


def test_sections_are_neither_shuffled_nor_written(spark):
    docs = spark.createDataFrame([("a", "# A\n\ntext")], "doc_key string, raw string")
    plan = sections.sectionise(docs)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Window", "Sort"))


def test_malformed_text_is_replaced(spark):
    docs = spark.sql("SELECT 7 AS doc_key, CAST(unhex('2320FF410A') AS STRING) AS raw")
    assert [r.title for r in sections.sectionise(docs).collect()] == ["\ufffdA"]


def test_paths_of_a_long_document(spark):
    rows = [(1, k, k - 1 if k % 50 else None) for k in range(20000)]
    found = outline.with_paths(spark.createDataFrame(rows, "doc_key int, `order` int, parent int")).orderBy("order").collect()
    assert [r.depth for r in found] == [min(k % 50, outline.DEPTH_LIMIT) for k in range(20000)]
    assert found[60].path == list(range(50, 61))


def test_rows_are_dealt_out_before_they_are_multiplied(spark, tmp_path):
    parts = spark.range(20000).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = cases.case_rows(spark, str(tmp_path), ["@N", "@L"])
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 40000 and max(sizes) < 20000
    assert spread(parts.limit(1), "p_partkey", 2).rdd.getNumPartitions() == 1


def test_masking_in_one_pass_is_that_of_the_columns(spark):
    docs = spark.createDataFrame([*enumerate(odd_documents(120, 7)), (-1, None)], "doc_key int, raw string")
    assert sorted(masking.masked(docs).collect(), key=repr) == sorted(masking.masked_by_columns(docs).collect(), key=repr)
    assert masking.masked(docs)._jdf.queryExecution().toString().count("regexp_extract_all") == 0


def test_payloads_carry_each_expression_once(spark):
    rows = [("d", 0, ["<table><tr><td>x</td></tr></table>", ""], []), ("d", 1, [""], []), ("e", 0, [], ["blue box"])]
    found = index.payloads(spark.createDataFrame(rows, "doc_key string, `order` int, tables array<string>, figures array<string>").repartition(2))
    got = [(r.doc_key, r.order, r.table_summaries, r.figure_kinds) for r in found.orderBy("doc_key", "order").collect()]
    assert got == [("d", 0, ["A table of 1 column and no data rows."], None), ("e", 0, None, ["unreadable"])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("subtotal") < 10


def test_document_records_are_their_sql(spark):
    found = queries.doc_meta(spark, "/root/testdata/sf0.001").collect()
    items = {r.l_orderkey for r in queries.table(spark, "/root/testdata/sf0.001", "lineitem").select("l_orderkey").distinct().collect()}
    orders = [r.o_orderkey for r in queries.table(spark, "/root/testdata/sf0.001", "orders").collect()]
    assert sorted(tuple(r) for r in found) == sorted((f"order__{k}", int(k in items), 2) for k in orders)
