"""Cases of scalar operators with both outcomes and every branch, asked of every part.

A case is an input and the value it must give. ``@N``, ``@L`` and ``@U`` stand for a part's
name with capitals at its words, in lower case and in capitals; two inputs are parted by
``||``. Values are compared as text, null included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import figures, masking, polarity, safety, survey, tables, titles, topics, verify
from .sources.documents import spread

Cases = list[tuple[str, str | None]]


def part(k: int) -> Callable[[Column], Column]:
    return lambda t: F.split_part(t, F.lit("||"), F.lit(k))


def two(use: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda t: use(part(1)(t), part(2)(t))


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def _tokens(found: Column) -> Column:
    return joined(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["token"])))


def _flip(candidate: Column, source: Column) -> Column:
    found = X.let(polarity.polarity_index(source), lambda i: polarity.flips(candidate, i))
    return joined(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["word"])))


def _kept(candidate: Column, source: Column) -> Column:
    return X.let(polarity.polarity_index(source), lambda i: polarity.depolarise(candidate, polarity.flips(candidate, i)))


def _repaired(summary: Column, source: Column) -> Column:
    return safety.repair(summary, safety.unsupported(summary, source))


_LONG = " ".join(["word"] * 60)
_SELL = "The seller shall deliver goods to the site."
_NOT_SELL = "The seller shall not deliver goods to the site."

#: Operator: expression, and cases.
SCALARS: dict[str, tuple[Callable[[Column], Column], Cases]] = {
    "clean_title": (titles.clean_title, [
        ("**<b>@N</b>**²", "@N"), ("@N <img src='a'>", "@N"), ("@N\n<table><tr>", "@N"), ("@N\\nTerms", "@N Terms"), ("@N data:image/png;base64,AAAA=", "@N"),
        (_LONG + " @N", " ".join(["word"] * 40) + "…"), ("__@N__", "@N"),
    ]),
    "strip_emphasis": (titles.strip_emphasis, [("**@N**:", "@N"), ("<u>@N</u>", "@N"), ("*@N*", "@N"), ("— @N.", "@N"), ("@N", "@N"), ("a **@N** b", "a @N b"), ("****", "")]),
    "looks_like_content": (titles.looks_like_content, [
        ("", "true"), ("12345 67", "true"), ("P.O. Box 12", "true"), ("12 Main Street, Springfield, IL 62704", "true"), ("555-123-4567", "true"), ("1/2/2024", "true"), ("Name: @N", "true"),
        ("SPRINGFIELD, IL 62704", "true"), ("12 MAIN STREET", "true"), ("Page 4", "true"), ("[a] [b]", "true"), ("<img src=x>", "true"), ("a Jan 5", "true"), ("@N", "false"), ("Scope of @N", "false"),
    ]),
    "lead_noise": (titles.lead_noise, [("Source @N", "true"), ("note on @L", "true"), ("Note 12 @N", "false"), ("12345", "true"), ("Keyline", "true"), ("1/2/2024", "true"), ("@N", "false")]),
    "fold": (titles.fold, [("@N (Continued)", "@L"), ("@N - cont.", "@L"), ("@U", "@L"), ("  @N ", "@L"), ("@N Continues", "@L continues")]),
    "lettered_title": (titles.lettered_title, [("(a) **@N** text", "(a) @N"), ('(iv) "@N" means it', "(iv) @N"), ("b) **@N.** x", "(b) @N"), ("(a) plain text", None), ("(a) **@L** x", None), ("@N", None)]),
    "caps_title": (titles.caps_title, [("@U", "@U"), ("**@U:**", "@U"), ("@N", None), ("NAME", None), ("TITLE", "TITLE"), ("T E R M S", "T E R M S"), ("AB", None), ("@U IS HERE AND ENDS SO.", None), ("123 456", None)]),
    "clause_inline_title": (titles.inline_title, [
        ("1. Scope Of @N: the rest", "1. Scope Of @N"), ("2.1 Payment. The buyer pays", "2.1. Payment"), ("3. the buyer pays. Now", None), ("No number: x", None), ("4. Name: x", None), ("5. @N the buyer of goods: x", None),
    ]),
    "numbered_prose": (titles.numbered_prose, [("1. The seller delivers @L.", "true"), ("1. @N", "false"), ("1. a b c d e f g h i j k l m", "true"), ("1. The seller of many goods", "true"), ("1. Sale Of Many Good Things", "false"), ("Not numbered.", "false")]),
    "looks_titled": (titles.looks_titled, [("@N", "true"), ("@N,", "false"), ("@L", "false"), ("Scope 12", "false"), ("One Two Three Four Five Six Seven Eight", "false"), ("The sale of @L", "false")]),
    "is_clause_heading": (titles.clause_heading, [("@N", "@N"), ("**Scope Of @N**", "Scope Of @N"), ("12/05 Term", None), ("5 Jan Review", None), ("lower case", None), ("A B C D E F G H I J K", None), ("Name: @N", None), ("Ab", None)]),
    "toc_class": (titles.toc_class, [
        ("", "blank"), ("see http://x", "skip"), ("# Head", "stop"), ("| a |", "stop"), ("12", "paged"), ("iv", "paged"), ("@N .... 12", "paged"), (" ".join(["w"] * 21), "stop"),
        ("@N", "plain"), ("This is a sentence of more than eight words, you see.", "stop"),
    ]),
    "canon_number": (titles.canonical_number, [("3.0.0", "3"), ("3.10", "3.10"), ("3.0.1", "3.0.1"), ("4", "4"), ("", "")]),
    "name_from_bold": (titles.name_from_bold, [("the **@N**, and", "@N"), ("**Name** of **@N**", "@N"), ("no bold", None), ("**12** x", None)]),
    "name_from_caps": (titles.name_from_caps, [("@U, the seller", "@U"), ("ACME, the seller", None), ("@N, the seller", None), ("@U the seller", None)]),
    "is_attachment": (titles.is_attachment, [
        ("Exhibit A", "true"), ("ANNEX 3", "true"), ("SCHEDULE", "true"), ("Appendix B -", "true"), ("Attachment IV", "true"), ("Addendum", "true"), ("**Rider 2**", "true"), ("Supplement 1", "true"),
        ("The Exhibit", "false"), ("@N", "false"), ("Exhibition", "false"),
    ]),
    "eff_body": (titles.effective_body, [("abc MASK00001", "313"), ("abc", "3"), ("MASK00001 MASK00002", "619"), ("", "0")]),
    "decimal_title": (titles.decimal_title, [("2.1 Late Payment. The rest", "2.1 Late Payment"), ("2.1 the seller shall", "2.1"), ("2 Late Payment", None), ("2.10.3 @N", "2.10.3 @N"), ("@N", None)]),
    "bold_lead": (lambda t: t.rlike(titles.P.BOLD_LEAD) & titles.same_marks(F.regexp_extract(t, titles.P.BOLD_LEAD, 1), F.regexp_extract(t, titles.P.BOLD_LEAD, 3)), [
        ("**@N** rest", "true"), ("**@N__ rest", "false"), ("@N rest", "false"), ("*_@N_* rest", "true"),
    ]),
    "anchor_to_block": (lambda t: F.size(F.split(masking.anchors_to_blocks(t), titles.P.BLOCK)) - 1, [("<a id='x'></a>\n@N", "1"), ("@N", "0"), ("<a id='x'></a>a<a id='y'></a>b", "2"), ("<a href='x'></a>", "0")]),
    "strip_furniture": (masking.without_furniture, [
        ("a\nDocuSign Envelope ID: 12\n@N", "a\n\n@N"), ("a\n<!-- PAGE BREAK -->\n@N", "a\n\n@N"), ("a\nPage 3 of 9\n@N", "a\n\n@N"), ("a\nPage 3\n@N", "a\n\n@N"), ("see Page 3 of @N", "see Page 3 of @N"), ("@N <::> b", "@N  b"), ("@N<:: ::>b", "@Nb"),
    ]),
    "section_prose": (masking.section_prose, [
        ("a <table><tr><td>x</td></tr></table> @N", "a @N"), ("<::pic::> @N", "@N"), ("| a | b |\n| c | d |\n@N", "@N"), ("(block) MASK00003 @N", "@N"), ("<b>@N</b>  x", "@N x"), ("a BLK b", "a b"), ("@N", "@N"),
    ]),
    "section_figures": (lambda t: joined(masking.section_figures(t)), [("<::one::> @N <::two::>", "one, two"), ("@N", ""), ("<::@N\nb::>", "@N\nb")]),
    "section_tables": (lambda t: F.size(masking.section_tables(t)), [("<table><tr><td>x</td></tr></table>", "1"), ("| a | b |\n| c | d |\n", "1"), ("| a |\n| b |\n", "0"), ("@N", "0"), ("<TABLE x='1'></TABLE>\n| a | b | c |\n|-|-|-|\n", "2")]),
    "strip_bare_number": (two(masking.without_bare_number), [("3.||3. @N", "@N"), ("3.1||(3.1) @N", "@N"), ("Terms||3. @N", "3. @N"), ("3.||4. @N", "4. @N")]),
    "clause_cover": (survey.clause_cover, [("1. One\n2. Two\n4. Four", "0.75"), ("1. One\n2. Two", "1.0"), ("@N", "0.0"), ("0 Zero", "0.0"), ("2.1 A\n2.2 B", "0.5")]),
    "parse_money_forms": (tables.parse_money, [("$1,234.50", "1234.5"), ("($5)", "-5.0"), ("US$ 7", "7.0"), ("$-3", "-3.0"), ("12", None), ("$", None), ("@N", None), ("-", None)]),
    "money_or_dash_forms": (tables.money_or_dash, [("$ -", "0.0"), ("-", "0.0"), ("$", "0.0"), ("$4", "4.0"), ("@N", None)]),
    "format_money_forms": (lambda t: tables.format_money(t.try_cast("double")), [("1234.5", "$1,234.50"), ("1000000", "$1,000,000"), ("0.004", "$0"), ("2.75", "$2.75"), ("-3.5", "$-3.50"), ("x", "-")]),
    "strip_visual": (figures.strip_visual, [("a blue box around @N", "a around @N"), ("@N", "@N"), ("@N ( ) , end:", "@N, end"), ("- @N (legible)", "@N")]),
    "order_date_forms": (lambda t: F.to_json(X.let(figures.order_date(t), lambda d: F.array(d["y"], d["m"], d["d"]))), [
        ("January 2024", "[2024,1,0]"), ("5-Mar-24", "[2024,3,5]"), ("3/4/2023", "[2023,3,4]"), ("3/4/23", "[2023,3,4]"), ("March", "[null,null,null]"), ("@N", "[null,null,null]"),
    ]),
    "signature_forms": (figures.signature_meaning, [
        ("DocuSigned by: Ann Lee", "Signed by Ann Lee."), ("Signature: legible (Ann Lee)", "Signed by Ann Lee."), ("Signature: Ann Lee (legible)", "Signed by Ann Lee."), ("/s/ Ann Lee", "Signed by Ann Lee."),
        ("Name: Ann Lee", "Signed by Ann Lee."), ("representative Ann Lee", "Signed by Ann Lee."), ("unsigned. Name: Ann Lee", "Unsigned by Ann Lee."), ("Name: Ann Lee Date 3/4/2024", "Signed by Ann Lee on 3/4/2024."),
    ]),
    "stem_legal": (polarity.stem_legal, [("responsibilities", "responsible"), ("responsibility", "responsible"), ("liability", "liable"), ("payments", "payment"), ("deliveries", "deliver"), ("paid", "paid"), ("delivers", "deliver")]),
    "neutralise": (polarity.neutralise, [("No. 5 @N", "number 5 @N"), ("Nos. (2) @N", "number (2) @N"), ("@N without limitation", "@N including"), ("without prejudice to @N", "including to @N"), ("no. @N", "no. @N"), ("without @N", "without @N")]),
    "governed": (lambda t: X.let(polarity.tokens(t), lambda w: F.try_element_at(w, X.let(polarity.negated(w), lambda n: F.try_element_at(n, F.lit(1))) + 1)), [
        ("The seller shall not deliver goods", "deliver"), ("The seller shall never ever deliver", "deliver"), ("without the consent of @N", "consent"), ("The seller shall deliver", None), ("not the a an of to in deliver", None),
    ]),
    "polarity_sets": (lambda t: X.let(polarity.polarity_index(t), lambda i: F.concat_ws("/", *(F.array_contains(i[k], "deliver").cast("string") for k in ("neg", "plain", "wide")))), [
        (_NOT_SELL, "true/false/true"), (_SELL, "false/true/false"), ("Goods not paid in full by the end of the third month of any year shall deliver", "false/true/true"),
        ("The seller shall not deliver goods unless they are paid", "true/true/true"), ("@N", "false/false/false"),
    ]),
    "evidence": (lambda t: joined(polarity.evidence(t)), [("The seller shall deliver goods", "seller, deliver, goods"), ("@N", ""), ("they will have been", "")]),
    "flips": (two(_flip), [
        ("The seller shall not deliver goods.||" + _SELL, "invented-negation:deliver"), ("The seller shall deliver goods.||" + _NOT_SELL, "dropped-negation:deliver"), (_SELL + "||" + _SELL, ""), (_NOT_SELL + "||" + _NOT_SELL, ""),
        ("The seller shall deliver goods.||The seller shall not deliver goods unless they are paid.", ""), ("The seller ships @L.||" + _SELL, ""), ("||" + _SELL, ""),
    ]),
    "depolarise": (two(_kept), [
        ("The seller shall not deliver goods. It is fine.||" + _SELL, "It is fine."), ("The seller shall deliver goods. It is fine.||" + _SELL, "The seller shall deliver goods. It is fine."), ("The seller shall deliver goods.||" + _NOT_SELL, ""),
    ]),
    "plural_forms": (lambda t: joined(safety.plural_forms(t)), [("@L parties", "@L parties, @L party, @L partie"), ("party", "party, parties, partys"), ("goods", "goods, good"), ("term", "term, terms")]),
    "norm_num_forms": (safety.norm_num, [("$1,234.50", "1234.50"), ("12%", "12"), ("7", "7")]),
    "tidy": (two(lambda a, b: safety.tidy(a, b)), [
        ("**The @L** . . allgoods arrive||all goods", "The @L all goods arrive"), ("Paid.. Now||x", "Paid. Now"), ("the goods . arrive||x", "the goods arrive"), ("goods etc. arrive||x", "goods etc. arrive"),
        ("the ABCdEF term||x", "the ABCDEF term"), ("thecourt rules||the court rules", "the court rules"), ("allgoods||allgoods all goods", "allgoods"), ("@N||x", "@N"),
    ]),
    "unsupported": (two(lambda a, b: _tokens(safety.unsupported(a, b))), [
        ("It costs $9 here.||It costs $7 here.", "figure:$9"), ("It costs $7 here.||It costs 7% here.", ""), ("It is due on 3/4/2024.||It is due later.", "figure:3, figure:4, figure:2024, date:3/4/2024"),
        ("Paid by Acme Works.||Paid in full.", "name:Acme Works"), ("Paid by the Parties.||Paid.", ""), ("Bolts are sold.||Each bolt is sold.", ""), ("||x", ""),
    ]),
    "repair": (two(_repaired), [
        ("The goods cost $9 each. They arrive on time here.||The goods cost $7 each.", "The goods cost each. They arrive on time here."), ("The goods cost $7 each.||The goods cost $7 each.", "The goods cost $7 each."),
        ("The goods come from Acme Works today.||The goods come.", None), ("It costs $9.||It is paid.", None),
    ]),
    "is_furniture": (safety.is_furniture, [("HEAD LINE.", "true"), ("the seller shall deliver all goods", "false"), ("One two Three Four Five Six", "true"), ("", "true")]),
    "titlesafe": (lambda t: F.array_join(safety.titlesafe_sentences(t), " / "), [("It ends. It starts.", "It ends. / It starts."), ("Paid by Mr. Lee. Done.", "Paid by Mr. Lee. / Done."), ("One; two", "One; / two"), ("e.g. goods", "e.g. goods"), ("", "")]),
    "verbatim": (safety.verbatim, [
        ("HEAD LINE. The seller of the @L shall deliver it on time.", "The seller of the @L shall deliver it on time."), ("HEAD LINE.", "HEAD LINE."), ("word " * 70, " ".join(["word"] * 60) + " ..."), ("", ""),
        ("The one part is here for all. The two part is here for all. The three part is here too.", "The one part is here for all. The two part is here for all."),
    ]),
    "verify_kinds": (two(lambda a, b: _tokens(verify.verify(a, b))), [
        ("It is 8.||It is 7.", "not-in-section:8"), ("The iPhone works.||The IPHONE works.", "case-changed:iPhone"), ("Clause 2.1 holds.||Clause 3.1 holds.", "not-in-section:2.1, clause-not-declared:2.1"), ("It is 7.||It is 7.", ""),
        ("The S LA holds.||The SLA holds.", "space-inserted:S LA"), ("||x", ""),
    ]),
    "facets": (lambda t: joined(verify.facets(t)), [
        ("The invoice is $5.", "PAY"), ("It expires on 3/4/2024.", "EXPIRY"), ("The Supplier and Acme Works Ltd.", "PARTY"), ("The goods may go.", "PERM"), ("It must go.", "OBLIG"), ("@L", ""),
        ("The Customer shall pay the fee within 30 days and may renew.", "PAY, EXPIRY, PARTY, PERM, OBLIG"), ("Red Green Blue Grey White Black One Two", ""),
    ]),
    "copy_test": (two(lambda a, b: verify.near_verbatim(a, b)), [
        (" ".join(map(str, range(12))) + "||x " + " ".join(map(str, range(12))) + " y", "true"), (" ".join(map(str, range(11))) + "||" + " ".join(map(str, range(11))), "false"),
        (" ".join(map(str, range(12))) + "||" + " ".join(map(str, range(1, 13))), "false"), ("@N||@N", "false"),
    ]),
    "topic_words": (lambda t: joined(topics.topic_words(t)), [("Red-hot Rings of it", "red-hot, red, hot, rings"), ("a bc", ""), ("@N", "@S")]),
    "stem_topic": (topics.stem_topic, [("Rings", "ring"), ("payments", "payment"), ("deliveries", "deliver"), ("gas", "gas"), ("measures", "measur")]),
    "topic_anchors": (lambda t: joined(topics.topic_anchors(part(1)(t), part(2)(t), part(3)(t))), [("rings in red||ring||red_ring", "ring, red"), ("the terms||term||payment", "term, payment")]),
    "grounded_forms": (two(lambda a, b: topics.grounded(topics.topic_anchors(a, a, a), b)), [("rings||a ring is sold", "true"), ("rings||a bolt is sold", "false"), ("the||the", "false")]),
    "folder_doctype": (topics.folder_doctype, [("bills", "statements"), ("contracts", "agreements"), ("legal_data", "agreements"), ("other", "agreements"), ("@L", "agreements")]),
}


def _grid(*rows: str) -> str:
    """An HTML table of rows whose cells are parted by bars; the first has header cells."""
    tag = lambda k: "th" if k == 0 else "td"
    return "<table>" + "".join("<tr>" + "".join(f"<{tag(k)}>{c}</{tag(k)}>" for c in r.split("|")) + "</tr>" for k, r in enumerate(rows)) + "</table>"


def _purpose(df: DataFrame) -> DataFrame:
    return tables.table_summaries(df, "text").withColumn("value", F.col("purpose"))


def _summary(df: DataFrame) -> DataFrame:
    return tables.table_summaries(df, "text").withColumn("value", F.col("summary"))


def _reconciled(df: DataFrame) -> DataFrame:
    return tables.table_facts(df, "text").withColumn("value", F.concat_ws("/", F.coalesce(F.col("stated").cast("string"), F.lit("-")), F.col("computed").cast("string"), F.coalesce(F.col("reconciles").cast("string"), F.lit("-"))))


def _interpreted(df: DataFrame) -> DataFrame:
    return figures.interpret(df, "text").withColumn("value", F.concat_ws(": ", "kind", "meaning"))


def _regime(df: DataFrame) -> DataFrame:
    return survey.signals(df, "text").withColumn("value", F.col("regime"))


def _counts(df: DataFrame) -> DataFrame:
    shown = ("md_headings", "clauses", "bold_only", "articles", "fields", "labels", "restarts", "salutation", "closing")
    return survey.signals(df, "text").withColumn("value", F.concat_ws(",", *(F.col(c).cast("string") for c in shown)))


def _densities(df: DataFrame) -> DataFrame:
    shown = ("clauses_per_kb", "headings_per_kb", "articles_per_kb")
    return survey.signals(df, "text").withColumn("value", F.concat_ws(",", *(F.col(c).cast("string") for c in shown)))


def _masked(df: DataFrame) -> DataFrame:
    return masking.masked(df, "text").withColumn("value", F.concat_ws(" # ", "masked", F.array_join("blocks", " & ")))


def _unmasked(df: DataFrame) -> DataFrame:
    out = masking.masked(df, "text")
    return out.withColumn("value", masking.restored(F.col("masked"), F.col("blocks")))


def _route(df: DataFrame) -> DataFrame:
    drafts = df.select("p_partkey", "n", *(part(k)(F.col("text")).alias(c) for k, c in enumerate(("faithful", "abstractive", "section"), 1)))
    return safety.choose(drafts).withColumn("value", F.concat_ws(": ", "chosen", "published"))


def _topic_counts(df: DataFrame) -> DataFrame:
    vocabulary = df.sparkSession.createDataFrame([("steel", "steel", "steel", ["parts"]), ("ring", "ring", "ring", ["parts", "bills"]), ("pay", "pay", "pay", ["agreements"])], "topic string, label string, label_short string, doctypes array<string>")
    found = topics.topic_candidates(df, vocabulary, "text")
    return found.groupBy("p_partkey", "n").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("value"))


_NINE = "".join(f"{k}. Term\n" for k in (9, 9, 9, 9, 9))
_ROWS = "The parties agree on this.\n"
#: Operators over rows: function that adds ``value``, and cases. ``@B`` stands for 35,000 characters.
FRAMES: dict[str, tuple[Callable[[DataFrame], DataFrame], Cases]] = {
    "table_purpose_branches": (_purpose, [
        (_grid("Item|Price", "@N|$5"), "This is a pricing table: 1 rows with amounts against them."),
        (_grid("Fee|FY 2023|FY 2024", "@N|$5|$6"), "This is a cost breakdown: 1 cost lines priced across 2 financial years."),
        (_grid("Activity|Supplier|Customer", "@N|X|"), "This is a split of who does what: 1 activities, ticked against the party responsible."),
        (_grid("Work|Phase 1|Phase 2", "@N|a|b"), "This is a timetable: 1 rows scheduled across 2 phases."),
        (_grid("Deliverable|Due", "@N|a", "b|c"), "This is a list of deliverables or activities: 2 of them."),
        (_grid("Report|Notes", "@N|a"), "This is an inventory: 1 reports listed, one per row."),
        (_grid("A|B", "@N|a"), None),
    ]),
    "table_summary_text": (_summary, [
        (_grid("Item|Price", "@N|$5", "Bolt|$7"), "This is a pricing table: 2 rows with amounts against them. A table of 2 rows and 2 columns. It lists: @N, Bolt. Across: Price. Amounts run from $5 to $7."),
        (_grid("A|B"), "A table of 2 columns and no data rows."), ("@N", None), ("| A | B |\n|---|---|\n| @N | x |", "A table of 1 row and 2 columns. It lists: @N. Across: B."),
        (_grid("Item|Total", "@N|$5", "Total|$9"), "This is a pricing table: 2 rows with amounts against them. A table of 2 rows and 2 columns. It lists: @N. The table states a total of $9, but its line items add up to $5 -- a difference of $4, so the table does not reconcile."),
    ]),
    "table_reconcile_outcomes": (_reconciled, [
        (_grid("Item|Total", "@N|$5", "Bolt|$7", "Total|$12"), "12.0/12.0/true"), (_grid("Item|Total", "@N|$5", "Total|$9"), "9.0/5.0/false"), (_grid("Item|Total", "@N|$1,000", "Total|$1,004"), "1004.0/1000.0/true"),
        (_grid("Item|Price", "@N|$5", "Total|$5"), "5.0/0.0/-"), (_grid("Item|Price", "@N|$5"), "-/0.0/-"), (_grid("Item|Total", "@N|$ -", "Bolt|$7", "Grand total|($7)"), "-7.0/7.0/false"),
    ]),
    "figure_kinds": (_interpreted, [
        ("", "unknown: "), ("a blue box", "unreadable: The description is too thin to interpret ('a') - this figure needs re-reading."), ("The @L is shown with all of its parts and names.", "other: The @L is shown with all of its parts and names."),
        ("Attestation. Name: Ann Lee", "signature: Signed by Ann Lee."), ("Timeline of work: from January 2024 to March 2024", "schedule: A schedule. Timeline of work It runs January 2024 to March 2024. 2 dated points in it."),
        ("Timeline. Release start: 3/4/2024", "schedule: A schedule. Timeline Dated milestones: Release 3/4/2024."), ("Landscape of Billing Desk and legend", "diagram: A diagram of systems and how they are grouped. Things named in it: Landscape, Billing Desk."),
        ("Network of parts - Front Office (blue box) - Back Office (green box)", "diagram: A diagram of systems and how they are grouped. It separates: Front Office, Back Office."),
    ]),
    "regimes": (_regime, [
        ("".join(f"{k}. Term\n" for k in range(1, 21)), "clauses"), ("ARTICLE I\nARTICLE II\nARTICLE III\nARTICLE IV\nARTICLE V\n", "clauses"), (_NINE + "@B", "deck"), ("# A\n# B\n# C\n# D\n# E\n", "headings"), ("# A\n# @N\n", "sparse"),
        ("".join(f"{k}. Term\n" for k in range(1, 6)), "clauses"), ("".join(f"**Bold Line {c}**\n" for c in "ABCDEFGH"), "clauses"), ("# A\n" + "".join(f"Field {c}: x\n" for c in "ABCDEFGHIJ"), "fields"), ("".join(f"Field {c}: x\n" for c in "ABCDEFGHIJ"), "flat"),
        ("Alpha Item:\nBeta Item:\nGamma Item:\n", "labels"), ("Dear Sir\n\nRegards,\n", "letter"), ("Dear Sir\n", "flat"), ("@N", "flat"), ("", "flat"),
    ]),
    "signal_counts": (_counts, [
        ("# A\n## B\n#no\n", "2,0,0,0,0,0,0,0,0"), ("1. One\n2.1 Two\n3 three\n", "0,2,0,0,0,0,1,0,0"), ("**Bold Line**\n__Odd Line**\n", "0,0,1,0,0,0,0,0,0"), ("ARTICLE I\nSection 2\nExhibit A\n", "0,0,0,2,0,0,0,0,0"),
        ("Field: @N\nName: x\n", "0,0,0,0,1,0,0,0,0"), ("Alpha Item:\nBeta Item: x\n", "0,0,0,0,1,1,0,0,0"), ("1. A\n1. B\n", "0,2,0,0,0,0,2,0,0"), ("Dear Ann\n\nSincerely,\n", "0,0,0,0,0,0,0,1,1"), ("@L", "0,0,0,0,0,0,0,0,0"),
    ]),
    "signal_densities": (_densities, [("1. A\n2. B\n# C\n", "2.0,1.0,0.0"), (_NINE + "@B", "0.14,0.0,0.0"), ("ARTICLE I\n# A\n@B", "0.0,0.03,0.029")]),
    "mask_kinds": (_masked, [
        ("a\n" + _grid("A|B") + "\n@N", "a\n(block) MASK00000\n@N # " + _grid("A|B")), ("a\n| b | c |\n| d | e |\n@N", "a\n(block) MASK00000\n@N # | b | c |\n| d | e |\n"), ("a <::pic::> @N", "a (block) MASK00000 @N # <::pic::>"),
        ("a\n\n\n\n@N", "a\n\n@N # "), ("@N", "@N # "), ("<::x::> " + _grid("A"), "(block) MASK00001 (block) MASK00000 # " + _grid("A") + " & <::x::>"),
    ]),
    "unmask_kinds": (_unmasked, [("a " + _grid("A|B") + " @N", "a (block) " + _grid("A|B") + " @N"), ("a <::pic::> @N", "a (block) <::pic::> @N"), ("@N", "@N"), ("<::x " + _grid("A") + " y::>", "(block) <::x (block) " + _grid("A") + " y::>")]),
    "choose_routes": (_route, [
        ("The seller delivers.||The seller shall deliver goods.||" + _SELL, "abstractive: The seller shall deliver goods."),
        ("The seller delivers.||The seller shall not deliver goods. Goods go to the site.||" + _SELL, "abstractive-depolarised: Goods go to the site."),
        ("The seller delivers.||The seller shall deliver goods for $9 there.||" + _SELL, "abstractive-repaired: The seller shall deliver goods for there."),
        ("The seller shall deliver goods.||||" + _SELL, "faithful: The seller shall deliver goods."), ("The seller shall deliver goods.||Sold by Acme Works.||" + _SELL, "faithful: The seller shall deliver goods."),
        ("The seller shall not deliver goods. Goods go to the site.||||" + _SELL, "faithful-depolarised: Goods go to the site."), ("Paid to Acme Works.||Sold by Acme Works.||" + _SELL, "verbatim: " + _SELL),
        ("The seller shall not deliver goods.||||" + _SELL, "verbatim: " + _SELL),
    ]),
    "topic_candidates_by_type": (_topic_counts, [("parts", "ring,steel"), ("bills", "ring"), ("agreements", "pay"), ("other", "pay,ring,steel")]),
}


def case_rows(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """``(p_partkey, n, text)``: every text for every part, the part's name put in."""
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey", len(texts))
    rows = parts.select("p_partkey", "p_name", F.posexplode(F.array(*map(F.lit, texts))).alias("n", "text"))
    for mark, name in (("@B", F.repeat(F.lit("word "), F.lit(7000))), ("@N", F.initcap("p_name")), ("@L", F.lower("p_name")), ("@U", F.upper("p_name"))):
        rows = rows.withColumn("text", F.replace("text", F.lit(mark), name))
    return rows.drop("p_name")


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def case_sql(values: list[str | None], name: str = "value") -> str:
    """DuckDB SQL for ``(p_partkey, n, value)``."""
    listed = ", ".join(f"({k}, {quoted(v)})" for k, v in enumerate(values))
    capitals = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    value = f"replace(replace(replace(replace(v, '@N', {capitals}), '@L', p_name), '@U', upper(p_name)), '@S', replace(p_name, ' ', ', '))"
    return f"SELECT p_partkey, CAST(n AS INT) AS n, {value} AS {name} FROM part, (VALUES {listed}) c(n, v)"
