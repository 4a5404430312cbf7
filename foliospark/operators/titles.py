"""Functions and predicates of one line or title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

def same_marks(opening: Column, closing: Column) -> Column:
    return F.array_sort(F.split(opening, "")) == F.array_sort(F.split(closing, ""))


def clean_title(t: Column) -> Column:
    """Without embedded markup, data, footnote marks and escapes; cut at a word below the limit."""
    for pattern, by in ((P.EMBEDDED_MARKUP, ""), (P.DATA_URI, ""), (P.FOOTNOTE_MARK, ""), (r"\\n|\\t", " "), (r"<[^>]{0,400}>", " ")):
        t = F.regexp_replace(t, pattern, by)

    def cut(t: Column) -> Column:
        short = F.regexp_replace(F.substring(t, 1, P.TITLE_LIMIT), r" [^ ]*$", "")
        return F.when(F.length(t) > P.TITLE_LIMIT, F.concat(short, F.lit("…"))).otherwise(t)

    return X.let(X.strip(X.trim_of(X.one_space(t), "*_ ")), cut)


def strip_emphasis(t: Column) -> Column:
    """Without inline tags, bold marks and marks or punctuation at either end."""
    t = F.replace(F.regexp_replace(t, P.INLINE_TAG, ""), F.lit("**"), F.lit(" "))
    t = X.strip(F.regexp_replace(t, P.U + r"\s{2,}", " "))
    return X.strip(X.trim_of(X.trim_of(t, "*_ "), " .:—-"))


def mostly_digits(t: Column) -> Column:
    return X.count(t, r"(?U)\d") / F.length(t) > 0.45


def looks_like_content(t: Column) -> Column:
    """Empty, mostly digits, or an address, phone number, date, field or other noise."""
    return X.let(X.strip(t), lambda t: (t == "") | mostly_digits(t) | X.any_of(t, P.NOISE))


@X.bound
def lead_noise(t: Column) -> Column:
    return mostly_digits(t) | X.any_of(t, P.LEAD_NOISE)


def fold(t: Column) -> Column:
    """Key under which repeats of a line are the same: no "continued", lower case."""
    return F.lower(F.regexp_replace(X.strip(t), P.CONTINUED, ""))


def says_continued(t: Column) -> Column:
    return X.strip(t).rlike(P.CONTINUED)


def lettered_title(s: Column) -> Column:
    """``(a) Title`` of a lettered item that is titled in bold or defines a term; else null."""

    def of(s: Column) -> Column:
        body = F.coalesce(F.nullif(F.regexp_extract(s, P.LETTERED, 2), F.lit("")), F.regexp_extract(s, P.LETTERED, 3))
        fits = lambda t: (t != "") & (X.word_count(t) <= 9) & ~(X.starts_lower(t) & (t != F.upper(t)))
        full = lambda t: F.when(fits(t), F.concat(F.lit("("), F.regexp_extract(s, P.LETTERED, 1), F.lit(") "), t))
        return X.let(F.regexp_replace(X.strip(body), r"[.:;,]+$", ""), full)

    return F.when(s.rlike(P.LETTERED), of(s))


def caps_title(s: Column) -> Column:
    """A line in capitals as a title; null where it is none."""
    spaced = F.regexp_extract(s, P.SPACED_CAPS, 1)
    letters = F.length(F.regexp_replace(spaced, P.U + r"\s+", ""))
    bare = F.when(s.rlike(r"^\*\*.*\*\*$"), X.strip(F.regexp_replace(s, r"^\*\*|\*\*$", ""))).otherwise(s)
    plain = lambda t: (X.count(t, r"\p{L}") >= 3) & ~t.rlike(r"[\p{Ll}\p{Lt}\p{Lo}\p{Lm}]")
    keys = [k for k in P.SIGNATURE_KEYS if k != "title"]

    def checked(t: Column) -> Column:
        fits = (
            X.word_count(t).between(1, 16) & (X.count(t, r"\p{L}") >= 3) & ~((X.word_count(t) > 4) & s.rlike(P.U + r"\.\s*$"))
            & ~F.regexp_replace(F.lower(t), r":+$", "").isin(keys) & ~X.any_of(t, P.NOISE)
        )
        return F.when(fits, t)

    title = X.let(X.strip(F.regexp_replace(bare, r":+$", "")), lambda t: X.trim_of(F.when(plain(t), t).otherwise(X.first(s, P.CAPS_LINE)), " .,:"))
    # No lower-case start survives any branch, so most lines are done here.
    able = s.rlike(r"(?U)^(?:\*\*)?[^\p{Ll}]*$|^(?:\*\*)?[A-Z][A-Z0-9]")
    return F.when(s.rlike(P.SPACED_CAPS) & (letters >= 4), X.one_space(spaced)).when(able, X.let(title, checked))


def inline_title(t: Column) -> Column:
    """``n. Title`` of a numbered line whose title ends at a colon or full stop; else null."""

    def of(rest: Column) -> Column:
        need = F.when(F.regexp_extract(rest, P.INLINE_TITLE, 2) == ":", 0.5).otherwise(0.8)

        def checked(title: Column) -> Column:
            w = X.words(title)
            fits = (
                F.size(w).between(1, 10) & title.rlike(r"^\p{L}") & ~F.regexp_replace(F.lower(title), r":+$", "").isin(list(P.SIGNATURE_KEYS))
                & (F.size(F.filter(w, X.starts_upper)) / F.size(w) >= need)
            )
            return F.when(fits, F.concat(F.regexp_extract(t, P.NUMBER_PREFIX, 1), F.lit(". "), title))

        title = X.strip(F.regexp_replace(X.strip(F.regexp_extract(rest, P.INLINE_TITLE, 1)), r"\*+$", ""))
        return F.when(rest.rlike(P.INLINE_TITLE), X.let(title, checked))

    return F.when(t.rlike(P.NUMBER_PREFIX), X.let(X.strip(F.regexp_replace(t, P.NUMBER_PREFIX, "")), of))


def numbered_prose(t: Column) -> Column:
    """A numbered line that reads as a sentence rather than as a heading."""

    def of(rest: Column) -> Column:
        w = X.words(rest)
        few_capitals = F.size(F.filter(w, X.starts_upper)) <= F.floor(F.size(w) / 3)
        sentence = rest.rlike(r"[.;,]$") & ~rest.rlike(r"^[A-Z][A-Z &/'-]+$")
        return (rest != "") & (sentence | (F.size(w) > 12) | ((F.size(w) >= 5) & few_capitals))

    rest = X.strip(F.regexp_replace(X.strip(F.regexp_replace(t, P.NUMBER_PREFIX, "")), r"\*+$", ""))
    return F.when(t.rlike(P.NUMBER_PREFIX), X.let(rest, of)).otherwise(False)


@X.bound
def looks_titled(head: Column) -> Column:
    """At most seven words, mostly capitalised, not ending in a comma or number."""
    alpha = F.filter(X.words(head), lambda x: x.rlike(r"^\p{L}"))
    enough = X.let(alpha, lambda a: (F.size(a) > 0) & (F.size(F.filter(a, X.starts_upper)) / F.greatest(F.size(a), F.lit(1)) >= 0.6))
    return X.word_count(head).between(1, 7) & ~head.endswith(",") & X.starts_upper(head) & ~head.rlike(P.U + r"(^|\s)\d+\.*$") & enough


def decimal_title(s: Column) -> Column:
    """The number of a decimal paragraph, with its first sentence where that looks like a title."""
    number = F.regexp_extract(s, P.DECIMAL_LEAD, 1)
    head = X.strip(F.substring_index(strip_emphasis(F.regexp_extract(s, P.DECIMAL_LEAD, 2)), ".", 1))
    titled = X.let(head, lambda h: F.when((h != "") & looks_titled(h), F.concat(number, F.lit(" "), h)).otherwise(number))
    return F.when(s.rlike(P.DECIMAL_LEAD) & ~looks_like_content(s), titled)


def clause_heading(line: Column) -> Column:
    """A short line that may be a heading where nothing marks one; else null."""

    def checked(t: Column) -> Column:
        fits = (
            F.length(t).between(3, 80) & (X.word_count(t) <= 10) & ~(t.endswith(".") & ~t.rlike(r"^\d+\.$")) & ~t.rlike(r"^\d+[-/]")
            & ~t.rlike(P.DAY_MONTH) & t.rlike(r"(?U)^[\p{Lu}\d]") & ~looks_like_content(t)
        )
        return F.when(fits, t)

    return X.let(strip_emphasis(line), checked)


def toc_class(line: Column) -> Column:
    """``blank, skip, stop, paged`` or ``plain``: what a line is inside a list of contents."""

    def of(s: Column) -> Column:
        n = X.word_count(s)
        return (
            F.when((s == "") | (s == P.BLOCK), "blank")
            .when(s.contains("http://") | s.contains("https://"), "skip")
            .when(s.rlike(P.MASKED_BLOCK) | s.rlike(r"^(?:<|\||\(block\))") | s.rlike(P.HEADING_LINE), "stop")
            .when(s.rlike(P.TOC_PAGE), "paged")
            .when((F.length(s) > 140) | (n > 20), "stop")
            .when(s.rlike(P.TOC_ENTRY), "paged")
            .when((n > 8) & s.rlike(r"[.;,?!]$"), "stop")
            .otherwise("plain")
        )

    return X.let(X.strip(line), of)


def canonical_number(n: Column) -> Column:
    """Without trailing ``.0`` groups."""
    return F.regexp_replace(F.coalesce(n, F.lit("")), r"(\.0)+$", "")


def is_attachment(title: Column) -> Column:
    return X.strip(F.coalesce(title, F.lit(""))).rlike(P.ATTACHMENT)


def name_from_bold(body: Column) -> Column:
    """The first bold span of up to eight words near the start."""
    spans = F.transform(X.every(F.substring(body, 1, 300), P.BOLD_SPAN, 1), lambda t: X.trim_of(t, " ,.;:*"))
    good = F.filter(spans, lambda t: X.word_count(t).between(1, 8) & t.rlike(r"\p{L}") & ~F.lower(t).isin(list(P.SIGNATURE_KEYS)))
    return F.try_element_at(good, F.lit(1))


def name_from_caps(body: Column) -> Column:
    """A run of capitals at the start that ends at a comma."""
    run = X.trim_of(X.first(F.substring(body, 1, 200), P.CAPS_NAME), " ,;:")
    return X.let(run, lambda t: F.when((X.word_count(t) >= 2) & ~F.lower(t).isin(list(P.SIGNATURE_KEYS)), t))


def effective_body(text: Column) -> Column:
    """Length, with a masked block counted as 300 characters."""
    return F.length(text) + 300 * X.count(text, "MASK")


def section_id(title: Column) -> Column:
    return F.substring(F.sha1(title.cast("binary")), 1, 8)
