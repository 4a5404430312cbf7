"""Drafts made safe: tidied, checked against their section, repaired or replaced by a quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import polarity


def plural_forms(t: Column) -> Column:
    """The phrase and its forms with the last word's ending changed: ies/y, with and without s."""

    def of(w: Column) -> Column:
        head = F.substring(t, F.lit(1), F.length(t) - F.length(w))
        cut = lambda n, by="": F.concat(head, F.substring(w, F.lit(1), F.length(w) - n), F.lit(by))
        return F.array_compact(
            F.array(
                t,
                F.when(w.endswith("ies") & (F.length(w) > 4), cut(3, "y")),
                F.when(w.endswith("y") & (F.length(w) > 2), cut(1, "ies")),
                F.when(w.endswith("s") & (F.length(w) > 3), cut(1)).otherwise(F.concat(t, F.lit("s"))),
            )
        )

    return X.let(F.substring_index(t, " ", -1), of)


def norm_num(t: Column) -> Column:
    return F.regexp_replace(F.translate(t, "$,", ""), "%+$", "")


def tidy(text: Column, section: Column | None = None) -> Column:
    """Slips of a generator mended: marks, doubled stops, stray stops, capitals, glued words."""
    text = F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    slip = P.U + r"\b([A-Z]{2,})([a-z])([A-Z]{2,})\b"
    raised = lambda w: F.when(w.rlike(slip), F.concat(F.regexp_extract(w, slip, 1), F.upper(F.regexp_extract(w, slip, 2)), F.regexp_extract(w, slip, 3))).otherwise(w)
    text = X.let(text, lambda t: F.when(t.rlike(slip), _by_word(t, raised)).otherwise(t))
    for pattern, by in ((r"\.\s+\.", "."), (r"\.{2,}", "."), (r"\s+([.,;:])", "$1")):
        text = F.regexp_replace(text, P.U + pattern, by)
    short = "|".join(P.ABBREVIATIONS)
    # A stop between lower-case words goes, unless the word before it is an abbreviation.
    text = F.regexp_replace(text, P.U + rf"(?<=[a-z])(?<!(?i:(?<![A-Za-z])(?:{short})))\.\s+(?=[a-z])", " ")
    text = X.strip(F.regexp_replace(text, P.U + r"\s{2,}", " "))
    if section is None:
        return text

    def unglued(vocab: Column) -> Column:
        def split(w: Column) -> Column:
            heads = F.filter(F.array(*(F.lit(h) for h in sorted(P.GLUED_HEADS, key=len))), lambda h: F.lower(w).startswith(h) & (F.length(h) < F.length(w) - 2) & F.array_contains(vocab, F.substring(F.lower(w), F.length(h) + 1, F.length(w))))
            cut = lambda h: F.concat(F.substring(w, F.lit(1), F.length(h)), F.lit(" "), F.substring(w, F.length(h) + 1, F.length(w)))
            return F.when(~w.rlike(r"^[A-Za-z]{5,}$") | F.array_contains(vocab, F.lower(w)), w).otherwise(X.let(F.try_element_at(heads, F.lit(1)), lambda h: F.when(h.isNotNull(), cut(h)).otherwise(w)))

        return _by_word(text, split)

    return X.let(F.array_distinct(X.every(F.lower(F.coalesce(section, F.lit(""))), r"[A-Za-z]+")), unglued)


def _by_word(text: Column, change) -> Column:
    """``change`` applied to each word, everything between words as it is."""
    pieces = X.every(text, P.U + r"\w+|\W+")
    return F.array_join(F.transform(pieces, change), "")


def unsupported(summary: Column, section: Column) -> Column:
    """``(kind, token)`` of figures, dates and names that the section does not have."""
    src = F.regexp_replace(F.coalesce(section, F.lit("")), P.U + r"\s+", " ")
    tag = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"))
    summary = F.coalesce(summary, F.lit(""))

    def of(low: Column) -> Column:
        numbers = F.transform(X.every(src, P.FIGURE_TOKEN), norm_num)
        figures = F.filter(X.every(summary, P.FIGURE_TOKEN), lambda t: ~F.array_contains(numbers, norm_num(t)))
        month = lambda t: X.first(F.lower(t), r"^([a-z]{3})[a-z]*")
        dates = F.filter(X.every(summary, P.DATE_TOKEN), lambda t: ~low.contains(F.lower(t)) & ~F.coalesce(low.contains(month(t)), F.lit(False)))
        spaced, squashed = F.replace(low, F.lit("-"), F.lit(" ")), F.regexp_replace(low, P.U + r"[\s-]", "")

        def known(t: Column) -> Column:
            core = F.regexp_replace(t, "['’]s?$", "")
            bare = F.regexp_replace(core, P.U + r"^(?:The|A|An)\s+", "")
            forms = F.transform(F.array_distinct(F.concat(plural_forms(core), plural_forms(bare), F.array(t, F.replace(t, F.lit("-"), F.lit(" "))))), F.lower)
            generic = (F.size(F.filter(X.words(core), lambda w: ~w.isin(list(P.GENERIC)))) == 0) | t.isin(list(P.GENERIC)) | (F.length(t) < 3) | (X.word_count(t) > 6)
            return generic | F.exists(forms, lambda f: low.contains(f) | spaced.contains(f) | squashed.contains(F.regexp_replace(f, P.U + r"[\s-]", "")))

        names = F.filter(F.transform(X.every(summary, P.NAME_TOKEN), X.strip), lambda t: ~known(t))
        return F.array_distinct(F.concat(F.transform(figures, tag("figure")), F.transform(dates, tag("date")), F.transform(names, tag("name"))))

    return X.let(F.lower(src), of)


def repair(draft: Column, bad: Column) -> Column:
    """The draft without unsupported figures and dates; a bad name cannot be repaired: null."""
    out = F.aggregate(bad, draft, lambda acc, b: F.replace(acc, b["token"], F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, P.U + r"\s{2,}", " "), P.U + r"\s+([.,;:%])", "$1")
    keep = F.filter(F.transform(F.split(out, P.U + r"(?<=[.;!?])\s+"), X.strip), lambda s: X.word_count(s) >= 4)
    fixed = F.nullif(X.strip(F.array_join(keep, " ")), F.lit(""))
    return F.when(F.size(bad) == 0, draft).when(~F.exists(bad, lambda b: b["kind"] == "name"), fixed)


def is_furniture(sentence: Column) -> Column:
    """Fewer than five words that start in lower case."""
    return F.size(F.filter(X.every(sentence, r"[A-Za-z][A-Za-z'-]*"), X.starts_lower)) < 5


def titlesafe_sentences(text: Column) -> Column:
    """Cut after ``.;!?`` and white space, but not after a title or abbreviation."""
    held = F.regexp_replace(text, P.COURTESY, "$1\x01")
    return F.filter(F.transform(F.split(X.strip(held), P.U + r"(?<=[.;!?])\s+"), lambda s: X.strip(F.replace(s, F.lit("\x01"), F.lit(".")))), lambda s: s != "")


def verbatim(section: Column, most: int = 2) -> Column:
    """The first sentences that say something, until 28 words or ``most`` sentences; 60 words at most."""

    def of(sents: Column) -> Column:
        body = F.filter(sents, lambda s: ~is_furniture(s))
        zero = F.lit("")

        def quoted(use: Column) -> Column:
            parts = F.slice(use, 1, most)
            got = F.aggregate(parts, zero, lambda acc, s: F.when(X.word_count(acc) >= P.VERBATIM_ENOUGH_WORDS, acc).when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s)))

            def finish(text: Column) -> Column:
                w = X.words(text)
                cut = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, P.VERBATIM_MAX_WORDS), " "), "[,;:]+$", ""), F.lit(" ..."))
                capped = F.when(F.size(w) > P.VERBATIM_MAX_WORDS, cut).otherwise(text)
                trim = lambda c: X.let(X.strip(F.regexp_replace(c, P.ROUTING_LEAD, "")), lambda t: F.when(X.word_count(t) >= 8, t).otherwise(c))
                return X.let(capped, trim)

            return X.let(X.strip(got), finish)

        return X.let(F.when(F.size(body) > 0, body).otherwise(sents), quoted)

    return X.let(titlesafe_sentences(F.coalesce(section, F.lit(""))), of)


def choose(drafts: DataFrame, faithful: str = "faithful", abstractive: str = "abstractive", section: str = "section") -> DataFrame:
    """``drafts`` with the text to publish and the route it took.

    Adds ``published, chosen, reason, removed, rejected, rejected_draft, polarity_dropped``. In order:
    a clean rewrite, a repaired one, a clean extract, a quote of the section; sentences that
    flip the section's polarity are dropped on the way, and the text is tidied at both ends.
    """
    s = F.coalesce(F.col(section), F.lit(""))
    out = drafts.withColumns({"_f": tidy(F.coalesce(F.col(faithful), F.lit("")), s), "_a": tidy(F.coalesce(F.col(abstractive), F.lit("")), s), "_i": polarity.polarity_index(s)})
    out = out.withColumns({"_ff": polarity.flips(F.col("_f"), F.col("_i")), "_af": polarity.flips(F.col("_a"), F.col("_i"))})
    out = out.withColumns({"_fd": polarity.depolarise(F.col("_f"), F.col("_ff")), "_ad": polarity.depolarise(F.col("_a"), F.col("_af"))})
    out = out.withColumn("_bad", unsupported(F.when(F.col("_ad") != "", F.col("_ad")).otherwise(F.col("_a")), s)).withColumn("_fbad", unsupported(F.col("_fd"), s))
    out = out.withColumn("_r", F.when(F.col("_ad") != "", repair(F.col("_ad"), F.col("_bad"))))
    out = out.withColumn("_rf", polarity.flips(F.col("_r"), F.col("_i"))).withColumn("_rd", F.when(F.col("_r").isNotNull(), polarity.depolarise(F.col("_r"), F.col("_rf"))))
    none, a_cut, f_cut = F.col("_a") == "", F.size("_af") > 0, F.size("_ff") > 0
    clean = ~none & (F.col("_ad") != "") & (F.size("_bad") == 0)
    mended = ~none & ~clean & (F.coalesce("_rd", F.lit("")) != "")
    extract = (F.col("_fd") != "") & (none | (F.size("_fbad") == 0))
    faith = F.when(f_cut, "faithful-depolarised").otherwise("faithful")
    chosen = F.when(clean, F.when(a_cut, "abstractive-depolarised").otherwise("abstractive")).when(mended, "abstractive-repaired").when(extract, faith).otherwise("verbatim")
    reason = (
        F.when(clean, F.when(a_cut, "polarity corrected, rewrite kept").otherwise("clean as generated")).when(mended, "unsupported figure/date removed, rewrite kept")
        .when(none & extract, F.when(f_cut, "polarity corrected against the section").otherwise("no abstractive draft")).when(extract, "rewrite unusable; extract clean")
        .when(none, "only draft flips polarity").otherwise("neither draft is safe, so the section is quoted")
    )
    text = F.when(clean, F.col("_ad")).when(mended, F.col("_rd")).when(extract, F.col("_fd")).otherwise(verbatim(s))
    unusable = ~none & ~clean & ~mended
    # Later drops replace earlier ones of the record.
    dropped = F.when(mended & (F.size("_rf") > 0), F.col("_rf")).when((none | (unusable & extract)) & f_cut, F.col("_ff")).when(~none & a_cut, F.col("_af"))
    out = out.withColumns(
        {
            "published": tidy(text, s),
            "chosen": chosen,
            "reason": reason,
            "removed": F.when(mended, F.slice(F.transform("_bad", lambda b: b["token"]), 1, 6)),
            "rejected": F.when(unusable, F.slice("_bad", 1, 6)),
            "rejected_draft": F.when(unusable, F.substring("_a", 1, 300)),
            "polarity_dropped": F.when(dropped.isNotNull(), polarity.dropped_record(dropped)),
        }
    )
    return out.drop("_f", "_a", "_i", "_ff", "_af", "_fd", "_ad", "_bad", "_fbad", "_r", "_rf", "_rd")
