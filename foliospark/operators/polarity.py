"""Negation: sentences of a draft that turn round what their section says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def neutralise(text: Column) -> Column:
    """"Without limitation" includes, and "No." before a number is a number."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), P.NUMBER_NO, "number "), P.NEUTRAL, "including")


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), P.POLARITY_BREAK)


def tokens(sentence: Column) -> Column:
    return X.every(neutralise(sentence), P.WORD)


def _cut(word: Column, endings: tuple[str, ...], least: dict[str, int] | None = None, floor: int = 5) -> Column:
    out = word
    for e in reversed(endings):
        need = (least or {}).get(e, floor)
        out = F.when(word.endswith(e) & (F.length(word) - len(e) >= need), F.substring(word, F.lit(1), F.length(word) - len(e))).otherwise(out)
    return out


def stem_legal(word: Column) -> Column:
    """Stem for negation: ability endings first, then one suffix off a stem of five letters."""

    def of(w: Column) -> Column:
        out = _cut(w, P.LEGAL_ENDINGS)
        for ending, by in reversed(P.ABILITY_ENDINGS):
            out = F.when(w.endswith(ending) & (F.length(w) > len(ending) + 1), F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(by))).otherwise(out)
        return out

    return X.let(F.regexp_replace(F.lower(word), "'+$", ""), of)


def is_cue(token: Column) -> Column:
    return F.lower(token).isin(list(P.CUES))


def cue_places(toks: Column) -> Column:
    return F.array_compact(F.transform(toks, lambda t, i: F.when(is_cue(t), i)))


def governed(toks: Column, place: Column) -> Column:
    """The first token that means something among the six after ``place``; else null."""
    near = F.transform(F.slice(toks, place + 2, P.CUE_REACH), lambda t, k: F.struct((place + 1 + k).alias("i"), t.alias("t")))
    idle = lambda t: F.lower(t).isin(list(P.SKIPPED)) | is_cue(t) | (F.length(t) < 3) | F.lower(t).endswith("ly")
    return F.try_element_at(F.filter(near, lambda x: ~idle(x["t"])), F.lit(1))["i"]


def negated(toks: Column) -> Column:
    """Places governed by a cue, in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(cue_places(toks), lambda c: governed(toks, c)))))


def polarity_index(source: Column) -> Column:
    """``(neg, plain, wide)``: stems under a cue within ten tokens, stems said plainly, stems after a cue.

    A sentence with an exception says what it negates plainly, too.
    """

    def of_sentence(s: Column) -> Column:
        def of(t: Column) -> Column:
            cues = cue_places(t)

            def split(cues: Column) -> Column:
                under = lambda i: F.exists(cues, lambda c: (i - c > 0) & (i - c <= P.LICENCE_WINDOW))
                marked = F.transform(t, lambda w, i: F.struct(stem_legal(w).alias("s"), under(i).alias("u"), ((F.size(cues) > 0) & (i > F.try_element_at(cues, F.lit(1)))).alias("w")))
                pick = lambda test: lambda m: F.transform(F.filter(m, test), lambda x: x["s"])
                exc = s.rlike(P.EXCEPTION)
                return X.let(marked, lambda m: F.struct(pick(lambda x: x["u"])(m).alias("neg"), pick(lambda x: ~x["u"] | exc)(m).alias("plain"), pick(lambda x: F.coalesce(x["w"], F.lit(False)))(m).alias("wide")))

            return X.let(cues, split)

        return X.let(tokens(s), of)

    gather = lambda found, name: F.array_distinct(F.flatten(F.transform(found, lambda x: x[name]))).alias(name)
    return X.let(F.transform(sentences(source), of_sentence), lambda f: F.struct(gather(f, "neg"), gather(f, "plain"), gather(f, "wide")))


def evidence(sentence: Column) -> Column:
    """Content stems of a sentence: lower-case words of four letters that are no function words."""
    good = lambda w: X.starts_lower(w) & (F.length(w) >= 4) & ~F.lower(w).isin(list(P.FUNCTION_WORDS))
    return F.array_distinct(F.transform(F.filter(X.every(sentence, P.WORD), good), stem_legal))


def flips(candidate: Column, index: Column) -> Column:
    """Sentences of ``candidate`` that negate what the section says plainly, or the reverse.

    ``index`` is the section's :func:`polarity_index`. Structs ``(kind, sentence, word)``.
    """
    finding = lambda kind, s, w: F.struct(F.lit(kind).alias("kind"), s.alias("sentence"), w.alias("word"))
    has = lambda name, stem: F.array_contains(index[name], stem)

    def of_sentence(s: Column) -> Column:
        def of(t: Column) -> Column:
            word = lambda i: F.element_at(t, i + 1)

            def invented(i: Column) -> Column:
                stem = stem_legal(word(i))
                proper = word(i).rlike(r"^\p{Lu}") & (i > 0)
                others = F.array_except(evidence(s), F.array(stem))
                return ~proper & has("plain", stem) & ~has("neg", stem) & ~F.arrays_overlap(others, index["wide"])

            def dropped(i: Column) -> Column:
                w = word(i)
                return X.starts_lower(w) & (F.length(w) >= 5) & ~F.lower(w).isin(list(P.SKIPPED)) & has("neg", stem_legal(w)) & ~has("plain", stem_legal(w))

            modal = F.try_element_at(F.array_compact(F.transform(t, lambda x, i: F.when(F.lower(x).isin(list(P.MODALS)), i))), F.lit(1))
            turned = lambda neg: F.try_element_at(F.filter(neg, lambda i: F.coalesce(invented(i), F.lit(False))), F.lit(1))
            lost = X.let(F.when(modal.isNotNull(), governed(t, modal)), lambda i: F.when(i.isNotNull() & dropped(i), finding("dropped-negation", s, word(i))))
            return X.let(
                negated(t),
                lambda neg: F.when(F.size(neg) > 0, X.let(turned(neg), lambda i: F.when(i.isNotNull(), finding("invented-negation", s, word(i))))).when(~s.rlike(P.EXCEPTION), lost),
            )

        return X.let(tokens(s), of)

    return F.array_compact(F.transform(sentences(X.strip(F.coalesce(candidate, F.lit("")))), of_sentence))


def depolarise(candidate: Column, found: Column) -> Column:
    """``candidate`` without the sentences in ``found``; sentences are dropped, never edited."""
    bad = F.transform(found, lambda f: f["sentence"])
    kept = F.filter(sentences(X.strip(F.coalesce(candidate, F.lit("")))), lambda s: ~F.array_contains(bad, s))
    return F.when(F.size(found) > 0, X.strip(F.array_join(kept, " "))).otherwise(candidate)


def dropped_record(found: Column) -> Column:
    """Up to four of the dropped sentences, cut at 170 characters."""
    return F.transform(F.slice(found, 1, 4), lambda f: F.struct(f["kind"].alias("kind"), f["word"].alias("word"), F.substring(f["sentence"], 1, 170).alias("sentence")))
