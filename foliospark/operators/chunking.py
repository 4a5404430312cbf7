"""Splitting of long sections for scorers with an input limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

Counter = Callable[[Column], Column]


def sentences(text: Column) -> Column:
    """Cut after a full stop, question or exclamation mark before a capital or parenthesis."""
    return F.split(text, P.SENTENCE_BREAK)


def split_parts(text: Column, limit: int, tokens: Counter = X.word_count) -> Column:
    """Sentences packed greedily to 88 % of ``limit`` tokens; what fits stays whole.

    A single sentence above the limit stays whole as well.
    """
    piece = int(limit * 0.88)
    zero = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        def packed(trial: Column) -> Column:
            full = (tokens(trial) > piece) & (acc["cur"] != "")
            return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(trial).alias("cur"))

        return X.let(X.strip(F.concat(acc["cur"], F.lit(" "), s)), packed)

    finish = lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    parts = F.aggregate(sentences(text), zero, step, finish)
    return F.when(tokens(text) <= limit, F.array(text)).otherwise(X.let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text))))


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, P.ITEM_BREAK), X.strip), lambda x: x != "")


def _merged_items(items: Column) -> Column:
    """Lettered items joined until each part has 25 words; a short last part joins the one before."""
    zero = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        def put(buf: Column) -> Column:
            full = X.word_count(buf) >= P.ITEM_MIN_WORDS
            return F.struct(F.when(full, F.concat(acc["done"], F.array(buf))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(buf).alias("buf"))

        return X.let(X.strip(F.concat_ws(" ", acc["buf"], x)), put)

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(X.strip(F.concat(F.element_at(acc["done"], -1), F.lit(" "), acc["buf"]))))
        return F.when(acc["buf"] == "", acc["done"]).when(n > 0, last).otherwise(F.array(acc["buf"]))

    return F.aggregate(items, zero, step, finish)


def _grouped_sentences(sents: Column, wanted: Column) -> Column:
    """Equal groups of sentences in order; the last group takes what is left."""
    n = F.least(wanted, F.size(sents))
    per = F.greatest(F.lit(1), F.floor(F.size(sents) / n)).cast("int")
    group = lambda k: F.array_join(F.when(k < n - 1, F.slice(sents, k * per + 1, per)).otherwise(F.slice(sents, k * per + 1, F.size(sents))), " ")
    return F.transform(F.sequence(F.lit(0), n - 1), group)


def coverage_parts(text: Column, limit: int = 1024, tokens: Counter = X.word_count) -> Column:
    """Parts that together cover the whole section.

    Short sections go to :func:`split_parts`; three lettered items or more are merged (the
    first 16 parts count); anything else becomes two to eight equal groups of sentences,
    by a target of 90 words rounded half to even.
    """
    fine = lambda parts: F.flatten(F.transform(parts, lambda p: split_parts(p, limit, tokens)))
    wanted = F.greatest(F.lit(2), F.least(F.lit(P.COVER_MAX_PARTS), F.bround(X.word_count(text) / P.COVER_TARGET_WORDS).cast("int")))
    sents = F.filter(F.transform(sentences(text), X.strip), lambda s: s != "")
    by_sentence = X.let(sents, lambda s: F.when(F.size(s) < 2, split_parts(text, limit, tokens)).otherwise(fine(_grouped_sentences(s, wanted))))
    by_item = lambda items: F.when(F.size(items) >= 3, fine(F.slice(_merged_items(items), 1, 2 * P.COVER_MAX_PARTS))).otherwise(by_sentence)
    return F.when(X.word_count(text) < P.COVER_MIN_WORDS, split_parts(text, limit, tokens)).otherwise(X.let(_items(text), by_item))


#: Tokens a word makes, and a section's share of words in its summary.
TOKENS_PER_WORD, SUMMARY_SHARE, SUMMARY_LEAST, SUMMARY_MOST = 1.35, 0.30, 48, 260


def token_budget(section_words: Column, input_words: Column, longer: bool = False, share: float = SUMMARY_SHARE, least: int = SUMMARY_LEAST, most: int = SUMMARY_MOST) -> Column:
    """Most tokens of a draft: a share of the section within bounds, and never more than the input gives."""
    wanted = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(section_words * share * TOKENS_PER_WORD)))
    cap = F.when(F.coalesce(section_words, F.lit(0)) == 0, F.lit(80 if longer else 70)).otherwise(wanted)
    by_input = F.greatest(F.lit(24), F.floor(input_words * TOKENS_PER_WORD * 0.85))
    return F.when(F.coalesce(input_words, F.lit(0)) > 0, F.least(cap, by_input)).otherwise(cap).cast("int")


def token_floor(input_words: Column) -> Column:
    """Fewest tokens of a draft."""
    return F.greatest(F.lit(8), F.least(F.lit(12), F.floor(input_words / 2))).cast("int")
