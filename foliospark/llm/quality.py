"""Quality rules: text statistics and a hashed n-gram likelihood ratio.

A document's score is the mean log-likelihood ratio of its byte n-grams between a
multinomial of trusted text and one of the raw corpus, both over hashed n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

NGRAM, BUCKET_BITS = 3, 16
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: The classifier is fitted on labelled rows: at most this many of each class, chosen by a hash of the id.
FIT_ROWS = 20_000
#: Cuts this close to the least error count as equally good.
SLACK = 0.02
#: Text handled at once.
BATCH_BYTES = 1_500_000


# -- n-grams ---------------------------------------------------------------------------------


def hashed_ngrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte n-gram that starts at each byte (the last ``NGRAM - 1`` excepted)."""
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        code |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return code * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each ends."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """Hashed n-gram counts over every whole text of ``docs(text)``; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                data, ends = joined(batch)
                codes = hashed_ngrams(data)
                total += np.bincount(codes, minlength=1 << BUCKET_BITS)
                if len(codes):
                    total -= np.bincount(codes[crossing(ends, len(codes))], minlength=1 << BUCKET_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], ["bucket", "n"])

    bound_batches(docs.sparkSession)
    sums = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"]
    return out


def crossing(ends: np.ndarray, n: int) -> np.ndarray:
    """Places of the n-grams that begin in one text and end in another."""
    at = np.unique(np.concatenate([ends[:-1] - k for k in range(1, NGRAM)]))
    return at[(at >= 0) & (at < n)]


def mean_ratio(batch: pa.RecordBatch, ratios: np.ndarray) -> np.ndarray:
    """Each text's mean log-likelihood ratio; texts without an n-gram score zero."""
    data, ends = joined(batch)
    codes = hashed_ngrams(data)
    if not len(codes):
        return np.zeros(len(ends))
    values = ratios[codes]
    values[crossing(ends, len(codes))] = 0
    sums = np.concatenate(([0.0], np.cumsum(values)))
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.maximum(ends - starts - NGRAM + 1, 0)
    last = np.minimum(starts + counts, len(codes))
    return np.where(counts > 0, (sums[last] - sums[np.minimum(starts, len(codes))]) / np.maximum(counts, 1), 0.0)


# -- text statistics -------------------------------------------------------------------------


def repeated_words(words: pd.Series, owner: np.ndarray, docs: int) -> np.ndarray:
    """By document, the words in windows of ``WINDOW`` words that its text holds twice or more.

    Words become codes, windows pairs of codes made codes again: equal codes are equal words.
    """
    found = np.zeros(docs, np.int64)
    if len(words) < WINDOW:
        return found
    one = pd.factorize(words)[0].astype(np.int64)
    two = pd.factorize(one[:-1] * (one.max() + 1) + one[1:])[0].astype(np.int64)
    four = pd.factorize(two[:-2] * (two.max() + 1) + two[2:])[0].astype(np.int64)
    five = pd.factorize(four[:-1] * (one.max() + 1) + one[4:])[0].astype(np.int64)
    inside = owner[: len(five)] == owner[4:]
    code, who = five[inside], owner[: len(five)][inside]
    window = pd.factorize(code * docs + who)[0]
    twice = np.bincount(window, minlength=1)[window] > 1
    covered = np.zeros(len(owner) + 1, np.int64)
    starts = np.flatnonzero(inside)[twice]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return found + np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=docs)


def statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    n_words, chars, symbols, dup_lines, every = [], [], [], [], []
    for x in batch.column("text"):
        text = x.as_py() or ""
        data = text.encode()
        words = data.split()
        every += words
        n_words.append(len(words))
        chars.append(len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))))
        symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
        lines = [line for line in data.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    count = np.array(n_words, np.int64)
    repeats = repeated_words(pd.Series(every, dtype=object), np.repeat(np.arange(len(count)), count), len(count))
    return {"n_words": count, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": repeats}


# -- the model -------------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityModel:
    """Log-likelihood ratios by n-gram bucket and the lowest score that is kept."""

    ratios: np.ndarray
    threshold: float


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap among the cuts whose error is near the least.

    The error is the share of good documents below the cut plus the share of bad ones not
    below it; cuts within ``SLACK`` of the least are equally good and the widest gap is the
    safest of them. Without both classes nothing is dropped.
    """
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    below = np.searchsorted(np.sort(good), values, "left") / len(good)
    above = 1 - np.searchsorted(np.sort(bad), values, "left") / len(bad)
    errors = below + above
    best = np.flatnonzero(errors <= errors.min() + SLACK)
    gaps = [(values[k] - values[k - 1] if k else 0.0, k) for k in best]
    k = max(gaps)[1]
    return float((values[k] + values[k - 1]) / 2 if k else values[0])


def fit_quality(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Corpus statistics over all of ``docs``, trusted text and threshold from labelled rows.

    ``labels(doc_id, quality)`` names trusted (1) and poor (0) documents; at most
    ``fit_rows`` of each, the first by a hash of the id, fit the classifier. The raw
    multinomial counts every n-gram of every document. No labels: every score is zero and
    the statistics alone decide.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = ngram_counts(rows)
    if labels is None:
        return QualityModel(np.zeros(1 << BUCKET_BITS), -np.inf)
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.union(part)
    # At most two times fit_rows ids: small enough to broadcast at any corpus size.
    sample = rows.join(F.broadcast(chosen), "doc_id")
    trusted = ngram_counts(sample.where("quality = 1"))
    if not trusted.sum():
        return QualityModel(np.zeros(1 << BUCKET_BITS), -np.inf)
    ratios = log_ratios(trusted, raw)
    scores = scored(sample.select("doc_id", "quality", "text"), ratios).toPandas()
    good, bad = (scores.loc[scores["quality"] == k, "score"].to_numpy() for k in (1, 0))
    return QualityModel(ratios, best_threshold(good, bad))


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed log ratios; the prior is the raw multinomial, so what neither has seen says nothing."""
    background = (raw + 1) / (raw.sum() + len(raw))
    target = (trusted + len(raw) * background / 16) / (trusted.sum() + len(raw) / 16)
    return np.log(target / background)


def scored(sample: DataFrame, ratios: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(mean_ratio(batch, ratios))], ["quality", "score"])

    return sample.select("quality", "text").mapInArrow(run, "quality int, score double")


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base rules and verdict for each row of ``docs``.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score``. Base rules fail below ``MIN_WORDS`` words or when more than
    ``MOST_REPEATED_PERCENT`` percent of the words lie in repeated windows; the others are
    kept when their score reaches the model's threshold.

    Null or empty text: no words, so ``base_failed``. Null ids and repeated rows: a row
    each. Empty table: empty result. Other columns are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    ratios, threshold = model.ratios, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                s = statistics(batch)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])
                score = mean_ratio(batch, ratios)
                columns = [batch.column("doc_id"), *(pa.array(s[c]) for c in names[1:6]), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def with_good_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, without a shuffle."""
    ratios, threshold = model.ratios, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col, BATCH_BYTES):
                text = pa.compute.fill_null(part.column(text_col).cast(pa.string()), "")
                batch = pa.RecordBatch.from_arrays([text], ["text"])
                s = statistics(batch)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])
                yield part.filter(pa.array(~failed & (mean_ratio(batch, ratios) >= threshold)))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
