"""SimHash near-deduplication over a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of 21 short segments. Flipping a bit moves
one count by one, so the Manhattan distance of two count vectors is at most the Hamming
distance of the fingerprints: a lower bound that candidates have to meet. The vectors are
joined on a grid of three projections and candidates are verified on the fingerprints.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_map, durable
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 15
#: Lowest bit of each segment: bits 0, 3, ..., 60; the last segment has four bits.
LOW_BITS = sum(1 << k for k in range(0, 61, 3))
GROUP_BITS, SEGMENTS_A_GROUP = 21, 7
#: Links are found for Hamming distances up to this; the grid below is laid out for it.
MOST_BITS = 2
#: A grid cell with more fingerprints goes the other way, see :func:`_ball_links`.
CELL_LIMIT = 128


def fingerprint(text: str | None, ngram: int = 3) -> int:
    """SimHash of the word shingles, repeats included; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < ngram:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(ngram)))), len(words) - ngram + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        size = min(CHUNK, n - start)
        ones += _bits_set(np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, size), repeat(SEED)), np.uint64, size))
    return _majority(ones, n)


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def print_of(hashes: np.ndarray) -> int:
    """SimHash of shingles that are hashed already; none: zero."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        ones += _bits_set(hashes[start : start + CHUNK])
    return _majority(ones, len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; one row per row of ``docs``."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x.as_py(), ngram) for x in batch.column("text")), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, each, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The segments' bit counts, three bits each, packed into a long."""
    low = F.lit(LOW_BITS)
    parts = fp.bitwiseAND(low) + F.shiftrightunsigned(fp, 1).bitwiseAND(low) + F.shiftrightunsigned(fp, 2).bitwiseAND(low)
    return parts + F.shiftleft(F.shiftrightunsigned(fp, 63), 60)


def _cells(counts: Column) -> list[Column]:
    """A fingerprint's cell in each of the three projections.

    Of three groups of segments, with a distance of two in all, there are always a group i
    at distance zero and the next group at a distance of one at most. Projection i has
    group i and the one after it.
    """
    group = [F.shiftrightunsigned(counts, k * GROUP_BITS).bitwiseAND(F.lit((1 << GROUP_BITS) - 1)) for k in range(3)]
    return [F.lit(k << 2 * GROUP_BITS) + F.shiftleft(group[k], GROUP_BITS) + group[(k + 1) % 3] for k in range(3)]


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MOST_BITS


def _ball_links(nodes: DataFrame) -> DataFrame:
    """Links that connect what is within two bits, with no pairs listed.

    Two fingerprints are within two bits just if some point is within one bit of both. Only
    65 fingerprints can be near a point, so the group of a point is bounded however many
    copies there are; its members are tied to its smallest node.
    """
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(b if b < 2**63 else b - 2**64)) for b in (1 << k for k in range(64))))
    groups = nodes.select("node", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("node").alias("near"))
    return groups.where(F.size("near") > 1).select(F.explode("near").alias("a"), F.array_min("near").alias("b"))


def near_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``(node, fp)``.

    Their transitive closure is that of all pairs within two bits. Within cells of up to
    ``CELL_LIMIT`` fingerprints every pair is verified and returned; whatever meets in a
    fuller cell is linked through shared neighbours instead, which is exact as well.
    """
    nodes = nodes.select("node", "fp", F.posexplode(F.array(*_cells(segment_counts(F.col("fp"))))).alias("k", "cell"))
    full = durable(nodes.groupBy("cell").count().where(F.col("count") > CELL_LIMIT).select("cell"))
    steps = [F.lit(0)] + [F.lit(1 << 3 * k) for k in range(SEGMENTS_A_GROUP)]
    probes = nodes.select(F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("cell").alias("home"), F.explode(F.array(*(F.col("cell") + s for s in steps))).alias("cell"))
    ends = nodes.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"), "cell")
    crowded = not full.isEmpty()
    if crowded:
        hot = probes.join(full, "cell", "left_semi").select(F.col("a").alias("node"), F.col("fp_a").alias("fp"))
        hot = hot.distinct()
        probes, ends = (x.join(full, "cell", "left_anti") for x in (probes, ends))
    links = probes.join(ends, "cell").where(((F.col("cell") != F.col("home")) | (F.col("fp_a") < F.col("fp_b"))) & _near("fp_a", "fp_b")).select("a", "b")
    return links.union(_ball_links(hot)) if crowded else links


def _named(prints: DataFrame) -> DataFrame:
    """Rows of ``prints`` (``doc_id, fp`` and others) with their ``component_id``."""
    nodes = durable(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least")))
    parts = connected_components(near_links(nodes.select(F.col("fp").alias("node"), "fp")))
    tagged = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    names = tagged.groupBy("part").agg(F.min("least").alias("name"))
    classes = tagged.join(names, "part").select("fp", "part", F.nullif("name", F.lit(NULL_ID)).alias("component_id"))
    return prints.join(classes, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Documents whose fingerprints differ in two bits or fewer are linked; a component is
    named by the smallest id that can be reached. Copies share a fingerprint and enter the
    search once, so groups of copies of any size add no pairs.

    Null or empty text, or white space only: fingerprint zero, linked like any other. Null
    id: ordered after all ids (the component of nothing but null ids is null). Repeated
    rows: each returns a row. Empty table: empty result. Other columns are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, ngram))
    return _named(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
