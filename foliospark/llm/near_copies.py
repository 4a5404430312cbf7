"""Near deduplication by SimHash at a Jaccard similarity of word shingles, with no similar pair missed.

Fingerprints within two bits are candidates by the segment grid of :mod:`.simhash`. At a
similarity of 0.8 fingerprints of one pair differ in three to eleven bits, where a grid of
64-bit fingerprints tells nothing apart, so two rules that hold for *every* similar pair find
the rest: under one order of all shingles, two such sets share one among the first of each;
and as with fingerprints, the Manhattan distance of the sets' segment counts is a lower bound
of the number of shingles in which they differ. Whatever is left is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_map, bound_batches, durable, only_rows, parallelism, row_key, written
from .components import connected_components
from .simhash import near_links, print_of

SEED = 42
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Rows in which frequent shingles are looked for: a share of all and at least so many. What
#: as many of them hold comes last in the order. Any order gives the same pairs; this one saves
#: candidates.
PROBE_SHARE, PROBE_ROWS, PROBE_LEAST, MOST_FREQUENT = 1 / 64, 4_000, 5, 1 << 18
#: Nodes that share a prefix shingle are paired up to this number; a larger group is compared
#: with one of its nodes first, and after that only where components still differ.
CROWD = 8
#: Bounds the arrays of one step.
PAIRS_A_BATCH = 1 << 16
#: Segments of the hash space whose shingles are counted.
SEGMENT_BITS = 8
_ROW = "token long, node long, size int, at int"


def shingle_set(text: str | None, ngram: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    size = min(ngram, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = mixed * _STEP + hashes[k : k + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def segment_counts(shingles: np.ndarray) -> bytes:
    """The number of shingles in four bytes, then how many each segment of the hash space has, at most 255.

    Cutting numbers off only brings them closer, so the bound below stays one.
    """
    counts = np.bincount((shingles >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64), minlength=1 << SEGMENT_BITS)
    return len(shingles).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _least(share: float, n: np.ndarray | int) -> np.ndarray:
    """The smallest whole number that is ``share`` of ``n`` or more."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


def _most_apart(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles two similar sets with these sizes in all can differ."""
    return sizes - 2 * _least(similarity / (1 + similarity), sizes)


def _late(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(shingles), bool)
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return frequent[at] == shingles


def _frequent(docs: DataFrame, n: int, ngram: int) -> np.ndarray:
    """The most frequent shingles of the probed rows, sorted."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x.as_py(), ngram) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    share = ceil(max(PROBE_SHARE, min(1.0, PROBE_ROWS / max(n, 1))) * (1 << 20))
    probe = docs.select(F.col("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).distinct()
    counts = arrow_map(probe, explode, "token long").groupBy("token").count().where(F.col("count") >= PROBE_LEAST)
    top = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def _prefixes(nodes: DataFrame) -> DataFrame:
    """``(token, node, size, at)``: the first shingles of each set, with their places."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("first")]
        counts = [len(x) for x in tokens]
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        node, size = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("node", "size"))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (np.concatenate(tokens), node, size, at)], ["token", "node", "size", "at"])

    return arrow_map(nodes.select("node", "size", "first"), each, _ROW)


def _able(size_a, at_a, size_b, at_b, similarity: float) -> np.ndarray:
    """Whether two sets can be similar if these are the places of the first shingle they share."""
    enough = _least(similarity / (1 + similarity), size_a + size_b)
    return np.minimum(size_a - at_a, size_b - at_b) >= enough


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns with the starts and sizes of the groups of two nodes or more with one token.

    Input is sorted by token and node; a group is never cut.
    """
    held: list[np.ndarray] | None = None

    def cut(columns: list[np.ndarray]):
        token, node = columns[0], columns[1]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        columns = [c[new] for c in columns]
        starts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
        sizes = np.diff(np.append(starts, len(columns[0])))
        return columns, starts[sizes > 1], sizes[sizes > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield cut([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None and len(held[0]):
        yield cut(held)


def _batches(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows given as columns, put together to batches of a bounded size."""
    parts, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)

    for columns in rows:
        if len(columns[0]):
            parts.append(columns)
            n += len(columns[0])
            if n >= PAIRS_A_BATCH:
                yield joined()
                parts, n = [], 0
    if parts:
        yield joined()


def _by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), "token").sortWithinPartitions("token", "node")


def _candidates(prefixes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of the groups that are no crowds, and the members of crowds."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[np.ndarray]]:
            for (token, node, size, at), starts, sizes in _runs(batches, ["token", "node", "size", "at"]):
                for k in np.flatnonzero(sizes > CROWD):
                    own = slice(starts[k], starts[k] + sizes[k])
                    yield [np.ones(sizes[k], np.int32), token[own], node[own], size[own], at[own]]
                # Groups of one size are paired together.
                for n in np.unique(sizes[sizes <= CROWD]):
                    first, second = np.triu_indices(n, 1)
                    alike = starts[sizes == n]
                    step = max(1, PAIRS_A_BATCH // len(first))
                    for s in range(0, len(alike), step):
                        i, j = ((alike[s : s + step, None] + x).ravel() for x in (first, second))
                        able = _able(size[i], at[i], size[j], at[j], similarity)
                        a, b = node[i[able]], node[j[able]]
                        zero = np.zeros(len(a), np.int32)
                        yield [zero, a, b, zero, zero]

        yield from _batches(rows(), ["crowd", "token", "node", "size", "at"])

    found = written(_by_token(prefixes).mapInArrow(pair, "crowd int, " + _ROW), "near-candidates")
    return found.where("crowd = 0").select(F.col("token").alias("a"), F.col("node").alias("b")), found.where("crowd = 1").drop("crowd")


def _with_hubs(crowd: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each member of a crowd with its hub: the node most of whose prefix lies in crowds.

    What was changed least shares most with its copies, so hubs tie almost all of a group.
    """
    prefix = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1
    shares = crowd.groupBy("node").agg((F.count(F.lit(1)) / F.first(prefix)).alias("share"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[np.ndarray]]:
            for (_, node, size, at, share), starts, sizes in _runs(batches, ["token", "node", "size", "at", "share"]):
                for begin, n in zip(starts, sizes):
                    others = np.arange(begin, begin + n)
                    hub = begin + int(np.argmax(share[begin : begin + n]))
                    others = others[(others != hub) & _able(size[hub], at[hub], size[others], at[others], similarity)]
                    yield [np.minimum(node[hub], node[others]), np.maximum(node[hub], node[others])]

        yield from _batches(rows(), ["a", "b"])

    return _by_token(crowd.join(shares, "node")).mapInArrow(pair, "a long, b long")


def _still_apart(crowd: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """The pairs within crowds whose components differ."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[np.ndarray]]:
            for (_, node, size, at, part), starts, sizes in _runs(batches, ["token", "node", "size", "at", "part"]):
                for begin, n in zip(starts, sizes):
                    for k in range(begin, begin + n - 1):
                        others = np.arange(k + 1, begin + n)
                        others = others[(part[others] != part[k]) & _able(size[k], at[k], size[others], at[others], similarity)]
                        yield [np.minimum(node[k], node[others]), np.maximum(node[k], node[others])]

        yield from _batches(rows(), ["a", "b"])

    tagged = crowd.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    return _by_token(tagged.select("token", "node", "size", "at", "part")).mapInArrow(pair, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """The pairs that are as similar as asked: by the lower bound first, then on the whole sets."""

    def with_column(pairs: DataFrame, known: DataFrame, name: str) -> DataFrame:
        for end, at in (("a", "x"), ("b", "y")):
            pairs = pairs.join(known.select(F.col("node").alias(end), F.col(name).alias(at)), end)
        return pairs.select("a", "b", "x", "y")

    def able(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
        sizes = sum(np.ascontiguousarray(v[:, :4]).view(np.uint32).ravel().astype(np.int64) for v in (x, y))
        apart = np.abs(x[:, 4:].astype(np.int16) - y[:, 4:]).sum(axis=1, dtype=np.int64)
        return batch.select(["a", "b"]).filter(pa.array(apart <= _most_apart(sizes, similarity)))

    pairs = written(arrow_map(with_column(pairs.distinct(), nodes, "segments"), able, "a long, b long"), "near-pairs")
    if pairs.isEmpty():
        return pairs
    # Texts travel rather than sets, which are larger and do not compress.
    asked = nodes.select("node", F.col("best.key").alias("key")).join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    known = written(rows.join(asked, "key").select("node", "text").dropDuplicates(["node"]), "near-texts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                if held[0] != b:  # rows come by b after the last join
                    held = (b, shingle_set(y.as_py(), ngram))
                x, y = shingle_set(x.as_py(), ngram), held[1]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(with_column(pairs, known, "text").mapInArrow(each, "a long, b long"))


def _name(shingles: bytes) -> int:
    """The node of a set: a hash of all of it, as a signed long."""
    found = xxhash.xxh64_intdigest(shingles)
    return found - (1 << 64) if found >> 63 else found


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs whose fingerprints are within two bits: of one fingerprint with its first node, of others between first nodes."""
    nodes = nodes.select("node", "fp")
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = near_links(first.select(F.col("first").alias("node"), "fp"))
    return same.union(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))


def near_copy_components(nodes: DataFrame, rows: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """``(node, component)`` for the nodes with links: the closure of all pairs with this similarity."""
    pairs, crowd = _candidates(_prefixes(nodes), similarity)
    pairs = pairs.union(_with_hubs(crowd, similarity)).union(_print_pairs(nodes))
    links = _verified(pairs, nodes, rows, ngram, similarity)
    parts = connected_components(links)
    more = _verified(_still_apart(crowd, parts, similarity), nodes, rows, ngram, similarity)
    if more.isEmpty():
        return parts
    # Components are stars already: only what ties two of them is left to settle.
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies: that with the smallest id.

    Two texts are linked when the sets of their word shingles (``ngram`` words, ASCII letters
    without case) have a Jaccard similarity of ``similarity`` or more. Texts of fewer words
    are one shingle; null, empty and blank texts equal each other. Null ids come after all
    ids; rows are told apart by id and text, and of rows equal in both one stays. Empty table:
    empty result. All columns are kept, whatever their names.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("least"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    frequent = _frequent(rows, docs.count(), ngram)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py(), ngram) for x in batch.column("text")]
        node = pa.array(np.fromiter((_name(s.tobytes()) for s in sets), np.int64, len(sets)))
        fp = pa.array(np.fromiter(map(print_of, sets), np.uint64, len(sets)).view(np.int64))
        first = []
        for s in sets:
            late = _late(s, frequent)
            n = len(s) - int(_least(similarity, len(s))) + 1 if len(s) else 0
            first.append(np.concatenate((s[~late], s[late]))[:n].tobytes())
        columns = [batch.column("least"), batch.column("key"), node, fp, pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.binary()), pa.array(map(segment_counts, sets), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["least", "key", "node", "fp", "size", "first", "segments"])

    seen = arrow_map(rows, each, "least long, key binary, node long, fp long, size int, first binary, segments binary")
    # Rows of one node agree in all of these; the node stands for its first row.
    held = ("fp", "size", "first", "segments")
    nodes = written(seen.groupBy("node").agg(F.min(F.struct("least", "key")).alias("best"), *(F.first(c).alias(c) for c in held)), "near-nodes")
    parts = near_copy_components(nodes, rows.select("key", "text"), ngram, similarity)
    tagged = nodes.select("best", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    kept = tagged.groupBy("part").agg(F.min("best").alias("first")).select(F.col("first.key").alias("key"))
    return only_rows(docs, kept, id_col, text_col)
