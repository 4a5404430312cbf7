"""Sequence packing along a space-filling curve.

Documents are projected to a few dimensions, ordered by their place on a Hilbert curve and
laid end to end in that order, so a training sequence holds neighbouring documents and only
the very last one is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRETOKENS, Encoder, Vocabulary, byte_alphabet, check_plain, special_pattern
from .common import NULL_ID, bound_batches, parallelism, slices, written

END = 0
#: Hilbert curve: dimensions and bits of each; below them bits that deal out equal vectors.
DIMS, BITS, SPREAD_BITS = 4, 10, 12
#: Hashed vectors have this many buckets.
BUCKETS = 256
#: Tokens of a range of the curve, about; ranges bound the memory of a task.
RANGE_TOKENS = 16_000_000
#: Text handled at once.
BATCH_BYTES = 1_500_000


class FastEncoder:
    """The ids of :class:`~foliospark.llm.bpe.Encoder`, from compiled code where ids follow merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_plain(spec, path)
        vocab, byte_of = spec["model"]["vocab"], byte_alphabet()
        merges = (m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"])
        made = [vocab[m.replace(" ", "", 1)] for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = special_pattern(self.special)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if made == sorted(made):
            ranks = {bytes(byte_of[c] for c in token): k for token, k in vocab.items()}
            plain = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            slow = Encoder(Vocabulary(path))
            plain = lambda text: np.frombuffer(slow.plain(text), "<u4").tolist()
        self.plain = plain
        rng = np.random.default_rng(20)
        directions = rng.standard_normal((BUCKETS, DIMS))
        bucket = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
        self.projection = directions[bucket % BUCKETS].astype(np.float32)

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text, then the end id."""
        if self.split_special is None or not self.split_special.search(text):
            out = self.plain(text)
        else:
            out, at = [], 0
            for m in self.split_special.finditer(text):
                out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            out += self.plain(text[at:])
        out.append(END)
        return np.array(out, self.dtype)

    def vector(self, ids: np.ndarray) -> np.ndarray:
        """The document's hashed token counts, scaled to unit length and projected."""
        counts = np.bincount(ids, minlength=0)
        seen = np.flatnonzero(counts)
        weights = counts[seen].astype(np.float32)
        return weights @ self.projection[seen] / np.sqrt(weights @ weights)


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points ``(n, dims)`` with ``bits`` bits a coordinate.

    Gray-code construction after Skilling (2004): undo the excess reflections from the
    highest bit down, Gray-encode across the coordinates, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one, zero = np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        below = bit - one
        for k in range(dims):
            up = (x[k] & bit) != 0
            swap = np.where(up, zero, (x[0] ^ x[k]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - one), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            out = out << one | x[k] >> np.uint64(b) & one
    return out


def curve_cells(vectors: np.ndarray) -> np.ndarray:
    """Grid cells of projected vectors; the squashing is fixed, so cells do not depend on the corpus."""
    squashed = 0.5 + np.arctan(vectors) / np.pi
    return np.clip((squashed * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, mix, curve, n, ids)``: packed ids of each document and its place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fast_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids = [coder.ids(t.as_py() or "") for t in batch.column("text")]
                vectors = np.array([coder.vector(x) for x in ids], np.float64)
                mix = batch.column("mix").to_numpy()
                curve = hilbert_index(curve_cells(vectors), BITS).astype(np.int64) << SPREAD_BITS | mix & ((1 << SPREAD_BITS) - 1)
                columns = [batch.column("doc_id"), batch.column("mix"), pa.array(curve), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mix", "curve", "n", "ids"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("mix", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, mix long, curve long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, in Hilbert order.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and with
    ``with_ids`` the piece's ids. Each document ends with id 0. Every sequence but the last
    is full. The order is cut into ranges by quantiles of the curve over all documents; the
    ranges' token totals (one number a range) give each range its first place, so sequences
    run on across tasks.

    Null or empty text: the end id alone. Null id: kept, null in the result. Repeated rows:
    packed as often as they come. Equal vectors, however many: spread over many ranges by a
    hash of the row. Empty table: empty result. Other columns are ignored.
    """
    wide = fast_encoder(tokenizer).dtype
    rows = written(tokenised(docs, tokenizer, id_col, text_col), "packing")
    total, count = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    ranges = max(1, min(count, max(parallelism(docs.sparkSession), -(-(total or 0) // RANGE_TOKENS))))
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = rows.agg(F.percentile_approx("curve", shares, 50 * ranges).alias("cuts")).first().cuts
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(curve: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, curve.to_numpy(), side="left").astype(np.int32))

    rows = rows.withColumn("part", range_of("curve"))
    sums = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for part in sorted(sums):
        first[part] = at
        at += sums[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, 0
        for batch in (piece for whole in batches for piece in slices(whole, "ids", BATCH_BYTES)):
            out: list[tuple] = []
            for doc_id, p, n, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "n", "ids"))):
                if p != part:
                    part, place = p, first[p]
                ids = np.frombuffer(packed, wide).astype("<u4").tobytes()
                start = 0
                while start < n:
                    size = min(n - start, length - place % length)
                    piece = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, start, size, zlib.crc32(piece), n, place // length, place % length, piece))
                    start += size
                    place += size
            if out:
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} long" for c in names[:7]) + ", ids array<int>" * with_ids
    ordered = rows.repartition(ranges, "part").sortWithinPartitions("part", "curve", "mix", F.coalesce("doc_id", F.lit(NULL_ID)))
    return ordered.mapInArrow(cut, schema)
