"""Removal of byte strings that repeat across documents, by suffix arrays.

Every window of ``MATCH`` bytes is routed by its anchor, the least of its hashed k-grams,
so equal windows meet whatever documents they are in. Only anchors that several documents
hold are followed. Pieces of text around such an anchor go to its family; suffix arrays
over shards of a family find equal windows and the smallest document of each, and shards of
one anchor are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, bound_batches, parallelism
from .suffix_arrays import common_prefixes, suffix_array

MATCH, GRAM = 50, 20
#: Text of a document part and of an anchor part, about.
PART_BYTES = 8_000_000
#: Text whose anchors are found at once, and text of a shard's suffix array.
BATCH_BYTES, SHARD_BYTES = 250_000, 750_000
#: Anchors held by this share of about ``PROBE_ROWS`` documents are routed window by window.
PROBE_ROWS, FREQUENT_SHARE = 20_000, 0.005
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LOW = np.uint64(63)
_ROW_BITS = (1 << 40) - 1


# -- anchors ---------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on; the low six bits are left clear."""
    n = len(data) - GRAM + 1
    raw = data.tobytes()
    word = lambda at: np.ndarray((n,), "<u8", raw, at, (1,))
    x = word(0) * np.uint64(_MIX[0])
    x ^= x >> np.uint64(29)
    x += word(8) * np.uint64(_MIX[1])
    x ^= x >> np.uint64(32)
    x += np.ndarray((n,), "<u4", raw, 16, (1,)).astype(np.uint64)
    x *= np.uint64(_MIX[2])
    x ^= x >> np.uint64(31)
    x *= np.uint64(_MIX[0])
    return x & ~_LOW


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: ``(hash, document, first window, windows)``.

    Windows lie within one document; places are counted from the start of ``data``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none.astype(np.uint64), none, none, none
    span = MATCH - GRAM + 1
    least = gram_hashes(data) | (np.arange(len(data) - GRAM + 1, dtype=np.uint64) & _LOW)
    width = 1
    while width < span:
        shift = min(width, span - width)
        least = np.minimum(least[: len(least) - shift], least[shift:])
        width += shift
    starts = np.concatenate(([0], ends[:-1]))
    owner = np.repeat(np.arange(len(ends)), ends - starts)[: len(least)]
    fits = np.arange(len(least)) + MATCH <= ends[owner]
    place = np.arange(len(least))
    anchor = place + ((least & _LOW).astype(np.int64) - place) % 64
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(least)))
    ok = fits[first]
    first, size = first[ok], size[ok]
    return least[first] & ~_LOW, owner[first], first, size


def short_hash(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash, independent of the part it goes to."""
    return h * np.uint64(_MIX[2]) >> np.uint64(16)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * np.uint64(_MIX[1]) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first document, bytes, ends)`` of about ``BATCH_BYTES`` each."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= BATCH_BYTES):
            held += len(texts[stop])
            stop += 1
        yield at, np.frombuffer(b"".join(texts[at:stop]), np.uint8), np.cumsum([len(t) for t in texts[at:stop]])
        at = stop


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places that have it."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(part[places[0]]), places


def held_by_several(blobs: list[bytes], doc_parts: int) -> Iterator[tuple[int, bytes]]:
    """Of ``(anchor, row)`` entries those whose anchor several rows hold, by document part."""
    packed = np.concatenate([np.frombuffer(b, np.uint8) for b in blobs]).reshape(-1, 11)
    anchor, row = from_low_bytes(packed[:, :6].tobytes(), 6), from_low_bytes(packed[:, 6:].tobytes(), 5)
    order = np.lexsort((row, anchor))
    a, r = anchor[order], row[order]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    shared = (r[first] != r[last])[group]
    keep = order[shared]
    for part, places in by_part((row[keep] % np.uint64(doc_parts)).astype(np.int64)):
        yield part, packed[keep[places]].tobytes()


def address(th: np.ndarray, row: np.ndarray, blobs: list[bytes], doc_parts: int) -> list[tuple[int, bytes]]:
    """``(anchor, text)`` entries as ``(anchor, row)`` entries of the texts' rows, by document part."""
    if not blobs or not len(th):
        return []
    packed = np.concatenate([np.frombuffer(b, np.uint8) for b in blobs]).reshape(-1, 11)
    short = th & np.uint64(_ROW_BITS)
    order = np.argsort(short, kind="stable")
    short, row = short[order], row[order] & np.uint64(_ROW_BITS)
    asked = from_low_bytes(packed[:, 6:].tobytes(), 5)
    lo, hi = np.searchsorted(short, asked, "left"), np.searchsorted(short, asked, "right")
    entry = np.repeat(np.arange(len(asked)), hi - lo)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    target = row[lo[entry] + nth]
    out = np.concatenate([packed[entry, :6], np.frombuffer(low_bytes(target, 5), np.uint8).reshape(-1, 5)], axis=1)
    return [(part, out[at].tobytes()) for part, at in by_part((target % np.uint64(doc_parts)).astype(np.int64))] if len(out) else []


# -- pieces of text and their families -------------------------------------------------------

ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("row", "<u8"), ("start", "<u4"), ("size", "<u4")])
SPAN = np.dtype([("row", "<u8"), ("begin", "<u4"), ("end", "<u4")])


def row_key(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (row * np.uint64(_MIX[0]) ^ anchor) * np.uint64(_MIX[1])


def shared_pieces(rows: np.ndarray, docs: np.ndarray, texts: list[bytes], answers: list[bytes], frequent: np.ndarray, twins: np.ndarray):
    """Pieces around shared anchors, equal ones of a part once, and spans settled on the way.

    ``twins`` are the rows whose whole text a smaller document has: all of it goes. Returns ``(entries, texts, spans)``. Of equal pieces under one anchor only those of the
    smallest document are passed on: the others repeat it, so their windows go.
    """
    known = np.zeros(0, np.uint64)
    if answers:
        packed = np.concatenate([np.frombuffer(b, np.uint8) for b in answers]).reshape(-1, 11)
        known = np.sort(row_key(from_low_bytes(packed[:, 6:].tobytes(), 5), from_low_bytes(packed[:, :6].tobytes(), 6)))
    found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    gone = np.isin(rows, twins)
    done = [(rows[k], 0, len(texts[k])) for k in np.flatnonzero(gone) if len(texts[k]) >= MATCH]
    texts = [b"" if g else t for g, t in zip(gone.tolist(), texts)]
    for first_doc, data, ends in pieces(texts):
        anchor, owner, start, size = anchor_runs(data, ends)
        if not len(anchor):
            continue
        h = short_hash(anchor)
        often = np.isin(h, frequent)
        key = row_key(rows[first_doc + owner] & np.uint64(_ROW_BITS), h)
        at = np.searchsorted(known, key)
        follow = often.copy()
        inside = at < len(known)
        follow[inside] |= known[at[inside]] == key[inside]
        raw, base = data.tobytes(), np.concatenate(([0], ends[:-1]))
        for k in np.flatnonzero(follow):
            who, s, n = first_doc + int(owner[k]), int(start[k]), int(size[k])
            place = s - int(base[owner[k]])
            if often[k]:
                for j in range(n):
                    window = raw[s + j : s + j + MATCH]
                    found.setdefault((xxhash.xxh64_intdigest(window), window), []).append((who, place + j, 1))
            else:
                found.setdefault((int(anchor[k]), raw[s : s + n + MATCH - 1]), []).append((who, place, n))
    entries, kept, spans = [], [], done
    for (anchor, text), places in found.items():
        least = min(docs[who] for who, _, _ in places)
        for who, place, n in places:
            if docs[who] == least:
                entries.append((anchor, docs[who], rows[who], place, n))
                kept.append(text)
            else:
                spans.append((rows[who], place, place + n + MATCH - 1))
    return np.array(entries, ENTRY), kept, np.array(spans, SPAN)


def pack_pieces(entries: np.ndarray, texts: list[bytes]) -> bytes:
    return zstandard.compress(len(entries).to_bytes(8, "little") + entries.tobytes() + b"".join(texts), 1)


def unpack_pieces(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.decompress(blob)
    n = int.from_bytes(data[:8], "little")
    entries = np.frombuffer(data, ENTRY, n, 8)
    ends = 8 + n * ENTRY.itemsize + np.cumsum(entries["size"].astype(np.int64) + MATCH - 1)
    starts = np.concatenate(([8 + n * ENTRY.itemsize], ends[:-1])) if n else ends
    return entries, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def least_documents(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each piece and window in it the smallest document with that window.

    One suffix array a shard of about ``SHARD_BYTES``; more shards are merged: the sorted
    windows of all shards together are searched for those of each.
    """
    shards, at = [], 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= SHARD_BYTES):
            held += len(texts[stop])
            stop += 1
        shards.append((at, stop))
        at = stop
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    tables = []
    for a, b in shards:
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        lengths = np.array([len(t) for t in texts[a:b]], np.int64)
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(b - a), lengths)
        order = suffix_array(data, MATCH)
        group = np.cumsum(common_prefixes(data, order, starts, lengths, MATCH) < MATCH)
        whole = order - starts[owner[order]] + MATCH <= lengths[owner[order]]
        order, group = order[whole], group[whole]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[a:b][owner[order]], heads)
        tables.append((data, order, heads, least, np.cumsum(new) - 1, starts, lengths))
    if len(tables) > 1:
        windows = [np.lib.stride_tricks.sliding_window_view(d, MATCH)[o[h]].copy().view(f"S{MATCH}").ravel() for d, o, h, *_ in tables]
        every, docs_of = np.concatenate(windows), np.concatenate([t[3] for t in tables])
        by = np.argsort(every, kind="stable")
        every, docs_of = every[by], docs_of[by]
        heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        every, docs_of = every[heads], np.minimum.reduceat(docs_of, heads)
        merged = [docs_of[np.searchsorted(every, w)] for w in windows]
    else:
        merged = [t[3] for t in tables]
    for (a, b), (data, order, _, _, group, starts, lengths), least in zip(shards, tables, merged):
        at_place = np.zeros(len(data), np.int64)
        at_place[order] = least[group]
        for k in range(b - a):
            out[a + k] = at_place[starts[k] : starts[k] + lengths[k] - MATCH + 1]
    return out


def repeated_spans(blobs: list[bytes]) -> np.ndarray:
    """Spans covered by windows that a smaller document holds, for the pieces of one family."""
    if not blobs:
        return np.zeros(0, SPAN)
    # Equal pieces under one anchor enter the suffix arrays once, with their smallest document.
    distinct: dict[tuple[int, bytes], list[tuple]] = {}
    for blob in blobs:
        entries, texts = unpack_pieces(blob)
        for e, text in zip(entries.tolist(), texts):
            distinct.setdefault((e[0], text), []).append(e)
    by_anchor: dict[int, list[bytes]] = {}
    for anchor, text in distinct:
        by_anchor.setdefault(anchor, []).append(text)
    spans = []

    def settle(todo: list[tuple[int, bytes]], least: list[np.ndarray]) -> None:
        for key, low in zip(todo, least):
            lowest, highest = int(low.min()), int(low.max())
            for _, doc, row, start, size in distinct[key]:
                if doc <= lowest:
                    continue
                if doc > highest:
                    spans.append((row, start, start + size + MATCH - 1))
                    continue
                goes = np.flatnonzero(low < doc)
                cuts = np.flatnonzero(np.diff(goes) > 1)
                for x, y in zip(goes[np.append(0, cuts + 1)].tolist(), goes[np.append(cuts, len(goes) - 1)].tolist()):
                    spans.append((row, start + x, start + y + MATCH))

    todo: list[tuple[int, bytes]] = []
    held = 0
    for anchor, texts in by_anchor.items():
        keys = [(anchor, t) for t in texts]
        if len(texts) == 1:
            held_by = distinct[keys[0]]
            low = min(e[1] for e in held_by)
            spans += [(row, start, start + size + MATCH - 1) for _, doc, row, start, size in held_by if doc > low]
            continue
        size = sum(map(len, texts))
        if todo and held + size > SHARD_BYTES:
            settle(todo, least_documents([t for _, t in todo], np.array([min(e[1] for e in distinct[k]) for k in todo], np.int64)))
            todo, held = [], 0
        todo += keys
        held += size
    if todo:
        settle(todo, least_documents([t for _, t in todo], np.array([min(e[1] for e in distinct[k]) for k in todo], np.int64)))
    return np.array(spans, SPAN)


# -- the operator ----------------------------------------------------------------------------


def union_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def _parts(docs: DataFrame) -> tuple[int, int]:
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    return max(parallelism(docs.sparkSession), -(-(size or 0) // PART_BYTES)), rows


def _frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Anchors in many of about ``PROBE_ROWS`` documents: a choice of route, which no result depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for _, data, ends in pieces(texts):
                anchor, owner, _, _ = anchor_runs(data, ends)
                pairs = np.unique(np.stack([short_hash(anchor).astype(np.int64), owner]), axis=1)
                found, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["h", "n"])

    every = max(1, rows // PROBE_ROWS)
    probe = docs.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text")
    least = max(8, int(FREQUENT_SHARE * min(rows, PROBE_ROWS)))
    found = probe.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept_bytes, n_bytes, n_removed, n_spans`` added to its columns.

    With ``as_text`` the first is ``kept_text``, a string without the bytes of characters
    that were cut in two.

    Texts count as UTF-8 bytes. A byte goes when a string of ``MATCH`` bytes that covers it
    starts in a document with a smaller id too, judged on the texts as they came in; what is
    left is joined in ``kept_bytes``.

    Null text: empty. Null id: larger than any id. Rows that share an id are one document
    to each other: nothing of them goes on each other's account. Empty table: empty result.
    Columns of any other name pass through.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = [f"c{k}" for k in range(len(docs.columns))]
    row = docs.toDF(*own)
    doc_c, text_c = own[docs.columns.index(id_col)], own[docs.columns.index(text_col)]
    base = row.withColumns({"doc": F.coalesce(F.col(doc_c).cast("long"), F.lit(NULL_ID)), "text": F.coalesce(F.col(text_c).cast("string"), F.lit(""))})
    base = base.withColumns({"row": F.xxhash64("doc", "text"), "th": F.xxhash64("text")}).drop(text_c)
    parts, rows = _parts(base.select("text"))
    frequent = _frequent(base.select("row", "text"), rows)
    often = spark.sparkContext.broadcast(frequent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("th").to_numpy().view(np.uint64)
            for first_doc, data, ends in pieces(texts):
                anchor, owner, _, _ = anchor_runs(data, ends)
                if not len(anchor):
                    continue
                h, who = short_hash(anchor), ids[first_doc + owner] & np.uint64(_ROW_BITS)
                new = np.lexsort((who, h))
                new = new[np.concatenate(([True], (h[new][1:] != h[new][:-1]) | (who[new][1:] != who[new][:-1])))]
                new = new[~np.isin(h[new], often.value)]
                if not len(new):
                    continue
                packed = np.concatenate([np.frombuffer(low_bytes(h[new], 6), np.uint8).reshape(-1, 6), np.frombuffer(low_bytes(who[new], 5), np.uint8).reshape(-1, 5)], axis=1)
                out = [(p, packed[at].tobytes()) for p, at in by_part(part_of(anchor[new], parts))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["part", "blob"])

    def answer(group: pa.Table) -> pa.Table:
        out = list(held_by_several(group.column("blob").to_pylist(), parts))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})

    def part_by(c: str):
        return F.pmod(F.col(c).bitwiseAND(F.lit(_ROW_BITS)), F.lit(parts)).cast("long")

    # Anchors are asked for by text, so copies of a whole text do not make its anchors shared;
    # the answer goes to the row with the smallest id, and its copies are settled at once.
    told = base.select("th", "text").mapInArrow(ask, "part long, blob binary").groupBy("part").applyInArrow(answer, "part long, blob binary")
    named = base.select(F.md5(F.col("text").cast("binary")).alias("md"), "th", "row", "doc")
    firsts = named.groupBy("md", "th").agg(F.min(F.struct("doc", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    keepers = firsts.select(part_by("th").alias("part"), "th", F.col("first.row").alias("row"))

    def readdress(left: pa.Table, right: pa.Table) -> pa.Table:
        out = address(left.column("th").to_numpy().view(np.uint64), left.column("row").to_numpy().view(np.uint64), right.column("blob").to_pylist(), parts)
        return pa.table({"doc_part": pa.array([p for p, _ in out], pa.int64()), "kind": pa.array([0] * len(out), pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    answers = keepers.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(readdress, "doc_part long, kind int, blob binary")
    copies = named.join(firsts.where("n > 1").select("md", F.col("first.doc").alias("least")), "md").where("doc > least")
    copies = copies.select(part_by("row").alias("doc_part"), F.lit(1).alias("kind"), F.unhex(F.lpad(F.hex("row"), 16, "0")).alias("blob"))
    answers = answers.union(copies)
    dealt = base.drop("th").withColumn("doc_part", part_by("row"))
    dealt = dealt.repartition(max(parallelism(spark), 1), "doc_part")

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows:
            ids = left.column("row").to_numpy().view(np.uint64)
            texts = [t.encode() for t in left.column("text").to_pylist()]
            kinds, blobs = right.column("kind").to_pylist(), right.column("blob").to_pylist()
            twins = np.sort(np.frombuffer(b"".join(b for k, b in zip(kinds, blobs) if k == 1), ">u8").astype(np.uint64))
            entries, kept, spans = shared_pieces(ids, left.column("doc").to_numpy(), texts, [b for k, b in zip(kinds, blobs) if k == 0], often.value, twins)
            if len(entries):
                for p, at in by_part(part_of(entries["anchor"], parts)):
                    out.append((p, 0, pack_pieces(entries[at], [kept[k] for k in at])))
            if len(spans):
                out.append((int(left.column("doc_part")[0].as_py()), 1, spans.tobytes()))
        return pa.table({"family": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})

    pieces_ = dealt.groupBy("doc_part").cogroup(answers.groupBy("doc_part")).applyInArrow(collect, "family long, kind int, blob binary")

    def match(group: pa.Table) -> pa.Table:
        kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
        settled = [np.frombuffer(b, SPAN) for k, b in zip(kinds, blobs) if k == 1]
        spans = np.concatenate([repeated_spans([b for k, b in zip(kinds, blobs) if k == 0]), *settled])
        out = [(p, spans[at].tobytes()) for p, at in by_part(((spans["row"] & np.uint64(_ROW_BITS)) % np.uint64(parts)).astype(np.int64))] if len(spans) else []
        return pa.table({"doc_part": pa.array([p for p, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})

    spans_ = pieces_.groupBy("family").applyInArrow(match, "doc_part long, blob binary")
    through = [c for c in own if c != text_c]
    kept_name = "kept_text" if as_text else "kept_bytes"
    schema = T.StructType([*(f for f in row.schema.fields if f.name != text_c), *(T.StructField(n, t) for n, t in (("text", T.StringType()), (kept_name, T.StringType() if as_text else T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())))])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = right.column("blob").to_pylist()
        spans = np.concatenate([np.frombuffer(b, SPAN) for b in blobs]) if blobs else np.zeros(0, SPAN)
        spans = spans[np.argsort(spans["row"], kind="stable")]
        ids = left.column("row").to_numpy().view(np.uint64)
        lo, hi = np.searchsorted(spans["row"], ids, "left"), np.searchsorted(spans["row"], ids, "right")
        kept, n_bytes, removed, runs = [], [], [], []
        for text, a, b in zip(left.column("text").to_pylist(), lo, hi):
            data = text.encode()
            n_bytes.append(len(data))
            if a < b:
                begin, end = union_spans(spans["begin"][a:b].astype(np.int64), spans["end"][a:b].astype(np.int64))
                runs.append(len(begin))
                removed.append(int((end - begin).sum()))
                data = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            else:
                runs.append(0)
                removed.append(0)
            kept.append(data.decode("utf-8", "ignore") if as_text else data)
        added = [left.column("text"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
        return pa.table([*(left.column(c) for c in through), *added], names=[*through, "text", kept_name, "n_bytes", "n_removed", "n_spans"])

    out = dealt.groupBy("doc_part").cogroup(spans_.groupBy("doc_part")).applyInArrow(cut, schema)
    names = {c: n for c, n in zip(own, docs.columns)}
    return out.select(*(F.col("text" if c == text_c else c).alias(names[c]) for c in own), kept_name, "n_bytes", "n_removed", "n_spans")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return remove_repeats(narrow).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]]) -> list[tuple[int, int, int, int, str]]:
    """The result by its definition, for small inputs in tests."""
    first: dict[bytes, int] = {}
    for doc, text in docs:
        data = text.encode()
        for k in range(len(data) - MATCH + 1):
            w = data[k : k + MATCH]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - MATCH + 1):
            if first[data[k : k + MATCH]] < doc:
                gone[k : k + MATCH] = b"\1" * MATCH
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out
