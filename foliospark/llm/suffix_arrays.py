"""Suffix arrays of small shards in numpy, to a bounded depth."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes.

    Larsson-Sadakane refinement: suffixes start in the order of eight bytes; each round
    doubles the depth by sorting only the groups that are still tied, by the rank of the
    suffix that many places on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    held = key[order]
    head = np.concatenate(([True], held[1:] != held[:-1]))
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = first
    reach = 8
    while reach < depth:
        tied = ~head | np.concatenate((~head[1:], [False]))
        places = np.flatnonzero(tied)
        if not len(places):
            break
        who = order[places]
        after = rank[np.minimum(who + reach, n)]
        by = np.lexsort((after, rank[who]))
        who, after, before = who[by], after[by], rank[who[by]]
        order[places] = who
        head[places] = np.concatenate(([True], (before[1:] != before[:-1]) | (after[1:] != after[:-1])))
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = first
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in ``order`` the bytes, up to ``depth``, shared with the one before it.

    Kasai's recurrence (the next suffix of a text shares at least one byte less with its own
    predecessor), run in step over the pieces ``text[starts : starts + lengths]`` that make
    up the text. Where the array is sorted less deep than two suffixes agree, their next
    ones may have changed places; such suffixes start from nothing again.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(n + 1, n, np.int64)
    place[order] = np.arange(n)
    shared = np.zeros(n, np.int64)
    now, last = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[by_length], -np.arange(int(lengths.max(initial=0))), side="left")
    for step, many in enumerate(alive.tolist()):
        live = by_length[:many]
        at = starts[live] + step
        other = before[at]
        holds = (last[live] >= 0) & (place[last[live] + 1] < place[at])
        have = np.where(holds, np.maximum(now[live] - 1, 0), 0)
        open_ = np.flatnonzero((other >= 0) & (have < depth))
        while len(open_):
            same = padded[at[open_] + have[open_]] == padded[other[open_] + have[open_]]
            open_ = open_[same]
            have[open_] += 1
            open_ = open_[have[open_] < depth]
        now[live], last[live] = have, other
        shared[at] = have
    return shared[order]
