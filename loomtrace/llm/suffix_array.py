"""Enhanced suffix arrays in memory: sorting, common prefixes, and the interval tree of maximal repeats.

A text of up to ``MAX_BYTES`` is a concatenation of contexts. Suffixes are sorted by prefix doubling; a suffix that
is already unique is not sorted again. Common prefixes of neighbours follow from the ranks of every doubling step. A
stack scan over them yields the intervals of suffixes that share a prefix (the nodes of the interval tree); an interval whose suffixes are
preceded by differing bytes is a maximal repeat, and all its suffixes are the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Positions are packed into 20 bits of a sort key.
MAX_BYTES = (1 << 20) - 1024
_BITS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
_PAD = 512


def suffix_ranks(text: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(order, ranks): all suffixes that may share ``least`` bytes with another one, in the order of their first ``depth``
    bytes; and the rank of every position at each step."""
    n = len(text)
    b = np.concatenate([text, np.zeros(_PAD, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | b[k : n + k]
    key = np.sort((key << _BITS) | np.arange(n, dtype=np.uint64))
    order = (key & _LOW).astype(np.int64)
    new = np.r_[True, (key[1:] >> _BITS) != (key[:-1] >> _BITS)] if n else np.zeros(0, bool)
    rank = np.zeros(n + _PAD, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n:] = -1
    ranks, d = {5: rank}, 5
    active = order[~(new & np.r_[new[1:], True])] if n and least >= 5 else order
    kept = active
    while d < depth and len(active):
        high = rank[active].astype(np.uint64)
        second = (rank[np.minimum(active + d, n + _PAD - 1)] + 1).astype(np.uint64)
        key = np.sort((high << np.uint64(41)) | (second << _BITS) | active.astype(np.uint64))
        order = (key & _LOW).astype(np.int64)
        at = np.arange(len(key))
        new = np.r_[True, (key[1:] >> _BITS) != (key[:-1] >> _BITS)]
        new_high = np.r_[True, (key[1:] >> np.uint64(41)) != (key[:-1] >> np.uint64(41))]
        rank = rank.copy()
        rank[order] = (key >> np.uint64(41)).astype(np.int64) + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_high, at, 0))
        d *= 2
        ranks[d] = rank
        active = order[~(new & np.r_[new[1:], True])]
        kept = active if d <= least else kept
    return kept[np.argsort(rank[kept], kind="stable")], ranks


def common_prefixes(text: np.ndarray, order: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it; 0 for the first."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    i, j = order[:-1], order[1:]
    n = len(text)
    length = np.zeros(len(i), np.int64)
    for d in sorted(ranks, reverse=True):
        r = ranks[d]
        a, b = np.minimum(i + length, n), np.minimum(j + length, n)
        length += np.where((r[a] == r[b]) & (a < n) & (b < n), d, 0)
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    alive = np.ones(len(i), bool)
    for _ in range(4):
        a, b = np.minimum(i + length, n), np.minimum(j + length, n)
        alive &= (padded[a] == padded[b]) & (a < n) & (b < n)
        length += alive
    return np.r_[0, length]


def intervals(shared: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, from, to) of the common-prefix intervals of at least ``least`` bytes, children before parents; ``to`` is
    exclusive. ``shared[k]`` is the common prefix of suffix k and the one before."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(shared) + 1):
        here = shared[k] if k < len(shared) else 0
        left = k - 1
        while stack and stack[-1][0] > here:
            length, left = stack.pop()
            yield length, left, k
        if here >= least and (not stack or stack[-1][0] < here):
            stack.append((here, left))


def maximal_repeats(contexts: list[bytes], least: int, depth: int = 640) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, contexts, offsets) of the maximal repeats of at least ``least`` bytes within the contexts; an occurrence
    nearer to its context's end than the length is common to the context's end only."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    if len(text) > MAX_BYTES:
        raise ValueError(f"contexts of {len(text)} bytes do not fit one suffix array")
    lengths = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(lengths)
    order, ranks = suffix_ranks(text, least, depth)
    owner = np.searchsorted(ends, order, side="right")
    room = ends[owner] - order
    fit = room >= least
    if not fit.any():
        return
    # Common prefixes of the suffixes with room follow from those of all: the least over what lies between.
    shared = common_prefixes(text, order, ranks)
    kept = np.flatnonzero(fit)
    shared = np.minimum.reduceat(shared[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
    order, owner, room = order[kept], owner[kept], room[kept]
    shared[0] = 0
    offset = order - (ends - lengths)[owner]
    before = np.where(offset > 0, text[np.maximum(order - 1, 0)].astype(np.int64), -1 - np.arange(len(order)))
    # Families of suffixes that share ``least`` bytes; those with one byte before all of them are parts of longer repeats.
    starts = np.flatnonzero(shared < least)
    low, high = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
    stops = np.r_[starts[1:], len(order)]
    for a, z in zip(starts[(low != high) & (stops - starts > 1)].tolist(), stops[(low != high) & (stops - starts > 1)].tolist()):
        part = shared[a:z].tolist()
        part[0] = 0
        for length, x, y in intervals(part, least):
            left = before[a + x : a + y]
            if left.min() != left.max():
                yield length, owner[a + x : a + y], offset[a + x : a + y]
