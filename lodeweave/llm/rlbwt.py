"""A run-length index of texts: the suffix order, the runs of its Burrows-Wheeler transform, samples at the run ends.

Within a run the common prefix of a suffix with its neighbour in the suffix order follows from that of the suffix one
place to the left, less one.  So only the run ends need comparisons; second_matches() streams over the text and derives
the matching statistics of all other places from the nearest sample to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols of nine bits (byte + 1, 0 ends a text) that a 64-bit key has room for.
_PACK = 7
#: Suffixes that are told apart at once; what that needs besides the index has this bound, or that of the largest group.
_SORTED = 1 << 20


@dataclass
class RunIndex:
    """symbols of the texts, each ended by a 0; order: the suffix array; runs begin at the places of `heads`."""

    symbols: np.ndarray
    left: np.ndarray  # bytes from here to the text's end
    keys: np.ndarray
    order: np.ndarray
    heads: np.ndarray

    @property
    def tails(self) -> np.ndarray:
        return np.append(self.heads[1:] - 1, len(self.order) - 1)


def _keys(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    n = len(left)
    keys = np.zeros(n, np.uint64)
    for k in range(_PACK):
        part = symbols[k : k + n].astype(np.uint64)
        part[left < k] = 0  # what follows the end is another text's: left out
        part <<= np.uint64(9 * (_PACK - 1 - k))
        keys |= part
    return keys


def _refined(rank: np.ndarray, active: np.ndarray, step: int) -> np.ndarray:
    """Ranks of whole groups of equal rank are told apart by the ranks `step` places on; those that aren't alone yet, in order."""
    first = rank[active]
    both = first.astype(np.int64) * len(rank) + rank[active + step]
    by = np.argsort(both, kind="stable")
    active, both, first = active[by], both[by], first[by]
    m = len(active)
    new = np.ones(m, bool)
    new[1:] = both[1:] != both[:-1]
    group = np.ones(m, bool)
    group[1:] = first[1:] != first[:-1]
    at = np.arange(m, dtype=np.int32)
    rank[active] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    return active[~(new & np.append(new[1:], True))]


def _suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Prefix doubling from packed keys; suffixes that meet their text's end differ from all others.

    Groups are told apart some at a time.  A later group may see ranks that an earlier one just got: they only say more.
    """
    n = len(left)
    keys = _keys(symbols, left)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (left[order[1:]] < _PACK)
    del keys
    start = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = start
    del start
    active = order[~(new & np.append(new[1:], True))]
    del order, new
    step = _PACK
    while len(active):
        # cut where a group begins
        changes = np.flatnonzero(np.diff(rank[active])) + 1
        cuts = np.unique(changes[np.searchsorted(changes, np.arange(_SORTED, len(active), _SORTED)).clip(max=max(len(changes) - 1, 0))]) if len(changes) else []
        active = np.concatenate([_refined(rank, part, step) for part in np.split(active, cuts)])
        step *= 2
    out = np.empty(n, np.int32)
    out[rank] = np.arange(n, dtype=np.int32)
    return out


def build(texts: list[bytes]) -> RunIndex:
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum()) + len(texts)
    stops = (np.cumsum(lengths + 1) - 1).astype(np.int32)
    symbols = np.zeros(n + _PACK, np.uint16)
    inside = np.ones(n, bool)
    inside[stops] = False
    symbols[:n][inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + np.uint16(1)
    left = np.repeat(stops, lengths + 1) - np.arange(n, dtype=np.int32)
    order = _suffix_order(symbols, left)
    before = symbols[order - 1]
    before[order == 0] = 0
    heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])).astype(np.int32)
    return RunIndex(symbols[:n], left, _keys(symbols, left), order, heads)


def _common(index: RunIndex, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes, compared key by key."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    x, y = a.copy(), b.copy()
    while len(live):
        differ = index.keys[x] ^ index.keys[y]
        ended = (index.left[x] < _PACK) | (index.left[y] < _PACK)
        stop = (differ != 0) | ended
        if stop.any():
            d = differ[stop]
            top = np.where(d == 0, -1, np.log2(np.maximum(d, 1).astype(np.float64)).astype(np.int64))
            # log2 may round up to the next power of two
            top = np.where((d != 0) & (np.left_shift(np.uint64(1), np.maximum(top, 0).astype(np.uint64)) > d), top - 1, top)
            same = np.where(d == 0, _PACK, _PACK - 1 - top // 9)
            out[live[stop]] += np.minimum(same, np.minimum(index.left[x[stop]], index.left[y[stop]]))
        go = ~stop
        live, x, y = live[go], x[go] + _PACK, y[go] + _PACK
        out[live] += _PACK
    return out


def matching_statistics(index: RunIndex) -> np.ndarray:
    """For each place the length of its longest match that begins at another place; matches stay within texts."""
    n = len(index.order)
    best, places = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    for ends, step in ((index.heads, -1), (index.tails, 1)):
        some = ends[(ends + step >= 0) & (ends + step < n)]
        sample = np.full(n, -1, np.int32)
        sample[index.order[ends]] = 0
        sample[index.order[some]] = _common(index, index.order[some], index.order[some + step])
        at = np.maximum.accumulate(np.where(sample >= 0, places, np.int32(-1)))
        best = np.maximum(best, np.where(at >= 0, sample[at] - (places - at), np.int32(0)))
    return best


def second_matches(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each text the joined stretches covered by strings of `least` bytes that begin at two places or more."""
    if not texts:
        return []
    index = build(texts)
    length = matching_statistics(index)
    begin = np.flatnonzero(length >= least)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    of = np.searchsorted(starts, begin, side="right") - 1
    for t in np.unique(of):
        low = begin[of == t]
        out[t] = joined(low - starts[t], low + length[low] - starts[t])
    return out


def joined(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, those that touch in one."""
    if not len(low):
        return []
    by = np.argsort(low, kind="stable")
    low, reach = low[by], np.maximum.accumulate(high[by])
    cut = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    return list(zip(low[cut].tolist(), reach[np.append(cut[1:] - 1, len(low) - 1)].tolist(), strict=True))
