"""Suffix arrays of a shard of byte strings, in numpy: refinement by ranks, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for i in range(min(8, len(data))):
        out[i::8] = padded[i : i + 8 * len(out[i::8])].view(np.uint64)
    return out


def sorted_to_depth(words: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement: places with ``left`` >= depth bytes to their string's end whose first ``depth``
    bytes another such place has too, in suffix order, and their ranks. Places alone in their group drop out early.

    Ranks are the first place of a group in the order. A round makes them good to twice or three times the depth by the
    ranks of the places that follow; a place too near its end for that depth keeps a stale rank, which no later round
    asks for.
    """
    n = len(words)
    bits = max(1, n.bit_length())
    places = np.flatnonzero(left >= min(8, depth)).astype(np.int32 if n < 1 << 31 else np.int64)
    key = words[places].byteswap()
    if depth < 8:
        key >>= np.uint64(8 * (8 - depth))
    ranks = np.zeros(n + 1, places.dtype)
    reached, base = min(8, depth), np.zeros(len(places), places.dtype)
    while True:
        order = np.argsort(key)
        places, key, base = places[order], key[order], base[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(key)))
        # the rank of the old group, and the number of its places before this group
        heads = base[starts]
        old = np.concatenate([[True], heads[1:] != heads[:-1]]) if len(key) else first
        old_start = starts[np.flatnonzero(old)[np.cumsum(old) - 1]] if len(key) else starts
        found = np.repeat((heads + starts - old_start).astype(places.dtype), sizes)
        ranks[places] = found
        several = np.repeat(sizes > 1, sizes)
        places, base = places[several], found[several]
        if reached == depth:
            return places.astype(np.int64), base.astype(np.int64)
        steps = [reached, 2 * reached] if 3 * reached <= depth and 3 * bits <= 63 else [min(reached, depth - reached)]
        reached += steps[-1] if len(steps) == 1 else 2 * reached
        far = left[places] >= reached
        places, base = places[far], base[far]
        key = base.astype(np.int64)
        for step in steps:
            key = key << bits | ranks[places + np.int32(step)]


def common_prefixes(words: np.ndarray, left: np.ndarray, places: np.ndarray, before: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Kasai's recurrence: bytes that the strings from ``places`` and from ``before`` share, up to the nearer end.

    In text order, where a pair follows the pair one place earlier, it shares one byte less. Only the other pairs are
    compared, all at once, eight bytes at a time, from the bytes that are ``known`` to be shared.
    """
    order = np.argsort(places)
    p, q = places[order], before[order]
    head = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q) != 1)]) if len(p) else np.empty(0, bool)
    at, other = p[head], q[head]
    most = np.minimum(left[at], left[other])
    shared = np.zeros(len(at), np.int64) if known is None else np.minimum(known[order][head], most)
    open_ = np.flatnonzero(shared < most)
    while len(open_):
        differ = words[at[open_] + shared[open_]] ^ words[other[open_] + shared[open_]]
        same = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        shared[open_] += np.where(same, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
        open_ = open_[same]
        open_ = open_[shared[open_] < most[open_]]
    shared = np.minimum(shared, most)
    out = np.empty(len(p), np.int64)
    since = np.flatnonzero(head)[np.cumsum(head) - 1] if len(p) else np.empty(0, np.int64)
    out[order] = shared[np.cumsum(head) - 1] - (np.arange(len(p)) - since)
    return out


def repeated_classes(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every place whose first ``depth`` bytes stand at another place too."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))
    words = words_at(data)
    places, ranks = sorted_to_depth(words, left, depth)
    if not len(places):
        none = np.empty(0, np.int64)
        return none, none, none
    shared = common_prefixes(words, left, places[1:], places[:-1], np.where(ranks[1:] == ranks[:-1], depth, 0))
    classes = np.cumsum(np.concatenate([[0], shared < depth]))
    owner = np.searchsorted(ends, places, side="right")
    return owner, places - (ends - lengths)[owner], classes
