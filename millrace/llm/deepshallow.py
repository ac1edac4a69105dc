"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what is still equal there.

Strings are short pieces of text around a position, so they sort like the suffixes there. Besides the order comes
the length of the prefix that neighbours share: cutting the order where it is below d gives the classes of
strings that have the first d bytes in common. A string that ends sorts before those that go on.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort compares, eight at a time.
SHALLOW = 32
END = -1


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


class _Node:
    """A branch of a blind trie: the depth at which strings differ, and what follows by the byte there; what lies between is not kept."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int, below: dict):
        self.depth, self.below = depth, below


def blind_trie(strings: list[bytes], own: list[int]) -> tuple[list[int], list[int]]:
    """The numbers `own` in the order of their strings, and what each shares with the one before (0 for the first)."""
    top: _Node | list[int] = [own[0]]  # leaves are lists of equal strings
    for k in own[1:]:
        s = strings[k]
        n, at = len(s), top
        while type(at) is _Node:  # blindly: only the bytes at branches are compared
            nearest = at.below.get(s[at.depth] if at.depth < n else END)
            at = nearest if nearest is not None else next(iter(at.below.values()))
        other = strings[at[0]]
        if other == s:
            at.append(k)
            continue
        d = common(s, other)
        above, at = None, top
        while type(at) is _Node and at.depth < d:
            above, at = at, at.below[s[at.depth]]
        sign = s[d] if d < n else END
        if type(at) is _Node and at.depth == d:
            at.below[sign] = [k]
            continue
        fresh = _Node(d, {other[d] if d < len(other) else END: at, sign: [k]})
        if above is None:
            top = fresh
        else:
            above.below[s[above.depth]] = fresh
    order: list[int] = []
    shared: list[int] = []
    todo = [(top, 0)]
    while todo:
        at, before = todo.pop()
        if type(at) is _Node:
            parts = sorted(at.below.items())
            todo += [(x, at.depth) for _, x in parts[:0:-1]]
            todo.append((parts[0][1], before))
        else:
            order += at
            shared += [before] + [len(strings[at[0]])] * (len(at) - 1)
    return order, shared


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings in the order of their group, then of their bytes; shared[i] is the common prefix of order[i - 1] and order[i], -1 between groups."""
    m = len(strings)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(m, -1).astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    segment = np.cumsum(np.r_[False, groups[order][1:] != groups[order][:-1]])
    for w in range(words.shape[1]):  # each pass sorts what is still equal by the next eight bytes
        size = np.bincount(segment)
        open_ = np.flatnonzero(size[segment] > 1)
        if not len(open_):
            break
        own = order[open_]
        key, part = words[own, w], segment[open_]
        by = np.lexsort((key, part))
        order[open_] = own[by]
        starts = np.zeros(m, bool)
        starts[1:] = segment[1:] != segment[:-1]
        key = key[by]
        starts[open_[1:]] |= (key[1:] != key[:-1]) & (part[1:] == part[:-1])
        segment = np.cumsum(starts)
    shared = np.full(m, -2, np.int64)
    size = np.bincount(segment)
    first = np.r_[0, np.cumsum(size)]
    for k in np.flatnonzero(size > 1).tolist():
        a, b = first[k], first[k + 1]
        order[a:b], shared[a:b] = blind_trie(strings, order[a:b].tolist())
        shared[a] = -2
    edge = np.flatnonzero(shared == -2)
    of = groups[order]
    inner = edge[1:][of[edge[1:]] == of[edge[1:] - 1]]
    shared[edge] = -1
    listed = order.tolist()
    for i in inner.tolist():
        shared[i] = common(strings[listed[i - 1]], strings[listed[i]])
    return order, shared


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each string the number of its class: strings of a group that have the first `depth` bytes in common (shorter strings stand alone or with their like)."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out
