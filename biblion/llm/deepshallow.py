"""Deep-shallow sorting of fixed-width strings, with the LCP of neighbours.

``order_with_lcp`` sorts the rows of a byte matrix: a multikey quicksort (ternary partition by
one eight-byte character at a time, all segments of a round in one numpy pass) orders them to a
shallow depth; groups that still agree there (long common prefixes) are ordered by a blind
trie, which looks at single branching bytes only and compares one full string per insertion.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

SHALLOW_BYTES = 48


def _characters(rows: np.ndarray) -> np.ndarray:
    """Rows as big-endian eight-byte characters, zero padded."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


class BlindTrie:
    """A Patricia trie over ``strings``: inner nodes are [skip, {byte: child}], leaves are lists of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, [0]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        new, path, node = self.strings[i], [], self.root
        while isinstance(node[-1], dict):  # blind descent: any leaf below shares the inspected bytes
            path.append(node)
            node = node[1].get(new[node[0]]) or next(iter(node[1].values()))
        old = self.strings[node[0]]
        if new == old:
            node.append(i)
            return
        at = int(np.argmax(np.frombuffer(new, np.uint8) != np.frombuffer(old, np.uint8)))
        parent = None
        for inner in path:
            if inner[0] >= at:
                break
            parent = inner
        if parent is None:
            top = self.root
        else:
            top = parent[1].get(new[parent[0]])
            if top is None:
                parent[1][new[parent[0]]] = [i]
                return
        if isinstance(top[-1], dict) and top[0] == at:
            top[1][new[at]] = [i]
            return
        fork: list = [at, {old[at]: top, new[at]: [i]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][new[parent[0]]] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the LCP of each with the one before (the first: 0)."""
        width = len(self.strings[0])
        out, lcp = [], []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node[-1], dict):
                children = sorted(node[1].items(), reverse=True)
                stack.extend((child, node[0]) for _, child in children[:-1])
                stack.append((children[-1][1], shared))
            else:
                out.extend(node)
                lcp.extend([shared] + [width] * (len(node) - 1))
        return out, lcp


def multikey_quicksort(chars: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rows by group, then by their first ``depth`` characters.

    ``group`` is ascending. A round partitions every unfinished segment into the rows whose
    character is less than, equal to or greater than its pivot, the median of three; the
    equal ones go on with the next character.
    """
    order = np.arange(len(chars))
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, size, at = cuts[:-1], np.diff(cuts), np.zeros(len(cuts) - 1, np.int64)
    while True:
        open_ = (size > 1) & (at < depth)
        lo, size, at = lo[open_], size[open_], at[open_]
        if not len(lo):
            return order
        place = ranges(lo, size)
        segment = np.repeat(np.arange(len(lo)), size)
        key = chars[order[place], at[segment]]
        begin = np.cumsum(size) - size
        three = np.sort(key[np.stack((begin, begin + size // 2, begin + size - 1))], axis=0)
        pivot = three[1][segment]
        side = segment * 3 + (key >= pivot) + (key > pivot)
        order[place] = order[place[np.argsort(side, kind="stable")]]
        size = np.bincount(side, minlength=3 * len(lo))
        at = np.repeat(at, 3) + np.tile([0, 1, 0], len(lo))
        lo = np.repeat(lo, 3) + size.reshape(-1, 3).cumsum(1).reshape(-1) - size


def order_with_lcp(rows: np.ndarray, shallow: int = SHALLOW_BYTES, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the byte rows, and each row's LCP with its predecessor in that order.

    With ``group`` (ascending numbers) rows are sorted within their groups; a group's first row has LCP -1.
    """
    n, width = rows.shape
    group = np.zeros(n, np.int64) if group is None else group
    lcp = np.zeros(n, np.int64)
    if n < 2 or not width:
        lcp[np.flatnonzero(group[1:] != group[:-1]) + 1] = -1
        return np.arange(n), lcp
    chars = _characters(rows)
    depth = min(chars.shape[1], -(-shallow // 8))
    order = multikey_quicksort(chars, group, depth)
    one, two = chars[order[1:], :depth], chars[order[:-1], :depth]
    differ = one != two
    first = np.argmax(differ, axis=1)
    pick = np.arange(n - 1)
    byte = (one[pick, first] ^ two[pick, first]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    lcp[1:] = np.minimum(first * 8 + np.argmax(byte, axis=1), width)
    border = group[order[1:]] != group[order[:-1]]
    lcp[1:][border] = -1
    tied = ~differ.any(axis=1) & ~border  # with the row before
    cuts = np.flatnonzero(np.diff(np.concatenate(([False], tied, [False])).astype(np.int8)))
    for lo, hi in zip(cuts[0::2].tolist(), (cuts[1::2] + 1).tolist(), strict=True):
        members = order[lo:hi]
        found, shared = BlindTrie([rows[m].tobytes() for m in members.tolist()]).ordered()
        order[lo:hi] = members[found]
        lcp[lo + 1 : hi] = shared[1:]
    return order, lcp


def classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the id of its class of rows that agree in the first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out
