"""Deep-shallow ordering of byte strings of bounded length, and their common prefixes.

The shallow part is a multikey quicksort: every group is parted by a pivot's next eight bytes into
less, equal and greater; the equal ones go on eight bytes deeper, down to the shallow depth. All
groups are parted in one step. Groups that are still equal there share a long prefix; a blind trie
(branching positions and bytes only, no labels) orders each of them.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Strings by the places where they part; a search compares one whole string at its end."""

    def __init__(self) -> None:
        self.root: list | None = None  # [place, {byte: node}] or [-1, string, its numbers]

    @staticmethod
    def _leaf(node: list) -> list:
        while node[0] >= 0:
            node = next(iter(node[1].values()))
        return node

    @staticmethod
    def _byte(text: bytes, place: int) -> int:
        return text[place] if place < len(text) else -1  # an end comes before all bytes

    def add(self, text: bytes, number: int) -> None:
        new = [-1, text, [number]]
        if self.root is None:
            self.root = new
            return
        node = self.root
        while node[0] >= 0 and (b := self._byte(text, node[0])) in node[1]:
            node = node[1][b]
        other = self._leaf(node)
        if other[1] == text:
            other[2].append(number)
            return
        n = min(len(other[1]), len(text))
        part = next((i for i in range(n) if other[1][i] != text[i]), n)
        above, node = None, self.root  # down again, to the edge that holds this place
        while 0 <= node[0] < part:
            above, node = node, node[1][self._byte(text, node[0])]
        if node[0] == part:
            node[1][self._byte(text, part)] = new
            return
        fork = [part, {self._byte(self._leaf(node)[1], part): node, self._byte(text, part): new}]
        if above is None:
            self.root = fork
        else:
            above[1][self._byte(text, above[0])] = fork

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group, then by their keys from left to right, and the classes of equal rows along it."""
    n, levels = keys.shape
    order = np.argsort(group, kind="stable")
    cls, depth = _classes(group[order]) - 1, np.zeros(n, np.int64)
    open_ = np.arange(n) if levels else np.zeros(0, np.int64)  # places in the order whose class may still be parted
    while len(open_):
        at, c, d = order[open_], cls[open_], depth[open_]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        size = np.diff(first, append=len(c))
        key = keys[at, d]
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (key > pivot).astype(np.int8) - (key < pivot)
        part = np.argsort(3 * np.repeat(np.arange(len(first)), size) + side, kind="stable")
        order[open_], side, d, c = at[part], side[part], d[part], c[part]
        fresh = np.diff(c, prepend=-1, append=-1) != 0
        fresh[1:-1] |= side[1:] != side[:-1]
        start = np.flatnonzero(fresh[:-1])
        of = np.cumsum(fresh[:-1]) - 1
        cls[open_] = open_[start][of]  # a class is named by its first place
        depth[open_] = d + (side == 0)
        more = (np.diff(start, append=len(c))[of] > 1) & (depth[open_] < levels)
        open_ = open_[more]
    return order, cls


def deep_shallow(group: np.ndarray, rows: np.ndarray, lens: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of strings by group, then bytes; a string comes before longer ones that it starts.

    rows: a row of bytes each, zeros after its ``lens`` bytes.
    """
    n, depth = rows.shape
    wide = np.zeros((n, -(-max(depth, shallow) // 8) * 8), np.uint8)
    wide[:, :depth] = rows
    order, cls = multikey_quicksort(group, wide.view(">u8")[:, : shallow // 8].astype(np.uint64))
    starts = np.flatnonzero(np.diff(cls, prepend=-1))
    ends = np.append(starts[1:], n)
    raw, size = wide.tobytes(), wide.shape[1]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie()
            for i in order[a:b].tolist():
                trie.add(raw[i * size : i * size + int(lens[i])], i)
            order[a:b] = trie.ordered()
    return order


def _classes(values: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def common_prefixes(order: np.ndarray, rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Common bytes of each string in the order with the one before it; the first has 0."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 100_000):
        b = min(a + 100_000, len(order))
        left, right = order[a - 1 : b - 1], order[a:b]
        differ = rows[left] != rows[right]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[a:b] = np.minimum(first, np.minimum(lens[left], lens[right]))
    return out
