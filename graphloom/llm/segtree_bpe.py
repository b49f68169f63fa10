"""Byte-pair merging by a segment tree over adjacent pair ranks.

Every pre-token is a row of symbols. Leaf ``p`` of its tree holds ``rank * L + p`` for the
pair that starts at symbol ``p`` (or ``INF``), inner nodes hold minima, so the root is the
leftmost pair of lowest rank. A merge changes three leaves; each is pushed up ``log2(L)``
levels. Short pre-tokens are worked on together, one numpy step for the next merge of all
of them; long ones (over ``MAX_LEAVES`` pairs) go through the same tree in plain Python.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np

INF = 1 << 30
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
MAX_LEAVES = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell them."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class MergeTable:
    """Vocabulary and merges of a BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in chain(vocab.items(), self.special.items()):
            self.pieces[i] = piece
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._place(keys)
        self.lookup = dict(zip(keys.tolist()[::-1], range(len(keys) - 1, -1, -1), strict=True))
        self.vocab = vocab

    def _place(self, keys: np.ndarray) -> None:
        """Open addressing: a key lies at its slot or one of the ``self.reach`` after it."""
        self.shift = np.uint64(64 - 2 - max(4, len(keys).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int64)
        left, self.reach = np.arange(len(keys)), 0
        while len(left):  # of keys that want one free slot, the first gets it
            slot = self._slots(keys[left]) + self.reach
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[left[won]], left[won]
            left = np.delete(left, won)
            self.reach += bool(len(left))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = (left.astype(np.int64) << 32) | right
        shape, key = key.shape, key.reshape(-1)
        slot = self._slots(key)
        held = self.keys[slot]
        rank = np.where(held == key, self.ranks[slot], -1)
        more = np.flatnonzero((held >= 0) & (held != key))
        for _ in range(self.reach):
            if not len(more):
                break
            slot[more] += 1
            held = self.keys[slot[more]]
            hit = held == key[more]
            rank[more[hit]] = self.ranks[slot[more[hit]]]
            more = more[(held >= 0) & ~hit]
        return rank.reshape(shape)


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _merge_rows(table: MergeTable, rows: np.ndarray, lens: np.ndarray, leaves: int) -> list[np.ndarray]:
    """rows: bytes, one pre-token of 2 to leaves + 1 bytes each, zero-padded. Gives ids and counts."""
    n, width, span = len(rows), leaves + 2, 2 * leaves
    sym = np.zeros((n, width), np.int32)
    sym[:, : leaves + 1] = table.inner[rows]
    here = np.arange(n)
    sym[here, lens - 1] = table.final[rows[here, lens - 1]]
    rank = table.pair_ranks(sym[:, :leaves], sym[:, 1 : leaves + 1])
    slot = np.arange(leaves)
    tree = np.full((n, span), INF, np.int32)
    tree[:, leaves:] = np.where((rank >= 0) & (slot < (lens - 1)[:, None]), rank * leaves + slot, INF)
    for i in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
    alive = np.arange(width) < lens[:, None]
    tree, sym, after, before, alive = (x.reshape(-1) for x in (tree, sym, after, before, alive))

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at, base = leaf + leaves, row * span
        tree[base + at] = value
        at = at >> 1
        while at[0]:  # leaves of one class lie at one depth
            tree[base + at] = np.minimum(tree[base + 2 * at], tree[base + 2 * at + 1])
            at = at >> 1

    live = here
    while True:
        root = tree[live * span + 1]
        go = root < INF
        live, root = live[go], root[go]
        if not len(live):
            break
        p, base = root % leaves, live * width
        gone = after[base + p]
        right = after[base + gone]
        sym[base + p] = table.merged[root // leaves]
        alive[base + gone] = False
        after[base + p] = right
        before[base + np.minimum(right, width - 1)] = p
        dead = gone < leaves
        if dead.any():
            put(live[dead], gone[dead], np.full(int(dead.sum()), INF))
        ends = right >= lens[live]
        r = table.pair_ranks(sym[base + p], sym[base + np.minimum(right, width - 1)])
        put(live, p, np.where(ends | (r < 0), INF, r * leaves + p))
        has = p > 0
        if has.any():
            rows_, p_, base_ = live[has], p[has], base[has]
            left = before[base_ + p_]
            r = table.pair_ranks(sym[base_ + left], sym[base_ + p_])
            put(rows_, left, np.where(r < 0, INF, r * leaves + left))
    alive = alive.reshape(n, width)
    return [sym.reshape(n, width)[alive], alive.sum(axis=1)]


def _merge_long(table: MergeTable, word: bytes) -> list[int]:
    """The same tree for one pre-token of any length."""
    sym = table.inner[np.frombuffer(word, np.uint8)]
    sym[-1] = table.final[word[-1]]
    n = len(sym)
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    rank = table.pair_ranks(sym[:-1], sym[1:])
    tree = np.full(2 * leaves, 1 << 62, np.int64)
    tree[leaves : leaves + n - 1] = np.where(rank >= 0, (rank << 32) | np.arange(n - 1), 1 << 62)
    i = leaves
    while i > 1:
        tree[i // 2 : i] = tree[i : 2 * i].reshape(-1, 2).min(axis=1)
        i //= 2
    tree, sym = tree.tolist(), sym.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, get, merged = 1 << 62, table.lookup.get, table.merged.tolist()

    def put(p: int, value: int) -> None:
        p += leaves
        tree[p] = value
        p >>= 1
        while p:
            low = tree[2 * p] if tree[2 * p] < tree[2 * p + 1] else tree[2 * p + 1]
            if tree[p] == low:
                break
            tree[p] = low
            p >>= 1

    def value(p: int, q: int) -> int:
        r = get((sym[p] << 32) | sym[q])
        return none if r is None else (r << 32) | p

    while (root := tree[1]) != none:
        p = root & 0xFFFFFFFF
        q = after[p]
        sym[p], sym[q] = merged[root >> 32], -1
        after[p] = right = after[q]
        if q < n - 1:
            put(q, none)
        if right < n:
            before[right] = p
            put(p, value(p, right))
        else:
            put(p, none)
        if p:
            put(before[p], value(before[p], p))
    return [s for s in sym if s >= 0]


def encode_words(table: MergeTable, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens, one after another, and each one's count; their bytes lie in data, an empty one has no ids."""
    counts = (lens > 0).astype(np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    done = 1
    single = np.flatnonzero(lens == 1)
    if len(single):
        parts.append((single, table.final[data[starts[single]]]))
    leaves = 2
    while leaves <= MAX_LEAVES:
        which = np.flatnonzero((lens > done) & (lens <= leaves + 1))
        for some in np.array_split(which, max(1, len(which) * leaves // 1_000_000)):
            if len(some):
                place = np.arange(leaves + 1)
                rows = data[np.minimum(starts[some][:, None] + place, len(data) - 1)]
                rows[place >= lens[some][:, None]] = 0
                ids, n = _merge_rows(table, rows, lens[some], leaves)
                counts[some] = n
                parts.append((some, ids))
        done, leaves = leaves + 1, leaves * 2
    for i in np.flatnonzero(lens > done).tolist():
        ids = np.array(_merge_long(table, data[starts[i] : starts[i] + lens[i]].tobytes()), np.int64)
        counts[i] = len(ids)
        parts.append((np.array([i]), ids))
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(start[-1], np.uint32)
    for which, ids in parts:
        n = counts[which]
        at = np.repeat(start[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(ids))
        out[at] = ids
    return out, counts
