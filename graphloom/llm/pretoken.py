"""Whole texts to pre-tokens and ids for word-end BPE files (NFC, lower case, white space dropped).

White space never lies inside a pre-token, so a text is a row of chunks without white space.
Arrow splits a slice of texts and numbers its distinct chunks; only chunks that are new to the
worker are taken apart, and their distinct pre-tokens are merged together by the segment tree.
Chunks of letters alone are pre-tokens as they are; the rest is split by the tokenizer's pattern.
The table of known chunks is bounded: past ``KNOWN_BYTES`` it is emptied and fills again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from graphloom.llm.segtree_bpe import MergeTable, byte_alphabet, encode_words, merge_table

KNOWN_BYTES = 48_000_000
SLICE_BYTES = 4_000_000

# The split pattern of the tokenizer file, and what it comes to in ASCII; \n parts chunks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+|\n"

_split = regex.compile(SPLIT).findall
_split_ascii = re.compile(SPLIT_ASCII).findall


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text without added tokens. Lower case letter by letter: a final sigma stays a plain one."""
    if text.isascii():
        return _split_ascii(text.lower())
    text = unicodedata.normalize("NFC", text)
    return _split((text if "Σ" not in text else text.replace("Σ", "σ")).lower())


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after another."""
    ends = np.cumsum(counts, dtype=starts.dtype)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype)


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and bytes of large strings without nulls."""
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return bounds[:-1], np.diff(bounds), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Of each code point, whether Python's tables don't know it; newer tables, as the library's, may."""
    names = "".join(map(unicodedata.category, map(chr, range(0x110000))))
    return np.frombuffer(names.encode(), "S2") == b"Cn"


def has_unassigned(text: str) -> bool:
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class Pretokenizer:
    """Adds the file's added tokens, whose strings stand for their ids wherever a text has them."""

    def __init__(self, path: str):
        self.path = path
        self.table: MergeTable = merge_table(path)
        self.special = self.table.special
        names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)"
        self.find, self.cut = re.compile(names).search, re.compile(f"({names})").split
        self.bytes_of = {c: b for b, c in enumerate(byte_alphabet())}

    def _by_library(self, text: str) -> list[str]:
        """Pre-tokens by the library's own tables."""
        lib = library(self.path)
        parts = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in parts]

    def _parts(self, chunks: list[str]) -> list[str]:
        """Pre-tokens of all chunks with "\n" after each chunk's; an added token is kept as its string."""
        text = "\n".join([*chunks, ""])
        if has_unassigned(text):
            out: list[str] = []
            for c in chunks:
                for i, part in enumerate(self.cut(c)):
                    out += [part] if i % 2 else self._by_library(part) if has_unassigned(part) else pretokens(part)
                out.append("\n")
            return out
        if not self.find(text):
            return pretokens(text)
        return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else pretokens(part))]

    def flat(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of distinct chunks, their codes one after another, and each chunk's count.

        "\n" is the last of the distinct ones, without a code of its own.
        """
        plain = pc.ascii_is_alpha(chunks).to_numpy(zero_copy_only=False)
        ascii_ = plain | pc.string_is_ascii(chunks).to_numpy(zero_copy_only=False)
        kinds = np.where(plain, 0, np.where(ascii_, 1, 2))
        words = [pc.ascii_lower(chunks.filter(pa.array(plain)))]
        for kind in (1, 2):
            some = chunks.filter(pa.array(kinds == kind))
            words.append(pa.array(self._parts(listed(some)) if len(some) else [], pa.large_string()))
        coded = pa.concat_arrays([*words, pa.array(["\n"], pa.large_string())]).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        end = code[-1]
        n_plain = len(words[0])
        counts = np.ones(len(chunks), np.int64)
        parted = code[n_plain:-1]
        marks = np.flatnonzero(parted == end)
        rest = np.concatenate([np.flatnonzero(kinds == 1), np.flatnonzero(kinds == 2)])
        counts[rest] = np.diff(marks, prepend=-1) - 1
        by_kind = np.concatenate([code[:n_plain], parted[parted != end]])
        order = np.concatenate([np.flatnonzero(plain), rest])  # chunks as they lie in by_kind
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return distinct, by_kind[ragged(start, counts)], counts


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known:
    """Distinct chunks met so far, numbered as they came: strings of Arrow, of which more fit than objects of Python."""

    def __init__(self):
        self.chunks = pa.array([], pa.large_string())

    def numbers(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of these distinct chunks, and those that are new, which get the next ones."""
        at = pc.index_in(chunks, self.chunks).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(at < 0)
        at[new] = len(self.chunks) + np.arange(len(new))
        missing = chunks.take(pa.array(new))
        self.chunks = pa.concat_arrays([self.chunks, missing])
        return at, missing

    def size(self) -> int:
        """Bytes that the strings and a lookup among them take."""
        return self.chunks.nbytes + 48 * len(self.chunks)


class Encoder:
    """ids of whole texts, little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.pre = Pretokenizer(path)
        self.table = self.pre.table
        self.pieces = pa.array(self.table.pieces, pa.string())
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.ids, self.start, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of distinct pre-tokens: "\\n" has none, an added token its own."""
        starts, lens, data = string_bytes(words)
        names = list(self.pre.special)
        which = pc.index_in(words, pa.array(["\n", *names], words.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        flat, counts = encode_words(self.table, data, starts, np.where(which >= 0, 0, lens))
        odd = np.flatnonzero(which > 0)
        if len(odd):
            counts[odd] = 1
            own = np.array([self.pre.special[names[k - 1]] for k in which[odd].tolist()], np.uint32)
            at = (np.cumsum(counts) - counts)[odd]
            flat = np.insert(flat, at - np.arange(len(at)), own)
        return flat, counts

    def learn(self, chunks: pa.Array) -> None:
        words, code, per_chunk = self.pre.flat(chunks)
        flat, n = self.words(words)
        counts = n[code]
        ids = flat[ragged((np.cumsum(n) - n)[code], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(per_chunk)]
        n = np.diff(ends, prepend=0)
        self.start = np.concatenate([self.start, (len(self.ids) + ends - n).astype(np.int32)])
        self.n = np.concatenate([self.n, n.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def split(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """texts: strings, null: empty. Gives each chunk's code, the distinct chunks, and offsets of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(texts)
        if len(odd):  # Arrow splits there, the tokenizer doesn't: such a text is one chunk
            split, odd = lists.to_pylist(), set(odd.tolist())
            rows = [[t.replace("\n", " ")] if i in odd else split[i] for i, t in enumerate(texts.to_pylist())]
            lists = pa.array(rows, pa.large_list(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        return coded.indices.to_numpy(), coded.dictionary, offsets - offsets[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and len(texts) + 1 offsets into them."""
        code, chunks, offsets = self.split(texts)
        if self.known.size() + self.ids.nbytes + self.start.nbytes + self.n.nbytes > KNOWN_BYTES:
            self.forget()
        at, missing = self.known.numbers(chunks)
        if len(missing):
            self.learn(missing)
        n = self.n[at]
        counts = n[code]
        ids = self.ids[ragged(self.start[at][code], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts; without a decoder in the file, pieces are joined by spaces."""
        pieces = self.pieces.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), " ")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``size`` bytes of text; a longer text stands alone."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(length) // size
        cuts = [0, *(1 + np.flatnonzero(np.diff(part))).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def binary_rows(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's ids as a binary value."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of binary_rows; null: no ids."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, "<u4")
    return ids, (offsets - offsets[0]) // 4
