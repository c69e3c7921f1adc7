"""Words of whole texts as arrays: positions, 64-bit hashes, hashes of word windows.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Everything here works on one Arrow slice of a few MB; no
array grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of about so many bytes are worked on at a time.
SLICE_BYTES = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes of text each; a longer text is a part of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, one after the other
    begin: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: first word of each text, and the number of words at the end
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """``lower`` folds A-Z before hashing. A null text has no words."""
    raw = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    opens[offsets[:-1][full]] = inside[offsets[:-1][full]]
    closes[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return Words(data, begin, end, first, np.zeros(0, np.uint64))
    size = end - begin
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    powers = np.cumprod(np.full(int(size.max()), _STEP))
    value = (_BYTE_LOWER if lower else _BYTE)[data[inside]] * powers[place]
    return Words(data, begin, end, first, mix(np.add.reduceat(value, at) + size.astype(np.uint64)))


class Windows:
    """Hashes of any run of consecutive words, from prefix sums: equal runs have equal hashes."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        n = len(words)
        values = mix(words + np.uint64(seed)) if seed else words
        powers = np.cumprod(np.full(n, _STEP))
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
        self._back = np.cumprod(np.full(n, _BACK))

    def __call__(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        if not len(begin):
            return np.zeros(0, np.uint64)
        return mix((self._sum[begin + length] - self._sum[begin]) * self._back[begin] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def whole_windows(words: Words, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that lie in one text."""
    start = np.arange(len(words.hash))
    return start[start + length <= np.repeat(words.first[1:], words.counts)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
