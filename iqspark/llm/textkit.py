"""Words of many texts at once, straight from Arrow's string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z

_CHECKED = (mix(_FOLDED) >> _U(32)).astype(np.uint32)


def power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base of rolling hashes, or of its inverse (down)."""
    if len(_powers[kind]) < n:
        base = _U(_BASE if kind == "up" else pow(_BASE, -1, 2**64))
        grown = np.full(max(n, 1 << 16), base, _U)
        grown[0] = 1
        _powers[kind] = np.multiply.accumulate(grown)
    return _powers[kind][:n]


@dataclass
class Words:
    """Word k is data[start[k]:end[k]] and stands in row doc[k]; first[d]:first[d + 1] are the words of row d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    n_docs: int

    def hashes(self, fold: bool = True) -> np.ndarray:
        """64 bits of each word; with fold, A-Z count as a-z."""
        n = len(self.data)
        sums = np.zeros(n + 1, _U)
        np.cumsum((_FOLDED if fold else _BYTE)[self.data] * power("up", n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * power("down", n + 1)[self.start] + (self.end - self.start).astype(_U))

    def checks(self) -> np.ndarray:
        """32 bits more of each word, by other values of bytes; A-Z count as a-z."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum(_CHECKED[self.data] * power("up", n).astype(np.uint32), out=sums[1:])
        return (sums[self.end] - sums[self.start]) * power("down", n + 1)[self.start].astype(np.uint32)


def words(texts: pa.Array, space: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are no white space (0x20, 0x09-0x0D), never across rows; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    n = len(data)
    inside = ~space[data]
    opens, closes = inside.copy(), np.zeros(n + 1, bool)
    opens[1:] &= ~inside[:-1]
    closes[1:n] = inside[:-1] & ~inside[1:]
    if n:
        closes[n] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[inside[cut] & inside[cut - 1]]
    opens[joined] = closes[joined] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first)) if len(texts) else np.zeros(0, np.int64)
    return Words(data, start, end, doc, first, len(texts))


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of a column; bytes that are no UTF-8 become U+FFFD, as in decoding with replacement."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_string()).view(pa.large_binary()).to_pylist()
        return [None if x is None else x.decode(errors="replace") for x in raw]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 500_000, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded size; a longer text is a piece of its own. Arrow's free memory goes back after the last."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    total = np.concatenate([[0], np.cumsum(size)])
    while at < len(size):
        to = min(max(int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1, at + 1), at + most_rows, len(size))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def windows(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k words within a row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(w.doc[: len(h) - k + 1] == w.doc[k - 1 :])
    out = np.zeros(len(h) - k + 1, _U)
    for i in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return at, out[at]
