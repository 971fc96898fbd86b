"""Whole texts of an Arrow batch as numpy arrays: characters, words and their hashes.

Helpers for code inside Spark tasks. Texts are handled in chunks of bounded
size, so a batch of long documents does not raise the memory of a worker; a
single text above that size makes a chunk of its own. Hashes are 64 bits, use
fixed multipliers and do not depend on the process, so any task gets the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 0xD6E8FEB86659FD93
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a multiplier modulo 2**64, extended on demand."""

    def __init__(self, base: int) -> None:
        self._base = np.uint64(base)
        self._table = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self._table) < n:
            size = 1 << max(10, (n - 1).bit_length())
            factors = np.full(size, self._base, np.uint64)
            factors[0] = 1
            self._table = np.multiply.accumulate(factors)
        return self._table[:n]


_char_powers = _Powers(int(_BASE))
_powers = _Powers(_STEP)
_inverse_powers = _Powers(_STEP_INVERSE)


def is_space(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


@dataclass
class Chunk:
    """Some texts in a row; `first` and `lengths` locate them in `chars`."""

    rows: slice
    chars: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per character (row) over each text."""
        return segment_sums(values, self.first, self.first + self.lengths)


@dataclass
class Words:
    """Words of a chunk: character spans, 64-bit hashes, and the word range of every text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def segment_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[end] - total[begin]


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Cut a batch into chunks; a null text counts as empty. A line feed separates texts."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i == len(texts) - 1:
            part = [t or "" for t in texts[begin : i + 1]]
            chars = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.array([len(t) for t in part], np.int64)
            first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
            yield Chunk(slice(begin, i + 1), chars, first, lengths)
            begin, size = i + 1, 0


def words(chunk: Chunk, inside: np.ndarray | None = None, chars: np.ndarray | None = None, alone: np.ndarray | None = None) -> Words:
    """Maximal runs of characters that are `inside` a word (default: not ASCII white space); one `alone` is a word of its own."""
    chars = chunk.chars if chars is None else chars
    inside = ~is_space(chars) if inside is None else inside
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if alone is not None:
        cut = np.flatnonzero(inside[1:] & inside[:-1] & (alone[1:] | alone[:-1])) + 1
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    if not len(starts):
        zero = np.zeros(len(chunk.first), np.int64)
        return Words(starts, ends, np.zeros(0, np.uint64), zero, zero)
    sizes = ends - starts
    place = np.flatnonzero(inside)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    power = _char_powers(int(sizes.max()))[np.arange(len(place)) - np.repeat(offset, sizes)]
    hashes = mix(np.add.reduceat((chars[place].astype(np.uint64) + np.uint64(1)) * power, offset))
    low = np.searchsorted(starts, chunk.first)
    return Words(starts, ends, hashes, low, np.searchsorted(starts, chunk.first + chunk.lengths) - low)


class Sequences:
    """Hashes of any stretch of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(n + 1)[:n], out=self._prefix[1:])
        self._back = _inverse_powers(n + 1)

    def stretch(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        size = np.asarray(size)
        raw = (self._prefix[begin + size] - self._prefix[begin]) * self._back[begin]
        return mix(raw + np.asarray(size, np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of every `width` consecutive values."""
    done, place = 1, np.arange(len(values))
    while done < width:
        step = min(done, width - done)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        done += step
    return place


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without a copy per list."""
    out = []
    for part in column.chunks:
        edge, values = part.offsets.to_numpy(), part.values.to_numpy()
        out += [values[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out
