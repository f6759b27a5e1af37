"""Words of Arrow string columns as NumPy arrays.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D. All functions work on the bytes of many
texts at once, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers that look random; the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = randoms(11, 256)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps from one call to the next; a longer text makes its own.
_KEPT = 1 << 20


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= _KEPT + 1:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """The words of texts ``first`` .. of a column, in order."""

    first: int
    n_texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  #: for each word, which of the texts it is in
    bounds: np.ndarray  #: words of text i are bounds[i] .. bounds[i + 1]

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        """A 64-bit hash of each word, with its bytes replaced by ``fold``; of many bytes, some at a time."""
        if len(self.data) <= _KEPT:
            return self.parts(fold, [(self.start, self.end)])[0]
        out, lo = np.empty(len(self.start), np.uint64), 0
        while lo < len(out):
            at = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, at + _KEPT, "right")))
            some = replace(self, data=self.data[at : self.end[hi - 1]])
            out[lo:hi] = some.parts(fold, [(self.start[lo:hi] - at, self.end[lo:hi] - at)])[0]
            lo = hi
        return out

    def parts(self, fold: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Hashes of several lists of byte ranges (from, to), with bytes replaced by ``fold``."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[fold][self.data] * _power("up", _BASE, n), out=sums[1:])
        down = _power("down", _INVERSE, n + 1)
        return [mix((sums[to] - sums[at]) * down[at]) for at, to in bounds]

    def windows(self, hashed: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
        """A hash of the k words from each word on; what begins in one text and ends in another is not meaningful."""
        n = max(0, len(hashed) - k + 1)
        out = np.zeros(n, np.uint64)
        for j, m in enumerate(randoms(1000 + 97 * k + seed, k) | np.uint64(1)):
            out += hashed[j : j + n] * m
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are in one text."""
        n = max(0, len(self.text) - k + 1)
        return self.text[:n] == self.text[k - 1 : k - 1 + n]

    def fingerprint(self, hashed: np.ndarray, seed: int) -> np.ndarray:
        """A 64-bit hash of each text's whole sequence of words."""
        n = len(hashed)
        base = randoms(seed, 1)[0] | np.uint64(1)
        place = np.arange(n) - self.bounds[self.text]
        powers = _power(f"text{seed}", base, int(place.max(initial=0)) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashed * powers[place], out=sums[1:])
        counts = np.diff(self.bounds).astype(np.uint64)
        return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + counts * np.uint64(0xD6E8FEB86659FD93))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; null is as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def words_of(data: np.ndarray, at: np.ndarray, first: int = 0) -> Words:
    """The words of the texts data[at[i]:at[i + 1]]."""
    data, at = data[at[0] : at[-1]], at - at[0]
    solid = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[at] = False
    start = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    after[at] = False
    end = np.flatnonzero(solid & ~after[1:]) + 1
    bounds = np.searchsorted(start, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    return Words(first, len(at) - 1, data, start, end, text, bounds)


def chunks_of(column: pa.Array, size: int = 1 << 20) -> Iterator[Words]:
    """The words of a column, a few texts (about ``size`` bytes, one text at least) at a time."""
    data, at = bytes_of(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield words_of(data, at[lo : hi + 1], lo)
        lo = hi
