"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D in the text's UTF-8 form, after A-Z became a-z. All
texts of a batch are joined by a space, so the same few array operations serve short and very long texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_BITS = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _BITS.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, CHUNK_BYTES), _powers(_INVERSE, CHUNK_BYTES)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those of usual lengths are kept in the worker."""
    if n <= CHUNK_BYTES:
        power, inverse = _usual()
        return power[:n], inverse[:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def lowered(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Words:
    """Words of a run of texts: ``hashes[bounds[i]:bounds[i + 1]]`` are those of text i.

    ``starts`` and ``ends`` are byte places inside the text's own lowered bytes.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=first[1:])
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        edge = np.diff(_IS_SPACE[data].view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _tables(len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power, out=total[1:])
        self.hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        self.bounds = np.searchsorted(starts, first)
        base = np.repeat(first[:-1], np.diff(self.bounds))
        self.starts, self.ends = starts - base, ends - base

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words, of the whole sequence; of none, nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        out = out * _BASE + hashes[j : n - width + 1 + j]
    return mix(out)


def runs_at(hashes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at ``places``."""
    if len(places) == 0:
        return hashes[:0]
    power, inverse = _tables(len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power, out=total[1:])
    return mix((total[places + k] - total[places]) * inverse[places] + np.uint64(k))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes each, with the place of the first; a longer text is a run of its own."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) + 1 >= limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield start, held
