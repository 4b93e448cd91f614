"""Many texts as one byte array, with word spans and substring hashes by whole-array arithmetic.

A task sees its documents in blocks of about a megabyte. Hashes are polynomials modulo 2**64 over prefix
sums, so the hash of a span of up to 256 bytes costs two lookups; a final mixing step spreads them over all bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

BLOCK_BYTES, SPAN_BYTES = 1_000_000, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _powers[str(base)] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


class TextBlock:
    """Texts joined with one space after each; ``first[i]:last[i]`` are the bytes of text ``i``."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.data = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of non-space bytes, and the first word number of each text."""
        solid = ~SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, np.append(self.first, len(self.data)))

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            sums = np.empty(len(self.data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLE[self.data] * _power(_BASE, len(self.data)), out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every span. A polynomial modulo 2**64 is equal for some long texts whatever its base, so a span of more
        than SPAN_BYTES is cut there and the mixed hashes of its parts are added, each under its own number."""
        n = ends - starts
        out = self._short(starts, np.minimum(ends, starts + SPAN_BYTES))
        long = np.flatnonzero(n > SPAN_BYTES)
        if len(long):
            parts = -(-n[long] // SPAN_BYTES)
            first = np.cumsum(parts) - parts
            number = np.arange(int(parts.sum())) - np.repeat(first, parts)
            begin = np.repeat(starts[long], parts) + number * SPAN_BYTES
            own = self._short(begin, np.minimum(begin + SPAN_BYTES, np.repeat(ends[long], parts)))
            total = np.add.reduceat(mix(own ^ mix(number.astype(np.uint64) + np.uint64(1))), first)
            out[long] = mix(total + n[long].astype(np.uint64))
        return out

    def _short(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._prefix()
        inverse = _power(_INVERSE, len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: Iterable[str | bytes | None], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cut texts (null is empty) into runs of about ``size`` bytes: the first position and the bytes."""
    start, held, now = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t if isinstance(t, bytes) else t.encode()
        if held and now + len(raw) > size:
            yield start, held
            start, held, now = i, [], 0
        held.append(raw)
        now += len(raw) + 1
    if held:
        yield start, held


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` neighbouring words; one per start, over the whole block."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = (out + words[j : len(words) - n + 1 + j]) * _BASE
    return mix(out + np.uint64(n))
