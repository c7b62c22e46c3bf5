"""Words of whole texts as byte spans, without an object for each word.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. These are single ASCII bytes, so the
words of the UTF-8 bytes are the words of the text, and bytes.split() gives the same ones.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, U64)
        if n:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Words:
    """The words of a list of texts. norm: all words, each followed by one space; starts and ends: spans in norm;
    first: index of each text's first word, and the number of words at the end."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (data == 32) | ((data - np.uint8(9)) < 5)
        word = ~blank
        start = word.copy()
        start[1:] &= blank[:-1]
        at = np.flatnonzero(start)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(at, begins)
        keep = word.copy()
        keep[1:] |= word[:-1]
        norm = data[keep]
        norm[blank[keep]] = 32
        self.norm = norm
        stops = np.flatnonzero(norm == 32)
        self.ends = stops
        self.starts = np.concatenate(([0], stops[:-1] + 1)).astype(np.int64) if len(stops) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, from its bytes alone."""
        n, total = len(self), len(self.norm)
        out = np.empty(n, U64)
        codes = byte_codes()
        p, inv = powers(_CHUNK)
        cuts = np.unique(np.concatenate((np.searchsorted(self.starts, np.arange(0, total, _CHUNK // 2)), [n])))
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = int(self.starts[i]), int(self.ends[j - 1])
            if b - a > len(p):
                p, inv = powers(b - a)
            c = np.zeros(b - a + 1, U64)
            np.cumsum(codes[self.norm[a:b]] * p[: b - a], out=c[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            out[i:j] = (c[e] - c[s]) * inv[s]
        return mixed(out)


def tuple_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n neighbours of h."""
    if len(h) < n:
        return np.zeros(0, U64)
    p, inv = powers(len(h))
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p, out=c[1:])
    return mixed((c[n:] - c[:-n]) * inv[: len(h) - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width neighbours."""
    if len(x) < width:
        return x[:0]
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(cur[:n], cur[width - size : width - size + n])


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to most or less; a larger one goes alone."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out
