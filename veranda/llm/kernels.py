"""Vectorised text kernels shared by the corpus operators.

Everything here works on plain Python/numpy values and knows nothing of Spark. Words are hashed without a
Python loop per word: a batch of texts is one byte array, and the polynomial hash of any byte range comes from
one prefix sum (arithmetic modulo 2**64, odd base, one random 64-bit value per byte), so a batch costs a few numpy passes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Texts are handled in batches of about this many bytes, below a power of two (the tables of powers grow to the next one); a longer
#: text is a batch of its own.
BATCH_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, self.base, U64), dtype=U64)))
                self.down = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, _inverse(self.base), U64), dtype=U64)))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS, WORD_POWERS2 = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def table(separators: bytes) -> np.ndarray:
    """A look-up of 256 booleans: True where a byte separates words."""
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: Space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Every ASCII byte but digits and lower-case letters.
NOT_ALNUM = table(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def batches(texts: list[bytes], limit: int = BATCH_BYTES):
    """Yields (from, to) ranges of texts of about limit bytes, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) + 1 > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_edges(texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
    """(number of words before each text plus the total, byte ranges of words, the texts as one buffer, each ended by a line feed)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    if lower:
        buf = _LOWER[buf]
    sep = separators[buf]
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(lens)))
    sep[bounds[1:] - 1] = True  # what joins two texts separates words always
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8))).reshape(-1, 2)
    return np.searchsorted(edge[:, 0], bounds), edge, buf


def byte_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hashes() has the hash of any byte range."""
    return prefix_sums(_BYTE_VALUES[buf], BYTE_POWERS)


def words(texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
    """(hash of each word, number of words before each text plus the total, byte ranges, buffer)."""
    at, edge, buf = word_edges(texts, separators, lower)
    return range_hashes(byte_sums(buf), edge[:, 0], edge[:, 1], BYTE_POWERS), at, edge, buf


def window_hashes(h: np.ndarray, n: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """The hash of each run of n consecutive words; len(h) - n + 1 of them, none if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, U64)
    up, down = powers.get(len(h))
    with np.errstate(over="ignore"):
        sums = np.concatenate(([U64(0)], np.cumsum(h * up, dtype=U64)))
        return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + U64(n))


def prefix_sums(h: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.get(max(1, len(h)))
    with np.errstate(over="ignore"):
        return np.concatenate(([U64(0)], np.cumsum(h * up[: len(h)], dtype=U64)))


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """The hash of the words from each start to its end, out of prefix_sums()."""
    _, down = powers.get(max(1, len(sums)))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of n lower-cased words; with fewer words the whole sequence as one."""
    out: list[np.ndarray] = []
    for a, b in batches(texts):
        h, at, _, _ = words(texts[a:b], SPACE, lower=True)
        runs = window_hashes(h, n)
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= n:
                out.append(np.unique(runs[lo : hi - n + 1]))
            elif hi > lo:
                out.append(window_hashes(h[lo:hi], int(hi - lo)))
            else:
                out.append(np.zeros(0, U64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
