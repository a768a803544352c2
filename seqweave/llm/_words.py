"""Vectorised word kernels over the bytes of a block of texts."""

from __future__ import annotations

import hashlib

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: A random 64-bit value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps at most; longer texts have theirs computed anew.
KEPT = 1 << 21
#: Bytes of a word from which on its hash is cryptographic: polynomials modulo a power of 2 are alike for some long words (Thue-Morse words of 1,024 letters).
LONG = 128


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        out = np.full(max(1 << 16, 1 << (n - 1).bit_length()), _MULT if which == "up" else _INV, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= KEPT:
            _powers[which] = have
    return have[:n]


#: Word bytes of a text, lower-cased (A-Z only); 0 separates words. Every byte from 0x80 on belongs to a word.
WORD_TABLE = np.zeros(256, np.uint8)
WORD_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_TABLE[0x80:] = np.arange(0x80, 0x100)


class Hashes:
    """64-bit hashes of any ranges of a byte string, from one prefix sum of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", max(len(data), 1))[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * back[start] + (end - start).astype(np.uint64))


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside; no run crosses an offset."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[offsets < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[(offsets > 0) & (offsets <= n)] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a block of texts: starts, ends, hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_TABLE):
        self.norm = table[data]
        self.starts, self.ends = edges(self.norm != 0, offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hasher = Hashes(self.norm)
        self.hashes = self.hasher.of(self.starts, self.ends)
        for k in np.flatnonzero(self.ends - self.starts >= LONG).tolist():
            word = self.norm[self.starts[k] : self.ends[k]].tobytes()
            self.hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(words: Words, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles of so many words as sorted hashes, and how often each occurs. A text of fewer words, but not none, has one shingle."""
    h, n = words.hashes, len(words.hashes)
    run = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        run = run * np.uint64(_MULT) + h[k : k + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(run[a : b - size + 1])
            keep = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out.append((own[keep], np.diff(np.append(keep, len(own))).astype(np.float64)))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for v in h[a:b]:
                x = x * np.uint64(_MULT) + v
            out.append((mix(x + np.uint64(b - a)), np.ones(1)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0)))
    return out
