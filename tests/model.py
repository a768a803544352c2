"""A plain model of the read-set operators, one read at a time."""

from __future__ import annotations

import random
import struct

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}


def rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def code(kmer: str) -> int | None:
    if set(kmer) - set("ACGT"):
        return None
    number = lambda s: sum(CODE[c] * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    return min(number(kmer), number(rc(kmer)))


def codes(seq: str | None, k: int) -> list[int | None]:
    s = (seq or "").upper()
    return [code(s[i : i + k]) for i in range(len(s) - k + 1)]


def f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def complex_(seq: str, k: int) -> bool:
    n = len(seq)
    if n < k:
        return False
    seen: dict[str, int] = {}
    for i in range(n - 2):
        t = "".join(str((ord(c) >> 1) & 3) for c in seq[i : i + 3])
        seen[t] = seen.get(t, 0) + 1
    bound = (((n - 2) // 4) * ((n - 6) % 2**32) % 2**32) // 4 // 2
    return sum(m * (m - 1) // 2 for m in seen.values()) < bound


def best_window(cover: list[bool], w: int) -> int:
    return max(sum(cover[i : i + w]) for i in range(len(cover) - w + 1))


def covered(places: list[int], n: int, k: int) -> list[bool]:
    out = [False] * n
    for p in places:
        out[p : p + k] = [True] * k
    return out


def too_sparse(cover: list[bool], z: int, threshold: int) -> bool:
    w = min(z, len(cover))
    return any(w - sum(cover[i : i + w]) > z * threshold // 100 for i in range(len(cover) - w + 1))


def links(queries: dict, bank: dict, k: int, a: int, threshold: float, window: int = 0, keep: bool = True, z: int = 0, zt: int = 80) -> dict:
    count: dict[int, int] = {}
    for s in bank.values():
        for c in codes(s, k):
            if c is not None:
                count[c] = count.get(c, 0) + 1
    index: dict[int, set] = {}
    for t, s in bank.items():
        if keep or complex_(s, k):
            for c in codes(s, k):
                if c is not None and count[c] >= a:
                    index.setdefault(c, set()).add(t)
    out = {}
    for q, s in queries.items():
        if not keep and not complex_(s, k):
            continue
        places: dict[int, list[int]] = {}
        for p, c in enumerate(codes(s, k)):
            for t in index.get(c, ()):
                places.setdefault(t, []).append(p)
        n = len(s)
        w = n if window <= 0 or window > n else window
        for t, at in places.items():
            cover = covered(at, n, k)
            if z > 0 and too_sparse(cover, z, zt):
                continue
            span = best_window(cover, w)
            if f32(100 * span / w) >= threshold:
                out[q, t] = (span, f32(100 * span / w))
    return out


def random_reads(seed: int, n: int = 25, size: int = 90) -> dict[int, str]:
    """Reads that share pieces, some reversed, some with errors, N or lower case."""
    r = random.Random(seed)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    out = {}
    for i in range(n):
        at = r.randrange(0, 300 - size)
        s = list(genome[at : at + r.randint(5, size)])
        for _ in range(r.randint(0, 3)):
            s[r.randrange(len(s))] = r.choice("ACGTN")
        t = "".join(s)
        out[i] = rc(t) if r.random() < 0.4 else t
        if r.random() < 0.2:
            out[i] = out[i].lower()
    out[n], out[n + 1], out[n + 2] = "", "A" * 60, "AC" * 40
    return out


def frame(spark, reads: dict, read_set: str = ""):
    return spark.createDataFrame([(read_set, i, f"r{i}", s, None) for i, s in reads.items()], "read_set string, read_id long, header string, seq string, qual string")
