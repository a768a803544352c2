"""Bases that shared k-mers cover: in all, in the best window, and in windows that are too empty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def full_span(positions: Column, k: int) -> Column:
    """Bases that k-mers at the given distinct places cover; places are sorted here. Nothing is covered by no k-mer."""
    at = F.array_sort(positions)
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(k)))
    return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(k), lambda acc, g: acc + g)).cast("long")


class Covers:
    """The bases that k-mers at distinct places cover in many reads at once, as intervals: costs grow with the places, not with the reads, and no step is taken read by read.

    The reads lie one after another, each in a room of its own, so that their places ascend as one list.
    """

    def __init__(self, positions: pa.Array, n: pa.Array, k: int):
        self.n = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if n.null_count else n.to_numpy().astype(np.int64)
        off = positions.offsets.to_numpy().astype(np.int64)
        self.count = np.diff(off)
        flat = positions.values.to_numpy()[off[0] : off[-1]].astype(np.int64)
        row = np.repeat(np.arange(len(self.n)), self.count)
        room = self.n + 1
        self.base = np.cumsum(room) - room
        order = np.argsort(self.base[row] + flat, kind="stable")
        at = (self.base[row] + flat)[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] > at[:-1] + k) | (row[1:] != row[:-1])
        last = np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
        #: The intervals: their reads, starts and ends.
        self.row = row[first]
        self.start = at[first]
        self.end = np.minimum(at[last] + k, self.base[self.row] + self.n[self.row])
        self.before = np.concatenate([[0], np.cumsum(self.end - self.start)])

    def upto(self, x: np.ndarray) -> np.ndarray:
        """Covered bases before x, in all reads up to there."""
        if not len(self.start):
            return np.zeros(len(x), np.int64)
        i = np.searchsorted(self.start, x, "right")
        last = np.maximum(i - 1, 0)
        return np.where(i > 0, self.before[last] + np.minimum(x, self.end[last]) - self.start[last], 0)

    def windows(self, row: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Covered bases of the windows of w bases at the starts (places in the row's read), as far as they lie in it."""
        s = self.base[row] + np.clip(starts, 0, self.n[row] - w)
        return self.upto(s + w) - self.upto(s)


def window_span(k: int, window: int):
    """A function of (positions, n): the most covered bases in any window of so many bases, or of the read if it is shorter.

    The best window begins where an interval begins or ends where one ends. All reads of a batch are looked at together.
    """

    @F.arrow_udf(T.LongType())
    def span(positions: pa.Array, n: pa.Array) -> pa.Array:
        cover = Covers(positions, n, k)
        w = cover.n if window <= 0 else np.minimum(window, cover.n)
        row = np.concatenate([cover.row, cover.row])
        starts = np.concatenate([cover.start, cover.end - w[cover.row]]) - cover.base[row]
        out = np.zeros(len(cover.n), np.int64)
        np.maximum.at(out, row, cover.windows(row, starts, w[row]))
        return pa.array(out)

    return span


def sparse_window(k: int, window: int, threshold: int):
    """A function of (positions, n): whether some window of so many bases has more uncovered bases than threshold percent of it (rounded down). A shorter read is one window.

    The emptiest window begins where an interval ends, ends where one begins, or lies at an end of the read.
    """

    @F.arrow_udf(T.BooleanType())
    def sparse(positions: pa.Array, n: pa.Array) -> pa.Array:
        cover = Covers(positions, n, k)
        w, every = np.minimum(window, cover.n), np.arange(len(cover.n))
        row = np.concatenate([every, every, cover.row, cover.row])
        ends = np.concatenate([cover.end, cover.start - w[cover.row]]) - cover.base[np.concatenate([cover.row, cover.row])]
        starts = np.concatenate([np.zeros(len(every), np.int64), cover.n - w, ends])
        least = w.copy()
        np.minimum.at(least, row, cover.windows(row, starts, w[row]))
        return pa.array(w - least > window * threshold // 100)

    return sparse
