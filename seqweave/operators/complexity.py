"""Low-complexity filter by the score of a read's trinucleotides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import raw, small_batches
from .kmers import BLOCK


def _scores(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The score and the length of each sequence, block by block."""
    data, offsets = raw(seqs)
    n = np.diff(offsets)
    out, at = np.zeros(len(n), np.int64), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        code = ((data[offsets[at] : offsets[to]] >> 1) & 3).astype(np.int64)  # every character counts, N as G
        count = np.maximum(n[at:to] - 2, 0)
        if count.sum():
            start = offsets[at:to] - offsets[at]
            place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            tri = code[place] * 16 + code[place + 1] * 4 + code[place + 2]
            m = np.bincount(np.repeat(np.arange(to - at), count) * 64 + tri, minlength=64 * (to - at)).reshape(-1, 64)
            out[at:to] = (m * (m - 1) // 2).sum(1)
        at = to
    return out, n


def bound_of(n: np.ndarray) -> np.ndarray:
    return np.where(n < 6, 0, np.maximum(n - 2, 0) // 4 * (n - 6) // 4 // 2)


@F.arrow_udf(T.LongType())
def _score(seqs: pa.Array) -> pa.Array:
    return pa.array(_scores(seqs)[0])


def _complex(k: int):
    @F.arrow_udf(T.BooleanType())
    def verdict(seqs: pa.Array) -> pa.Array:
        score, n = _scores(seqs)
        return pa.array((n >= k) & (score < bound_of(n)))

    return verdict


def dust_bound(n: Column) -> Column:
    """A read of n bases is complex if its score is below this; reads of 2 to 9 bases never are."""
    return F.when(n < 6, F.lit(0)).otherwise(F.floor(F.floor(F.floor((n - 2) / 4) * (n - 6) / 4) / 2)).cast("long")


def dust_scores(reads: DataFrame) -> DataFrame:
    """reads with dust_score (pairs of equal trinucleotides) and dust_bound."""
    small_batches(reads.sparkSession)
    return reads.withColumn("dust_score", _score("seq")).withColumn("dust_bound", dust_bound(F.length("seq")))


def complex_reads(reads: DataFrame, k: int = 31) -> DataFrame:
    """The reads of at least k bases whose score is below the bound. The verdict comes from one function, so that a seq that is made by an expression is made once."""
    small_batches(reads.sparkSession)
    return reads.where(_complex(k)("seq"))
