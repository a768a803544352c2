"""A membership filter of k-mers: tells most k-mers that an index lacks before they are shuffled; a join decides exactly behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import small_batches
from ..tables import shared_dir

#: Bits for each k-mer (at least, and what a filter is made with where it may), and bytes that a filter has at most: more k-mers have none.
LEAST_BITS, BITS, MOST_BYTES = 6, 12, 64 << 20
#: Words of a shard, which one task makes.
SHARD = 1 << 17
_held: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _placed(kmers: np.ndarray, shards: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each k-mer, in its shard of so many words, and its four bits there."""
    h = _mixed(kmers)
    word = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    one = np.uint64(1)
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (kmers ^ (kmers >> 17)) % shards * size + word.astype(np.int64), mask


def _shards(shards: int, size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            word, mask = _placed(batch.column("kmer").to_numpy(), shards, size)
            shard = word // size
            for k in np.unique(shard).tolist():
                at = shard == k
                np.bitwise_or.at(own.setdefault(k, np.zeros(size, np.uint64)), word[at] - k * size, mask[at])
        for k, part in own.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "words": pa.array([part.tobytes()], pa.binary())})

    return kernel


@dataclass
class Membership:
    """A filter's files in the shared folder. Workers read it once each."""

    path: str
    shards: int
    size: int

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """In a worker: a function from k-mers to whether the filter may hold each. None is missed; a few hundredths of others pass."""
        if self.path not in _held:
            _held.clear()
            system, name = pafs.FileSystem.from_uri(self.path)
            whole = np.zeros(self.shards * self.size, np.uint64)
            for part in pds.dataset(name, filesystem=system, format="parquet").to_batches():
                for k, data in zip(part.column("shard").to_pylist(), part.column("words").to_pylist(), strict=True):
                    whole[k * self.size : (k + 1) * self.size] |= np.frombuffer(data, np.uint64)
            _held[self.path] = whole
        whole = _held[self.path]

        def may_hold(kmers: np.ndarray) -> np.ndarray:
            word, mask = _placed(kmers, self.shards, self.size)
            return (whole[word] & mask) == mask

        return may_hold


def membership(table: DataFrame, most_bytes: int = MOST_BYTES, path: str | None = None) -> Membership | None:
    """The filter of a table's k-mers (column kmer, not null, perhaps repeated), or None where it would be too large to hold few others.

    A blocked Bloom filter: each k-mer sets four bits of one word. Its size follows the number of rows; tasks make it in
    shards, which are written to path (a new one in the shared folder, if not given), so nothing passes the driver.
    """
    spark = table.sparkSession
    n = table.count()
    bits = min(BITS, 8 * most_bytes // max(n, 1))
    if bits < LEAST_BITS:
        return None
    small_batches(spark)
    words = max(64, -(-n * bits // 64))
    shards = -(-words // SHARD)
    size = -(-words // shards)
    path = path or shared_dir(spark, "filter")
    keys = table.select("kmer")
    if shards > 1:  # each task makes its shards; a small filter is made in parts that are put together
        keys = keys.repartition(shards, F.pmod(F.col("kmer").bitwiseXOR(F.shiftright("kmer", 17)), F.lit(shards)))
    keys.mapInArrow(_shards(shards, size), "shard int, words binary").write.mode("overwrite").parquet(path)
    return Membership(path, shards, size)
