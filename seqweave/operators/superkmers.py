"""k-mer counting by super-k-mers: neighbouring k-mers that share a minimizer are shuffled as one packed stretch of bases and expanded where they are counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import raw, small_batches
from ..tables import written
from .kmers import CODE, blocks_of, canonical_codes, canonical_of

#: Bases of a minimizer at most (odd, so that none is its own reverse complement), and bases of a super-k-mer at most.
MINIMIZER, LONGEST = 11, 255
#: Buckets of minimizers, unless the shuffle has more partitions; packed bytes that a task deals out to buckets at once;
#: bases of a bucket that are expanded at once, and distinct k-mers of a bucket that a task holds. A task's memory follows the last two.
BUCKETS, HELD, CHUNK, DISTINCT = 4096, 1 << 22, 1 << 20, 1 << 21
#: k-mers up to this length are so few that each task counts them in a list of all of them.
DENSE = 9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)


def minimizers(data: np.ndarray, k: int, m: int) -> np.ndarray:
    """For the k-mer at each byte the least mixed code of its canonical m-mers; the greatest number where one of them holds another character than A, C, G and T."""
    code = canonical_codes(data, m)
    value = np.where(code < 0, np.iinfo(np.uint64).max, _mixed(code))
    wide, size = k - m + 1, 1
    while size * 2 <= wide:  # least of 1, 2, 4, ... neighbours
        value[: len(value) - size] = np.minimum(value[: len(value) - size], value[size:])
        size *= 2
    rest = wide - size
    if rest:
        value[: len(value) - rest] = np.minimum(value[: len(value) - rest], value[rest:])
    return value


def packed(codes: np.ndarray) -> np.ndarray:
    """Four 2-bit codes a byte; their number is a multiple of four."""
    four = codes.reshape(-1, 4)
    return four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6)


def unpacked(data: np.ndarray) -> np.ndarray:
    return ((data[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _again(code: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The places of k-mers that the same read has before."""
    out = [np.zeros(0, np.int64)]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = code[a : max(b - k + 1, a)]
        up = np.sort(own)
        if np.any(up[1:] == up[:-1]):
            order = np.argsort(own, kind="stable")
            out.append(a + order[1:][own[order[1:]] == own[order[:-1]]])
    return np.concatenate(out)


def _block(data: np.ndarray, offsets: np.ndarray, k: int, m: int, buckets: int, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bucket, bases, packed codes) of the super-k-mers of a block of reads; each stretch is filled up to a byte."""
    if len(data) < k:
        return None
    code = canonical_codes(data, k)
    valid = code >= 0
    if once:
        valid[_again(code, offsets, k)] = False
    size = np.diff(offsets)
    valid[_ranges(np.maximum(offsets[1:] - (k - 1), offsets[:-1]), np.minimum(size, k - 1))] = False  # k-mers that would cross the end of a read
    low = minimizers(data, k, m)
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    most = LONGEST - k + 1  # k-mers of a stretch; longer ones are cut
    pieces = -(-run // most)
    start = np.repeat(at[first], pieces) + most * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    bases = np.minimum(most, np.repeat(at[first] + run, pieces) - start) + k - 1
    filled = -(-bases // 4) * 4
    codes = np.zeros(int(filled.sum()), np.uint8)
    codes[_ranges(np.cumsum(filled) - filled, bases)] = CODE[data[_ranges(start, bases)]]
    return (low[start] % np.uint64(buckets)).astype(np.int32), bases.astype(np.uint8), packed(codes)


def _stretches(k: int, m: int, buckets: int, once: bool = False):
    """(bucket, sizes, bases): super-k-mers by bucket of their minimizer, many blocks' at once, so that a row holds many; sizes has the bases of each, bases their codes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            if held:
                bucket, bases, data = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                size = -(-bases.astype(np.int64) // 4)
                order = np.argsort(bucket, kind="stable")
                start = (np.cumsum(size) - size)[order]
                bucket, bases, size = bucket[order], bases[order], size[order]
                own = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                cuts = np.append(own, len(bucket)).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(size)])[cuts].astype(np.int32)
                sizes = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(bases)])
                body = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data[_ranges(start, size)])])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[own]), sizes, body], ["bucket", "sizes", "bases"])

        have = 0
        for batch in batches:
            for part in blocks_of(batch):
                made = _block(*raw(part.column("seq")), k, m, buckets, once)
                if made:
                    held.append(made)
                    have += len(made[2])
                if have >= HELD:
                    yield from dealt()
                    have = 0
        yield from dealt()

    return kernel


def expanded(sizes: np.ndarray, bases: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers of super-k-mers."""
    bases_of = sizes.astype(np.int64)
    filled = -(-bases_of // 4) * 4
    start = np.cumsum(filled) - filled
    return canonical_of(unpacked(bases), k)[_ranges(start, bases_of - k + 1)]


def _added(kmers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of k-mers and counts as one, sorted, equal k-mers added up."""
    if len(kmers) == 1:
        return kmers[0], counts[0]
    both, n = np.concatenate(kmers), np.concatenate(counts)
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(n[order], first)


def _counted(k: int):
    """(kmer, count, whole) from rows in the order of buckets: whole tells that no other row counts the k-mer, too."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, have, whole = -1, [], 0, True
        kmers, counts = [], []

        def fold() -> None:
            """Counts what is held and adds it to the bucket's counts."""
            nonlocal held, have, kmers, counts
            if held:
                own = np.sort(expanded(np.concatenate([s for s, _ in held]), np.concatenate([b for _, b in held]), k))
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                held, have = [], 0
                one, n = _added([*kmers, own[first]], [*counts, np.diff(np.append(first, len(own)))])
                kmers, counts = [one], [n]

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal kmers, counts
            if kmers:
                yield pa.RecordBatch.from_arrays([pa.array(kmers[0]), pa.array(counts[0]), pa.array(np.full(len(kmers[0]), whole))], ["kmer", "count", "whole"])
                kmers, counts = [], []

        for batch in batches:
            number = batch.column("bucket").to_numpy()
            (sizes, at), (bases, to) = raw(batch.column("sizes")), raw(batch.column("bases"))
            for i, b in enumerate(number.tolist()):
                if b != bucket:
                    fold()
                    yield from given()
                    bucket, whole = b, True
                elif have >= CHUNK:
                    fold()
                    if len(kmers[0]) > DISTINCT:
                        whole = False
                        yield from given()
                held.append((sizes[at[i] : at[i + 1]], bases[to[i] : to[i + 1]]))
                have += 4 * int(to[i + 1] - to[i])
        fold()
        yield from given()

    return kernel


def _dense(k: int):
    """(kmer, count) of all short k-mers of a task's reads."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64)
        for batch in batches:
            for part in blocks_of(batch):
                data, offsets = raw(part.column("seq"))
                code = canonical_codes(data, k)
                size = np.diff(offsets)
                code[_ranges(np.maximum(offsets[1:] - (k - 1), offsets[:-1]), np.minimum(size, k - 1))] = -1  # k-mers that would cross the end of a read
                total += np.bincount(code[code >= 0], minlength=4**k)
        kmer = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(total[kmer])], ["kmer", "count"])

    return kernel


def super_kmers(reads: DataFrame, k: int = 31, m: int = MINIMIZER, partitions: int | None = None, once: bool = False) -> DataFrame:
    """(bucket, sizes, bases): the super-k-mers of reads (seq) in packed form, before the shuffle. once: each k-mer of a read at its first place only."""
    if not 1 <= k <= 31:
        raise ValueError("k: 1 to 31")
    spark = reads.sparkSession
    small_batches(spark)
    m = min(m, k)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, BUCKETS)
    return reads.select("seq").mapInArrow(_stretches(k, m, buckets, once), "bucket int, sizes binary, bases binary")


def counted(reads: DataFrame, k: int = 31, m: int = MINIMIZER, once: bool = False) -> DataFrame:
    """(kmer, count, whole) over all reads (seq); of k-mers that are not whole, the counts of all rows are to be added up.

    A k-mer and its reverse complement have the same minimizer, so all places of a k-mer are in one bucket, which one
    task expands CHUNK bases at a time. Only where a bucket has more than DISTINCT different k-mers are its counts given
    in parts, so that memory stays bounded. Short k-mers, of which there are few, are counted task by task and added up.
    once: reads that have a k-mer are counted, not its places.
    """
    if 1 <= k <= DENSE and not once:
        small_batches(reads.sparkSession)
        parts = reads.select("seq").mapInArrow(_dense(k), "kmer long, count long")
        return parts.groupBy("kmer").agg(F.sum("count").alias("count")).withColumn("whole", F.lit(True))
    partitions = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = super_kmers(reads, k, m, partitions, once).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_counted(k), "kmer long, count long, whole boolean")


def kmer_counts(reads: DataFrame, k: int = 31, least: int = 1, m: int = MINIMIZER, once: bool = False) -> DataFrame:
    """(kmer, count) of the k-mers that occur so often at least over all reads (once: in so many reads): the same rows as counting each k-mer by itself. A written table."""
    found = written(counted(reads, k, m, once).where(~F.col("whole") | (F.col("count") >= least)), "counts")
    parts = found.where("not whole")
    whole = found.where("whole").select("kmer", "count")
    return whole if parts.isEmpty() else whole.unionByName(parts.groupBy("kmer").agg(F.sum("count").alias("count")).where(F.col("count") >= least))


def spectrum(reads: DataFrame, k: int = 31, m: int = MINIMIZER) -> DataFrame:
    """(abundance, kmers): how many k-mers occur so often, counted in one pass without a table of the k-mers."""
    # rows that are whole fall into groups by count, the few others by k-mer
    whole = F.col("whole")
    groups = counted(reads, k, m).groupBy("whole", F.when(~whole, F.col("kmer")).alias("kmer"), F.when(whole, F.col("count")).alias("own")).agg(F.count("*").alias("rows"), F.sum("count").alias("total"))
    one = groups.select(F.when(whole, F.col("own")).otherwise(F.col("total")).alias("abundance"), F.when(whole, F.col("rows")).otherwise(1).alias("n"))
    return one.groupBy("abundance").agg(F.sum("n").alias("kmers"))
