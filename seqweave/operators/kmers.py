"""k-mers of reads: canonical codes with their places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import raw, small_batches
from ..functions.sequences import canonical_code
from ..tables import sent, written
from .membership import Membership

#: Bases of a block, so that a worker's memory is bounded by the longest read.
BLOCK = 1 << 19
#: Code of a byte; 4 is no nucleotide.
CODE = np.full(256, 4, np.uint8)
for _k, _c in enumerate("ACTG"):
    CODE[[ord(_c), ord(_c.lower())]] = _k


def canonical_codes(data: np.ndarray, k: int) -> np.ndarray:
    """The canonical code of the k-mer at each byte, -1 where it holds another character or ends beyond the bytes.

    Codes of 1, 2, 4, ... bases are put together from halves, so k costs its logarithm.
    """
    return canonical_of(CODE[data], k)


def canonical_of(code: np.ndarray, k: int) -> np.ndarray:
    """The same of nucleotide codes."""
    n = len(code) - k + 1
    if n <= 0:
        return np.full(len(code), -1, np.int64)
    forward, backward = code.astype(np.int64), (code ^ 2).astype(np.int64)
    size, have, todo = 1, 0, k
    out_f = out_b = None
    while todo:
        if todo & 1:
            if out_f is None:
                out_f, out_b, have = forward[:n], backward[:n], size
            else:
                more_f, more_b = forward[have : have + n], backward[have : have + n]
                out_f = (out_f << (2 * size)) | more_f
                out_b = out_b | (more_b << (2 * have))
                have += size
        todo >>= 1
        if todo:
            forward, backward = (forward[:-size] << (2 * size)) | forward[size:], backward[:-size] | (backward[size:] << (2 * size))
            size *= 2
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    best = np.where(bad[k:] == bad[:-k], np.minimum(out_f, out_b), -1)
    return np.concatenate([best, np.full(k - 1, -1, np.int64)])


def blocks_of(batch: pa.RecordBatch, bases: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of reads with about so many bases (BLOCK, if not given) at most, or one read."""
    at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy().astype(np.int64))
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (bases or BLOCK), "right")))
        yield batch.slice(at, to - at)
        at = to


def _kmers(k: int, keys: list[str], known: Membership | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch):
                data, offsets = raw(part.column("seq"))
                n = np.diff(offsets)
                count = np.maximum(n - k + 1, 0)
                total = np.cumsum(count)
                row = np.repeat(np.arange(len(n)), count)
                pos = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count, count)
                code = canonical_codes(data, k)[np.repeat(offsets[:-1], count) + pos]
                if known:
                    keep = code >= 0
                    keep[keep] = known.test()(code[keep])
                    row, pos, code = row[keep], pos[keep], code[keep]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(taken) for c in keys), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(code, mask=code < 0)], [*keys, "n", "pos", "kmer"])

    return kernel


def kmers(reads: DataFrame, k: int = 31, known: Membership | None = None) -> DataFrame:
    """(read_set, read_id, n, pos, kmer) of reads (read_set, read_id, seq, ...): a row for each k-mer.

    n is the length of the read, pos counts from 0, kmer is the canonical code and null where the k-mer has a character
    other than A, C, G and T (any case). Reads that are shorter than k, empty or null have no rows. known: only k-mers
    that this filter may hold have rows.
    """
    if not 1 <= k <= 31:
        raise ValueError("k: 1 to 31")
    small_batches(reads.sparkSession)
    types = dict(reads.dtypes)
    keys = ["read_set", "read_id"]
    return reads.select(*keys, "seq").mapInArrow(_kmers(k, keys, known), ", ".join(f"{c} {types[c]}" for c in keys) + ", n int, pos int, kmer long")


def kmers_builtin(reads: DataFrame, k: int = 31, chunk: int = 256) -> DataFrame:
    """The same by built-in functions: reads are cut into overlapping chunks first, since substring() walks a string from its start."""
    cut = reads.where(F.length("seq") >= k).select("read_set", "read_id", F.length("seq").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - k) / chunk).cast("int")), lambda i: F.substring("seq", i * chunk + 1, F.lit(chunk + k - 1)))).alias("part", "piece"))
    one = cut.select("read_set", "read_id", "n", "part", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("piece") - k), lambda i: F.substring("piece", i + 1, F.lit(k)))).alias("at", "kmer"))
    code = F.when(F.upper("kmer").rlike("^[ACGT]+$"), canonical_code(F.col("kmer")))
    return one.select("read_set", "read_id", "n", (F.col("part") * chunk + F.col("at")).cast("int").alias("pos"), code.alias("kmer"))


def repeated_kmers(found: DataFrame) -> DataFrame:
    """(read_set, read_id) of the reads in which a canonical k-mer occurs twice."""
    return found.where("kmer is not null").groupBy("read_set", "read_id", "kmer").count().where("count > 1").select("read_set", "read_id").distinct()


def _repeats(k: int):
    """(read_set, read_id) of the reads of a batch in which a k-mer occurs twice."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch):
                data, offsets = raw(part.column("seq"))
                code = canonical_codes(data, k)
                found = np.zeros(len(offsets) - 1, bool)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.sort(code[a : max(b - k + 1, a)])
                    found[i] = bool(np.any((own[1:] == own[:-1]) & (own[1:] >= 0)))
                taken = pa.array(np.flatnonzero(found))
                yield pa.RecordBatch.from_arrays([part.column(c).take(taken) for c in ("read_set", "read_id")], ["read_set", "read_id"])

    return kernel


def reads_with_repeats(reads: DataFrame, k: int = 31) -> DataFrame:
    """(read_set, read_id) of the reads (read_set, read_id, seq) in which a canonical k-mer occurs twice: repeated_kmers(kmers(reads, k)) without a shuffle of k-mers.

    A read's k-mers are compared where they are made. Only where rows share an id, so that a k-mer of one may occur in
    another, are their k-mers grouped.
    """
    if not 1 <= k <= 31:
        raise ValueError("k: 1 to 31")
    small_batches(reads.sparkSession)
    types, key = dict(reads.dtypes), ["read_set", "read_id"]
    found = reads.select(*key, "seq").mapInArrow(_repeats(k), ", ".join(f"{c} {types[c]}" for c in key)).distinct()
    shared = written(reads.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key), "shared")
    if shared.isEmpty():
        return found
    again = reads.alias("r").join(sent(shared).alias("s"), F.expr("r.read_set <=> s.read_set AND r.read_id <=> s.read_id"), "left_semi")
    return found.union(repeated_kmers(kmers(again, k))).distinct()
