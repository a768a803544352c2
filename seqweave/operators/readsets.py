"""Sets of reads (read_set, read_id): from results, by set algebra, and as packed bit files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system, ship

KEYS = ["read_set", "read_id"]


def selected_by_links(found: DataFrame, threshold: float) -> DataFrame:
    """Query reads with a link of at least threshold percent; found has pct or, of ids-only results, max_pct."""
    pct = next((c for c in ("pct", "max_pct") if c in found.columns), None)
    if pct is None:
        raise ValueError("links by any k-mer have no percentage")
    return found.groupBy("read_set", F.col("query_id").alias("read_id")).agg(F.max(pct).alias("best")).where(F.col("best") >= threshold).select(*KEYS)


def selected_by_counts(found: DataFrame, threshold: float) -> DataFrame:
    """Query reads of which more than threshold percent is covered."""
    return found.where(F.col("pct") > threshold).select("read_set", F.col("query_id").alias("read_id")).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEYS, "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS).union(b.select(*KEYS)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEYS, "left_anti")


def complement(a: DataFrame, reads: DataFrame) -> DataFrame:
    """The reads that are not in a."""
    return reads.select(*KEYS).join(a, KEYS, "left_anti")


@dataclass(frozen=True)
class Vector:
    """A set of the reads 0 to size - 1 of one read set, as rows (read_set, read_id)."""

    ids: DataFrame
    size: int
    comment: str = ""
    read_set: str = ""

    @staticmethod
    def of(spark: SparkSession, size: int, value: bool = False, read_set: str = "") -> Vector:
        """None of the reads, or all."""
        return Vector(spark.range(size if value else 0).select(F.lit(read_set).alias("read_set"), F.col("id").alias("read_id")), size, read_set=read_set)

    def _with(self, other: Vector, made: DataFrame) -> Vector:
        if self.size != other.size:
            raise ValueError(f"sizes differ: {self.size} and {other.size}")
        return replace(self, ids=made)

    def __and__(self, other: Vector) -> Vector:
        return self._with(other, both(self.ids, other.ids))

    def __or__(self, other: Vector) -> Vector:
        return self._with(other, either(self.ids, other.ids))

    def __sub__(self, other: Vector) -> Vector:
        return self._with(other, minus(self.ids, other.ids))

    def __invert__(self) -> Vector:
        return replace(self, ids=complement(self.ids, Vector.of(self.ids.sparkSession, self.size, True, self.read_set).ids))

    def _given(self, ids: DataFrame) -> Vector:
        known = ids.select(F.lit(self.read_set).alias("read_set"), F.col("read_id").cast("long").alias("read_id")).where((F.col("read_id") >= 0) & (F.col("read_id") < self.size))
        return replace(self, ids=known)

    def set(self, ids: DataFrame) -> Vector:
        """With the reads of ids (read_id), too; those beyond the size are left out."""
        return self | self._given(ids)

    def reset(self, ids: DataFrame) -> Vector:
        """Without them."""
        return self - self._given(ids)

    def test(self, ids: DataFrame) -> DataFrame:
        """ids with `is_set`."""
        return ids.join(self.ids.select("read_id", F.lit(True).alias("is_set")).distinct(), "read_id", "left").withColumn("is_set", F.coalesce("is_set", F.lit(False)))


def cardinality(a: DataFrame) -> DataFrame:
    """(read_set, ones)."""
    return a.groupBy("read_set").agg(F.count("*").alias("ones"))


def vector_size(found: DataFrame) -> DataFrame:
    """(read_set, size): one more than the highest query id."""
    return found.groupBy("read_set").agg((F.max("query_id") + 1).alias("size"))


def extract_reads(reads: DataFrame, chosen: DataFrame) -> DataFrame:
    return reads.join(chosen, KEYS, "left_semi")


def pack_words(chosen: DataFrame) -> DataFrame:
    """(read_set, word, bits): the set as 32-bit words, bit i of word w for read 32 w + i. Many rows fold into few before they are shuffled."""
    return chosen.groupBy("read_set", F.floor(F.col("read_id") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(read_id % 32 as int))")).alias("bits"))


#: Reads whose bits a task packs or unpacks at once (a multiple of 8).
CHUNK = 1 << 20


def _packed(size: int):
    def kernel(table: pa.Table) -> pa.Table:
        ids = table.column("read_id").to_numpy()
        chunk = int(ids[0]) // CHUNK
        bits = np.zeros(min(CHUNK, (size // 8 + 1) * 8 - chunk * CHUNK), np.uint8)
        bits[ids - chunk * CHUNK] = 1
        return pa.table({"chunk": [chunk], "data": [np.packbits(bits, bitorder="little").tobytes()]})

    return kernel


def write_vector(chosen: DataFrame, path: str, size: int, comment: str = "") -> None:
    """One read set as a file: comment lines, `#size`, then size / 8 + 1 bytes, the lowest bit first.

    Tasks pack the bits, CHUNK reads at a time; their bytes (an eighth of a byte a read) go to the file in order, one
    chunk in memory. Reads beyond the size are left out. path: of any file system.
    """
    ids = chosen.where((F.col("read_id") >= 0) & (F.col("read_id") < size)).select("read_id").distinct()
    packed = ids.withColumn("of", F.expr(f"read_id div {CHUNK}")).groupBy("of").applyInArrow(_packed(size), "chunk long, data binary")
    system, name = file_system(path)
    with system.open_output_stream(name, compression=None) as out:
        text = comment if not comment or comment.endswith("\n") else comment + "\n"
        out.write(text.encode() + f"#{size}\n".encode())
        at, end = 0, size // 8 + 1
        for row in packed.orderBy("chunk").toLocalIterator():
            _fill(out, row["chunk"] * CHUNK // 8 - at)
            out.write(bytes(row["data"]))
            at = row["chunk"] * CHUNK // 8 + len(row["data"])
        _fill(out, end - at)


def _fill(out, n: int) -> None:
    while n > 0:
        n -= out.write(bytes(min(n, 1 << 20)))


def _unpacked(path: str, begin: int, size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = file_system(path)
        with system.open_input_file(name) as file:
            for batch in batches:
                for chunk in batch.column("id").to_pylist():
                    file.seek(begin + chunk * CHUNK // 8)
                    bits = np.unpackbits(np.frombuffer(file.read(CHUNK // 8), np.uint8), bitorder="little")[: size - chunk * CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits) + chunk * CHUNK)], ["read_id"])

    return kernel


def read_vector(spark: SparkSession, path: str, read_set: str = "") -> Vector:
    """A vector file; the driver reads its comment and size, tasks unpack its bits, CHUNK reads at a time."""
    ship(spark)
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        comment, rest = b"", b""
        while True:
            more = file.read(1 << 16)
            rest += more
            while b"\n" in rest and not rest.startswith(b"#"):
                line, _, rest = rest.partition(b"\n")
                comment += line + b"\n"
            if rest.startswith(b"#") and b"\n" in rest:
                break
            if not more:
                raise ValueError(f"{path} has no size")
        line = rest.partition(b"\n")[0]
        size, begin = int(line[1:]), len(comment) + len(line) + 1
        if file.size() - begin < size // 8:
            raise ValueError(f"{path} is cut short")
    chunks = -(-size // CHUNK)
    ids = spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInArrow(_unpacked(path, begin, size), "read_id long")
    return Vector(ids.select(F.lit(read_set).alias("read_set"), "read_id"), size, comment.decode(), read_set)
