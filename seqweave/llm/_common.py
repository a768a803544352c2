"""Helpers that the operators share: shared folders, written tables and bounded Arrow blocks."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import raw, small_batches
from ..session import run_folder

__all__ = ["blocks", "fits", "free_names", "give_back", "held", "joined_by_group", "raw", "row_key", "sent", "shared_dir", "small_batches", "tidy", "without", "written"]

#: Bytes of text that a kernel works on at once.
BLOCK_BYTES = 1 << 19
#: Keys that are broadcast at most, and their bytes.
BROADCAST, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows of a group from which on it is joined by broadcast, and such groups at most.
LARGE_GROUP, MOST_GROUPS = 200, 100_000
#: What a worker keeps between tasks, by kind of kernel.
_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What this worker keeps between tasks for one kind of kernel. What it kept for other kinds goes, since workers serve stage after stage."""
    for other in [k for k in _held if k != owner]:
        del _held[other]
    return _held.setdefault(owner, {})


def give_back() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The kernel, which at its end gives freed memory back to the system: workers stay and count when they are idle, too."""

    @functools.wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which a session on a cluster must name."""
    base = run_folder(spark)
    if "://" not in base:  # the file system that Spark takes it to be on, spelt out for Python workers
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///", 1) if "://" not in base else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df lacks (in any case), each like the wanted one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        k = 0
        while (own := f"__{name}{k or ''}").lower() in taken:
            k += 1
        taken.add(own.lower())
        out.append(own)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """What a row is judged by: its id and 128 bits of its text. Rows with the same key are one document that repeats; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(17), text)))


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 a number, 16 and its bytes a string or list."""

    def one(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(8)

    return sum((one(f) for f in df.schema.fields), F.lit(0)).cast("long")


def fits(small: DataFrame, most: int | None = None) -> bool:
    """Whether a written table is small enough to be broadcast, by rows and bytes."""
    row = small.agg(F.count("*").alias("rows"), F.coalesce(F.sum(_bytes(small)), F.lit(0)).alias("bytes")).first()
    return row["rows"] <= (BROADCAST if most is None else most) and row["bytes"] <= BROADCAST_BYTES


def sent(small: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows (BROADCAST if not given) and BROADCAST_BYTES."""
    return F.broadcast(small) if fits(small, most) else small


def without(docs: DataFrame, id_col: str, text_col: str, rejected) -> DataFrame:
    """docs, all columns, without the rows whose key is in rejected(docs with the key, name of the key). Each row is judged by its own text."""
    (key,) = free_names(docs, "key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    gone = written(rejected(keyed, key).distinct(), "rejected")
    return keyed.join(sent(gone), key, "left_anti").select(docs.columns)


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, count: str = "n", how: str = "inner") -> DataFrame:
    """rows.join(groups, key, how) of written tables, groups having one row a key (of fixed size) and the number of its rows: the rows of large groups meet in no task.

    Few groups are broadcast. Of many, those of more than LARGE_GROUP rows (or a MOST_GROUPS-th of all rows, so that they
    are that few) are broadcast, and only the rows of others are shuffled.
    """
    if fits(groups):
        return rows.join(F.broadcast(groups), key, how)
    limit = max(LARGE_GROUP, int(groups.agg(F.sum(count)).first()[0] // MOST_GROUPS))
    (mark,) = free_names(rows, "large")
    large = groups.where(F.col(count) > limit).withColumn(mark, F.lit(True))
    marked = rows.join(F.broadcast(large), key, "left")
    rest = marked.where(F.col(mark).isNull()).select(rows.columns).join(groups.where(F.col(count) <= limit), key, how)
    return marked.where(F.col(mark)).drop(mark).unionByName(rest)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most size bytes in the column, or one row."""
    _, off = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
