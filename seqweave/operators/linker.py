"""Linker: for each query read, the bank reads that share enough of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import effective_window, percentage
from .complexity import complex_reads
from .coverage import full_span, sparse_window, window_span
from .index import Index
from .kmers import kmers


def _hits(queries: DataFrame, index: Index, keep_low_complexity: bool) -> DataFrame:
    kept = queries if keep_low_complexity else complex_reads(queries, index.k)
    return kmers(kept, index.k, index.known).where("kmer is not null").join(index.table, "kmer")


def any_links(queries: DataFrame, index: Index, keep_low_complexity: bool = False) -> DataFrame:
    """(read_set, query_id, target_id): pairs that share a k-mer."""
    return _hits(queries, index, keep_low_complexity).select("read_set", F.col("read_id").alias("query_id"), "target_id").distinct()


def links(queries: DataFrame, index: Index, threshold: float = 75, window: int = 0, keep_low_complexity: bool = False, zero_window: int = 0, zero_threshold: int = 80) -> DataFrame:
    """(read_set, query_id, target_id, span, pct): pairs whose shared k-mers cover at least threshold percent of the best window of the query.

    window 0: the whole read. Pairs with a window of zero_window bases that is too empty are left out. With a threshold of
    0 or below use any_links, as links_for does.
    """
    k = index.k
    pairs = _hits(queries, index, keep_low_complexity).groupBy("read_set", F.col("read_id").alias("query_id"), "target_id").agg(F.first("n").alias("n"), F.collect_set("pos").alias("positions"))
    if zero_window > 0:
        pairs = pairs.where(~sparse_window(k, zero_window, zero_threshold)("positions", "n"))
    span = full_span(F.col("positions"), k) if window <= 0 else window_span(k, window)("positions", "n")
    out = pairs.select("read_set", "query_id", "target_id", span.alias("span"), effective_window(F.col("n"), window).alias("size"))
    out = out.withColumn("pct", percentage(F.col("span"), F.col("size"))).where(F.col("pct") >= F.lit(float(threshold)).cast("float"))
    return out.select("read_set", "query_id", "target_id", "span", "pct")


def links_for(queries: DataFrame, index: Index, threshold: float = 75, **options) -> DataFrame:
    """links, or any_links if the threshold is 0 or below (which takes precedence over windows)."""
    return any_links(queries, index, options.get("keep_low_complexity", False)) if threshold <= 0 else links(queries, index, threshold, **options)


def linked_ids(queries: DataFrame, index: Index, threshold: float = 75, **options) -> DataFrame:
    """(read_set, query_id, max_pct): query reads with a link, and the percentage of the best, cut to a whole number."""
    return links(queries, index, threshold, **options).groupBy("read_set", "query_id").agg(F.max("pct").cast("int").alias("max_pct"))


def without_self(found: DataFrame) -> DataFrame:
    return found.where("query_id <> target_id")


def upper_triangle(found: DataFrame) -> DataFrame:
    return found.where("target_id >= query_id")
