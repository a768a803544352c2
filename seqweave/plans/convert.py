"""Results turned into reads, pairs of reads, headers and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import basename, header_token
from ..operators.counter import mean_between, pct_at_least
from ..operators.linker import without_self
from ..operators.readsets import extract_reads, selected_by_links
from .formats import fasta_lines, plain_number, six


#: The line before a couple of reads (fixed format).
COUPLE = "################################ NEW COUPLE (%d/%d:%s percent similarity)+##############################"


def linked_reads(found: DataFrame, reads: DataFrame) -> DataFrame:
    """The reads with a link, whatever the form of the result."""
    return extract_reads(reads, found.select("read_set", F.col("query_id").alias("read_id")).distinct())


def _record(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def pairs_with_reads(found: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """found with q_header, q_seq, t_header and t_seq."""
    q = queries.select("read_set", F.col("read_id").alias("query_id"), F.col("header").alias("q_header"), F.col("seq").alias("q_seq"))
    t = targets.select(F.col("read_id").alias("target_id"), F.col("header").alias("t_header"), F.col("seq").alias("t_seq"))
    return found.join(q, ["read_set", "query_id"]).join(t, "target_id")


def read_pairs(found: DataFrame, queries: DataFrame, targets: DataFrame, drop_self: bool = True) -> DataFrame:
    """(read_set, query_id, target_id, line): a separator that names the couple, and the two reads."""
    pairs = pairs_with_reads(without_self(found) if drop_self else found, queries, targets)
    head = F.format_string(COUPLE, F.col("query_id"), F.col("target_id"), plain_number(F.col("pct")))
    return pairs.select("read_set", "query_id", "target_id", F.concat_ws("\n", head, _record(F.col("q_header"), F.col("q_seq")), _record(F.col("t_header"), F.col("t_seq"))).alias("line"))


def header_pairs(found: DataFrame, queries: DataFrame, targets: DataFrame, drop_self: bool = True) -> DataFrame:
    """(read_set, query_id, target_id, line): `query:target-span-similarity` by first words of headers."""
    pairs = pairs_with_reads(without_self(found) if drop_self else found, queries, targets)
    line = F.concat(header_token(F.col("q_header")), F.lit(":"), header_token(F.col("t_header")), F.lit("-"), F.col("span").cast("string"), F.lit("-"), plain_number(F.col("pct")), F.lit(" "))
    return pairs.select("read_set", "query_id", "target_id", line.alias("line"))


def mosaic(found: DataFrame, queries: DataFrame, targets: DataFrame, threshold: float = 0, drop_self: bool = True) -> DataFrame:
    """(qseqid, sseqid, evalue, pident) of links of at least threshold percent."""
    kept = (without_self(found) if drop_self else found).where(F.col("pct") >= threshold)
    pairs = pairs_with_reads(kept, queries, targets)
    return pairs.select(header_token(F.col("q_header")).alias("qseqid"), header_token(F.col("t_header")).alias("sseqid"), F.lit(0.0).alias("evalue"), F.col("pct").cast("double").alias("pident"))


def write_mosaic(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, sep="\t", header=True)


def counted_reads(found: DataFrame, reads: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """Reads whose mean lies between the bounds, the counts added to their headers: `header_cov_mean_median_min_max_pct`."""
    rows = mean_between(found, low, high).withColumnRenamed("query_id", "read_id")
    note = F.concat_ws("_", F.lit("cov"), six(F.col("mean")), *(F.col(c).cast("string") for c in ("median", "min", "max")), six(F.col("pct")))
    return reads.join(rows, ["read_set", "read_id"]).select("read_set", "read_id", F.concat_ws("_", "header", note).alias("header"), "seq", "qual")


def well_covered_reads(found: DataFrame, reads: DataFrame, threshold: float) -> DataFrame:
    """Reads of which at least threshold percent is covered, and `file`, the last part of their read set's name."""
    chosen = pct_at_least(found, threshold).select("read_set", F.col("query_id").alias("read_id")).distinct()
    return extract_reads(reads, chosen).withColumn("file", basename(F.col("read_set")))


def write_well_covered(found: DataFrame, reads: DataFrame, threshold: float, path: str) -> None:
    """Text files in a folder for each read set, path/file=<last part of its name>, in the order of read ids."""
    kept = well_covered_reads(found, reads, threshold)
    lines = fasta_lines(kept).join(kept.select("read_set", "file").distinct(), "read_set")
    ordered = lines.repartitionByRange("file", "query_id").sortWithinPartitions("file", "query_id")
    ordered.select("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def vector_reads(found: DataFrame, reads: DataFrame, threshold: float) -> DataFrame:
    """Reads with a link of at least threshold percent."""
    return extract_reads(reads, selected_by_links(found, threshold))
