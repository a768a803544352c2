"""Aggregates over runs of equal neighbours in the order of lines, and canonical forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import aligned_ratio
from ..tables import free_names

#: Line numbers of a part of a file; parts are looked at side by side.
LINES = 1 << 20


def _parts(lines: DataFrame, order: str, part: str) -> DataFrame:
    return lines.withColumn(part, F.floor(F.col(order) / LINES))


def _carried(rows: DataFrame, part: str, value, name: str) -> DataFrame:
    """(part, name): the last value (an aggregate, null for none) of the parts before; one row a part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(part).agg(value.alias(name)).select(part, F.last(name, ignorenulls=True).over(before).alias(name))


def with_previous(lines: DataFrame, columns: list[str], name: str, order: str = "line_no") -> DataFrame:
    """lines with a column of that name, the columns of the line before in the order of the whole file (null for the first).

    Line numbers may have gaps, as where comments have been dropped. Each part of a file is sorted by itself; what the
    first line of a part follows comes from one row a part.
    """
    part, carried = free_names(lines, "part", "carried")
    rows = _parts(lines, order, part)
    now = F.struct(*columns)
    before = F.broadcast(_carried(rows, part, F.max_by(now, order), carried))
    return rows.withColumn(name, F.lag(now).over(Window.partitionBy(part).orderBy(order))).join(before, part).withColumn(name, F.coalesce(name, carried)).select(*lines.columns, name)


def run_max(blast: DataFrame, threshold: float, query: str = "qseqid", target: str = "sseqid", order: str = "line_no") -> DataFrame:
    """(run, qseqid, sseqid, ratio): the greatest aligned ratio of each run of lines with equal (query, target), from threshold on.

    A run is named by the number of its first line. A line of another pair ends it, whatever its query.
    """
    pair = F.struct(F.col(query), F.col(target))
    was, first, part, carried = free_names(blast, "was", "first", "part", "carried")
    rows = with_previous(blast, [query, target], was, order).withColumn(first, F.when(F.col(was).isNull() | (F.col(was) != pair), F.col(order)))
    rows = _parts(rows, order, part)
    before = F.broadcast(_carried(rows, part, F.max(first), carried))
    own = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.max(first).over(own)).join(before, part).withColumn("run", F.coalesce("run", carried))
    ratio = aligned_ratio(F.col("pident"), F.col("length"), F.col("qlen"))
    return runs.groupBy("run", F.col(query).alias("qseqid"), F.col(target).alias("sseqid")).agg(F.max(ratio).alias("ratio")).where(F.col("ratio") >= threshold)


def first_of_runs(found: DataFrame, order: str = "line_no") -> DataFrame:
    """Without links to itself, the first of neighbouring links with the same query and target, in the order of the whole file."""
    (was,) = free_names(found, "was")
    rows = with_previous(found.where("query_id <> target_id"), ["query_id", "target_id"], was, order)
    return rows.where(F.col(was).isNull() | (F.col(was) != F.struct("query_id", "target_id"))).select(found.columns)


def uniform(found: DataFrame, order: str = "line_no", of: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(of, targets): for each query its targets in order as `id-span`; of a repeated target the last counts.

    of: what tells queries apart; besides query_id the read set or the line, where ids repeat in several of them.
    """
    last = found.groupBy(*of, "target_id").agg(F.max_by("span", order).alias("span"))
    row = F.array_sort(F.collect_list(F.struct("target_id", "span")))
    return last.groupBy(*of).agg(F.array_join(F.transform(row, lambda x: F.concat_ws("-", x["target_id"].cast("string"), x["span"].cast("string"))), " ").alias("targets"))
