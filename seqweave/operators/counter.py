"""Counter: how often the k-mers of each query read occur in the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import effective_window, percentage
from .complexity import complex_reads
from .coverage import full_span, window_span
from .index import Index
from .kmers import kmers


def counts(queries: DataFrame, index: Index, threshold: float = 75, window: int = 0, keep_low_complexity: bool = False) -> DataFrame:
    """(read_set, query_id, mean, median, min, max, pct) of query reads of which enough percent of the best window is covered.

    All places count, k-mers that the bank lacks as 0. The median of an even number is the upper one. With
    keep_low_complexity, reads without k-mers have a row of nulls; else they are left out with the low-complexity ones.
    """
    k = index.k
    kept = queries if keep_low_complexity else complex_reads(queries, k)
    # only the k-mers that the index has are joined; how many others there are follows from the read's length
    found = kmers(kept, k, index.known).where("kmer is not null").join(index.table, "kmer")
    # a read has at most 255 values: their counts, not the places' values, are gathered, and the places that are covered
    read = ["read_set", "read_id", "n"]
    valued = found.groupBy(*read, F.col("abundance").alias("v")).agg(F.count("*").alias("c"), F.collect_list("pos").alias("at"))
    grouped = valued.groupBy(*read).agg(
        F.sum("c").alias("known"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.sort_array(F.collect_list(F.struct("v", "c"))).alias("values"), F.flatten(F.collect_list("at")).alias("positions"),
    )
    if threshold <= 0:  # reads without any of the bank's k-mers pass, too
        all_ = kept.where(F.length("seq") >= k).select("read_set", "read_id", F.length("seq").alias("n"))
        grouped = all_.join(grouped, read, "left")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
    none = F.array().cast("array<struct<v:int,c:bigint>>")
    grouped = grouped.select("read_set", F.col("read_id").alias("query_id"), "n", (F.col("n") - k + 1).cast("long").alias("places"), zero("known", "long"), zero("total", "long"), zero("min", "int"), zero("max", "int"), F.coalesce("values", none).alias("values"), F.coalesce("positions", F.array().cast("array<int>")).alias("positions"))
    missing = F.col("places") - F.col("known")
    grouped = grouped.withColumn("min", F.when(missing > 0, F.lit(0)).otherwise(F.col("min"))).withColumn("values", F.when(missing > 0, F.concat(F.array(F.struct(F.lit(0).alias("v"), missing.alias("c"))), "values")).otherwise(F.col("values")))
    half = F.floor(F.col("places") / 2)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("value"))
    upper = F.aggregate("values", start, lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.when(acc["value"].isNull() & (acc["seen"] + x["c"] > half), x["v"]).otherwise(acc["value"]).alias("value")))
    span = full_span(F.col("positions"), k) if window <= 0 else window_span(k, window)("positions", "n")
    out = grouped.select(
        "read_set", "query_id", (F.col("total") / F.col("places")).cast("float").alias("mean"), upper["value"].alias("median"), "min", "max",
        percentage(span, effective_window(F.col("n"), window)).alias("pct"),
    ).where(F.col("pct") >= F.lit(float(threshold)).cast("float"))
    return out.union(uncounted(queries, k)) if keep_low_complexity else out


def uncounted(queries: DataFrame, k: int) -> DataFrame:
    """(read_set, query_id, mean, median, min, max, pct) of the reads without k-mers, which have nothing to count: a row of nulls each."""
    values = {"mean": "float", "median": "int", "min": "int", "max": "int", "pct": "float"}
    return queries.where(F.coalesce(F.length("seq"), F.lit(0)) < k).select("read_set", F.col("read_id").alias("query_id"), *(F.lit(None).cast(t).alias(c) for c, t in values.items()))


def mean_between(found: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """Rows whose mean lies between the bounds, both included and in single precision like the mean."""
    bound = lambda x: F.lit(float(x)).cast("float")
    return found.where((F.col("mean") >= bound(low)) & (F.lit(True) if high is None else F.col("mean") <= bound(high)))


def pct_at_least(found: DataFrame, threshold: float) -> DataFrame:
    return found.where(F.col("pct") >= F.lit(float(threshold)).cast("float"))
