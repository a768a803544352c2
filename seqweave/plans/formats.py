"""Results as lines of text, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import prefix, reverse_complement, suffix


def six(c: Column) -> Column:
    """A number in single precision, not negative, with six decimals: exact halves go to the even digit, as C prints them (Java rounds them up)."""
    millionths = F.rint(c.cast("double") * 1_000_000).cast("long")  # the product of 24 and 14 bits is exact
    rest = millionths % 1_000_000
    return F.concat(((millionths - rest) / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))


def link_lines(found: DataFrame) -> DataFrame:
    """(read_set, query_id, line): `q:t-span-pct t-span-pct `, targets in order."""
    one = F.struct("target_id", F.concat(F.concat_ws("-", F.col("target_id").cast("string"), F.col("span").cast("string"), six(F.col("pct"))), F.lit(" ")).alias("text"))
    rows = found.groupBy("read_set", "query_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return rows.select("read_set", "query_id", F.concat(F.col("query_id").cast("string"), F.lit(":"), F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("line"))


def any_link_lines(found: DataFrame) -> DataFrame:
    """(read_set, query_id, line): `q:t t `, targets in order."""
    rows = found.groupBy("read_set", "query_id").agg(F.array_sort(F.collect_list("target_id")).alias("t"))
    return rows.select("read_set", "query_id", F.concat(F.col("query_id").cast("string"), F.lit(":"), F.array_join(F.transform("t", lambda x: F.concat(x.cast("string"), F.lit(" "))), "")).alias("line"))


def link_id_lines(found: DataFrame) -> DataFrame:
    """(read_set, query_id, line): `q pct`."""
    return found.select("read_set", "query_id", F.concat_ws(" ", F.col("query_id").cast("string"), F.col("max_pct").cast("string")).alias("line"))


def count_lines(found: DataFrame) -> DataFrame:
    """(read_set, query_id, line): `q mean median min max pct` or `q none`."""
    full = F.concat_ws(" ", F.col("query_id").cast("string"), six(F.col("mean")), *(F.col(c).cast("string") for c in ("median", "min", "max")), six(F.col("pct")))
    return found.select("read_set", "query_id", F.when(F.col("mean").isNull(), F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("none"))).otherwise(full).alias("line"))


# Fixed formats: the three headers below, and the lines of the DOT and XGMML graphs further down.


def link_header(k: int, bank: str, ids_only: bool = False) -> str:
    first = "#query_read_id " if ids_only else f"#query_read_id [target_read_id-kmer_span (k={k})-kmer_span query_percentage]* or U (unvalid read, containing not only ACGT characters or low complexity read)"
    return f"{first}\n#Target read set: {bank}"


def set_header(read_set: Column) -> Column:
    return F.concat(F.lit("#Query read set number "), read_set)


def count_header(read_set: Column, k: int, bank: str) -> Column:
    return F.concat(F.lit("#query_read_id (from bank "), read_set, F.lit(f") mean median min max percentage_shared_positions -- number of shared {k}mers with banq {bank}"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, set_headers: Column | None = None) -> None:
    """lines as text files, sorted by read set and query; header first, and before each read set its own header line.

    Rows are dealt by ranges of (read_set, query_id), so that the files in order are the whole text; no file holds all of it.
    """
    spark = lines.sparkSession
    rows = lines.select("read_set", "query_id", F.lit(2).alias("rank"), "line")
    if set_headers is not None:
        sets = lines.select("read_set").distinct()
        rows = rows.union(sets.select("read_set", F.lit(None).cast("long").alias("query_id"), F.lit(1).alias("rank"), set_headers.alias("line")))
    if header:
        rows = rows.union(spark.createDataFrame([(None, None, 0, header)], "read_set string, query_id long, rank int, line string"))
    order = [F.col("read_set").asc_nulls_first(), F.col("rank").asc(), F.col("query_id").asc_nulls_first()]
    rows.orderBy(*order).select("line").write.mode("overwrite").text(path)


def fasta_lines(reads: DataFrame) -> DataFrame:
    """(read_set, query_id, line): FASTA records, or FASTQ where there is a quality."""
    fastq = F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    fasta = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq"))
    return reads.select("read_set", F.col("read_id").alias("query_id"), F.coalesce(fastq, fasta).alias("line"))


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads in FASTA."""
    write_lines(fasta_lines(reads.withColumn("qual", F.lit(None).cast("string"))), path)


def ends(reads: DataFrame, size: int) -> DataFrame:
    """(read_id, header, length, first, last, head, tail): prefixes and true suffixes of so many bases, and of ten."""
    seq = F.col("seq")
    return reads.select("read_id", "header", F.length(seq).alias("length"), prefix(seq, size).alias("first"), suffix(seq, size).alias("last"), prefix(seq, 10).alias("head"), suffix(seq, 10).alias("tail"))


def with_ends(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found with the ends of both reads (q_ and t_)."""
    out = found
    for side, key in (("q", "query_id"), ("t", "target_id")):
        own = nodes.select(F.col("read_id").alias(key), *(F.col(c).alias(f"{side}_{c}") for c in ("header", "first", "last")))
        out = out.join(own, key)
    return out


def apart(found: DataFrame) -> DataFrame:
    """Links between different reads that don't share an end: first or last bases, or one's reversed in the other. found: with_ends()."""
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    return found.where((F.col("query_id") != F.col("target_id")) & (q("first") != t("first")) & (q("last") != t("last")) & (reverse_complement(t("first")) != q("last")) & (reverse_complement(t("last")) != q("first")))


def prefix_suffix() -> Column:
    """Whether the ends of a pair of with_ends() meet, straight or reversed."""
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    return (t("first") == q("last")) | (t("last") == q("first")) | (reverse_complement(t("first")) == q("first")) | (reverse_complement(t("last")) == q("last"))


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain_number(c: Column) -> Column:
    """A percentage with two decimals at most."""
    return F.round(c.cast("double"), 2).cast("string")


def dot_nodes(nodes: DataFrame) -> DataFrame:
    label = F.concat(F.replace("header", F.lit('"'), F.lit('\\"')), F.lit("_len_"), F.col("length").cast("string"), F.lit("_"), F.col("head"), F.lit("..."), F.col("tail"))
    return nodes.select(F.concat(F.col("read_id").cast("string"), F.lit('[ label="'), label, F.lit('"];')).alias("line"))


def dot_edges(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.col("query_id").cast("string"), F.lit(" -> "), F.col("target_id").cast("string"), F.lit(' [label="'), plain_number(F.col("pct")), F.lit('"];')).alias("line"))


def xgmml_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.concat(
            F.lit('<node id="'), F.col("read_id").cast("string"), F.lit('" label="'), xml(F.col("header")), F.lit('">\n<att type="string" name="start_stop" value="'), xml(F.col("head")), F.lit("..."), xml(F.col("tail")),
            F.lit('"/>\n<att type="integer" name="length" value="'), F.col("length").cast("string"), F.lit('"/>\n</node>'),
        ).alias("line")
    )


def xgmml_edges(found: DataFrame) -> DataFrame:
    return found.select(
        F.concat(
            F.lit('<edge source="'), F.col("query_id").cast("string"), F.lit('" target="'), F.col("target_id").cast("string"), F.lit('" label="'), plain_number(F.col("pct")),
            F.lit('">\n<att type="boolean" name="prefix_suffix" value="'), F.when(prefix_suffix(), "True").otherwise("False"), F.lit('"/>\n</edge>'),
        ).alias("line")
    )


def _write_parts(parts: list[DataFrame], path: str) -> None:
    out = parts[0].select(F.lit(0).alias("rank"), "line")
    for k, part in enumerate(parts[1:], 1):
        out = out.union(part.select(F.lit(k).alias("rank"), "line"))
    out.orderBy("rank", "line").select("line").write.mode("overwrite").text(path)


def _one(df: DataFrame, line: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(line,)], "line string")


def write_dot(reads: DataFrame, found: DataFrame, path: str, size: int = 90, drop_similar: bool = True) -> None:
    """A DOT graph: nodes, then edges."""
    nodes = ends(reads, size)
    pairs = with_ends(found, nodes)
    _write_parts([_one(reads, "digraph links {"), dot_nodes(nodes), dot_edges(apart(pairs) if drop_similar else pairs), _one(reads, "}")], path)


def write_xgmml(reads: DataFrame, found: DataFrame, path: str, size: int = 60, drop_similar: bool = True, label: str = "links") -> None:
    """An XGMML graph: nodes, then edges to targets that don't come before the query."""
    nodes = ends(reads, size)
    pairs = with_ends(found.where("target_id >= query_id"), nodes)
    head = f'<?xml version="1.0"?>\n<graph label="{label}" xmlns="http://www.cs.rpi.edu/XGMML" directed="1">'
    _write_parts([_one(reads, head), xgmml_nodes(nodes), xgmml_edges(apart(pairs) if drop_similar else pairs), _one(reads, "</graph>")], path)
