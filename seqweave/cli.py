"""Commands: index a bank, link or count query reads, make vectors and reads of the results, and convert results.

python -m seqweave.cli link-index BANK INDEX | count-index BANK INDEX | link INDEX ALBUM OUT | count INDEX ALBUM OUT | extract LINKS BANK OUT
| vector RESULT TYPE OUT | extract-vector BANK VECTOR OUT | convert KIND RESULT BANK OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import counter, index, linker, readsets, runs
from .plans import convert, formats
from .sources import reads, results


#: What a result file is turned into.
CONVERSIONS = ("reads", "pairs", "headers", "mosaic", "dot", "xgmml", "counted-reads", "covered-reads", "uniform")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seqweave", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("link-index", "count-index"):
        p = commands.add_parser(name)
        p.add_argument("bank")
        p.add_argument("index")
        p.add_argument("-k", type=int, default=31, choices=range(2, 32), metavar="2..31")
        p.add_argument("-a", "--abundance-min", type=int, default=2)
    for name in ("link", "count"):
        p = commands.add_parser(name)
        p.add_argument("index")
        p.add_argument("album", help="a file of paths, one read set a line")
        p.add_argument("out")
        p.add_argument("-s", "--threshold", type=float, default=75)
        p.add_argument("-w", "--window", type=int, default=0)
    commands.choices["link"].add_argument("-r", "--ids-only", action="store_true")
    commands.choices["link"].add_argument("--zero-window", type=int, default=0)
    commands.choices["link"].add_argument("--zero-threshold", type=int, default=80)
    p = commands.add_parser("extract")
    p.add_argument("links")
    p.add_argument("bank")
    p.add_argument("out")
    p.add_argument("-s", "--threshold", type=float, default=75)
    p = commands.add_parser("vector")
    p.add_argument("result")
    p.add_argument("type", choices=["l", "c"], help="a result of link or of count")
    p.add_argument("out")
    p.add_argument("-s", "--threshold", type=float, default=75)
    p = commands.add_parser("extract-vector")
    p.add_argument("bank")
    p.add_argument("vector")
    p.add_argument("out")
    p = commands.add_parser("convert")
    p.add_argument("kind", choices=list(CONVERSIONS))
    p.add_argument("result", help="of reads that were compared with themselves, for kinds that show pairs")
    p.add_argument("bank")
    p.add_argument("out")
    p.add_argument("-s", "--threshold", type=float, default=0)
    p.add_argument("--most", type=float, help="greatest mean, for counted-reads")
    for name, p in commands.choices.items():
        p.add_argument("-l", "--keep-low-complexity", action="store_true")
        for flag in ("-f", "-G", "-t"):  # tuning of another kind of index; nothing to tune here
            p.add_argument(flag, type=int, help="accepted, without effect")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("seqweave").getOrCreate()
    if a.command.endswith("-index"):
        make = index.linker_index if a.command == "link-index" else index.counter_index
        make(reads.read_bank(spark, a.bank), a.k, a.abundance_min, a.keep_low_complexity).checked().save(a.index)
        return
    if a.command == "extract":
        bank = reads.read_bank(spark, a.bank)
        found = results.read_links(spark.read.text(a.links), "links", "ids").withColumn("read_set", F.lit(a.bank))
        formats.write_reads(readsets.extract_reads(bank, readsets.selected_by_links(found, a.threshold)), a.out)
        return
    if a.command == "vector":
        lines = spark.read.text(a.result)
        found = (results.read_links(lines, "links", "ids") if a.type == "l" else results.parse_counts(lines)).withColumn("read_set", F.lit(""))
        chosen = readsets.selected_by_links(found, a.threshold) if a.type == "l" else readsets.selected_by_counts(found, a.threshold)
        size = readsets.vector_size(found).first()
        readsets.write_vector(chosen, a.out, size["size"] if size else 0, f"Boolean vector of {a.result} with threshold {a.threshold:g}")
        return
    if a.command == "extract-vector":
        formats.write_reads(readsets.extract_reads(reads.read_bank(spark, a.bank), readsets.read_vector(spark, a.vector, a.bank).ids), a.out)
        return
    if a.command == "convert":
        convert_result(spark, a)
        return
    stored, queries = index.load_index(spark, a.index), reads.read_album(spark, a.album)
    if a.command == "count":
        found = counter.counts(queries, stored, a.threshold, a.window, a.keep_low_complexity)
        formats.write_lines(formats.count_lines(found), a.out, None, formats.count_header(F.col("read_set"), stored.k, a.index))
        return
    options = {"window": a.window, "keep_low_complexity": a.keep_low_complexity, "zero_window": a.zero_window, "zero_threshold": a.zero_threshold}
    header = formats.set_header(F.col("read_set"))
    if a.threshold <= 0:
        lines = formats.any_link_lines(linker.any_links(queries, stored, a.keep_low_complexity))
    elif a.ids_only:
        lines = formats.link_id_lines(linker.linked_ids(queries, stored, a.threshold, **options))
    else:
        lines = formats.link_lines(linker.links(queries, stored, a.threshold, **options))
    formats.write_lines(lines, a.out, formats.link_header(stored.k, a.index, a.ids_only and a.threshold > 0), header)


def convert_result(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes what a result file of the bank's reads is turned into."""
    lines, bank = spark.read.text(a.result), reads.read_bank(spark, a.bank)
    counted = a.kind in ("counted-reads", "covered-reads")
    if a.kind == "uniform":  # each line for itself: an id may have lines in several read sets
        lines = lines.withColumn("line", F.monotonically_increasing_id())
    forms = ("links", "any", "ids") if a.kind == "reads" else ("links",)
    found = (results.parse_counts(lines) if counted else results.read_links(lines, *forms)).withColumn("read_set", F.lit(a.bank))
    if a.kind == "reads":
        formats.write_reads(convert.linked_reads(found, bank), a.out)
    elif a.kind in ("pairs", "headers"):
        formats.write_lines((convert.read_pairs if a.kind == "pairs" else convert.header_pairs)(found, bank, bank), a.out)
    elif a.kind == "mosaic":
        convert.write_mosaic(convert.mosaic(found, bank, bank, a.threshold), a.out)
    elif a.kind == "dot":
        formats.write_dot(bank, found, a.out)
    elif a.kind == "xgmml":
        formats.write_xgmml(bank, found, a.out)
    elif a.kind == "uniform":
        shown = runs.uniform(found, "place", ("line", "query_id")).orderBy("line").select(F.concat_ws(":", F.col("query_id").cast("string"), "targets").alias("line"))
        shown.write.mode("overwrite").text(a.out)
    elif a.kind == "counted-reads":
        formats.write_reads(convert.counted_reads(found, bank, a.threshold, a.most), a.out)
    else:
        convert.write_well_covered(found, bank, a.threshold, a.out)


if __name__ == "__main__":
    main()
