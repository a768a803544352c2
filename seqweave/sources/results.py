"""Result files read back: links and counts as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Without comments (# at the start) and blank lines."""
    return lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))


def count_lines(lines: DataFrame, column: str = "value") -> int:
    """How many lines hold data."""
    return data_lines(lines, column).count()


def form_of(lines: DataFrame, column: str = "value") -> str | None:
    """What the first data line of a linker's result is like: links (`q:t-span-pct`), any (`q:t t`) or ids (`q pct`); None of a result without data."""
    first = data_lines(lines, column).select(column).head(1)
    if not first:
        return None
    before, sign, rest = first[0][0].partition(":")
    return "ids" if not sign else "links" if "-" in rest else "any"


def read_links(lines: DataFrame, *forms: str) -> DataFrame:
    """The rows of a linker's result of one of the forms; an error says which it has, if another."""
    form = form_of(lines)
    if form and form not in forms:
        said = {"links": "links with their spans and percentages", "any": "targets without percentages (of threshold 0)", "ids": "queries without targets (ids only)"}
        raise ValueError(f"the result has {said[form]}; needed: {' or '.join(said[x] for x in forms)}")
    return parse_link_ids(lines) if form == "ids" else parse_links(lines)


def parse_links(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query_id, place, target_id, span, pct) of `q:t-span-pct t-span-pct`; span and pct are null where a target has none. Other columns stay."""
    rest = [c for c in lines.columns if c != column]
    halves = F.split(F.rtrim(F.col(column)), ":", 2)
    one = data_lines(lines, column).select(*rest, halves[0].cast("long").alias("query_id"), F.posexplode(F.split(F.get(halves, F.lit(1)), " ")).alias("place", "target")).where("target <> ''")
    parts = F.split("target", "-")
    field = lambda k: F.get(parts, F.lit(k))
    return one.select(*rest, "query_id", "place", field(0).cast("long").alias("target_id"), field(1).cast("long").alias("span"), field(2).cast("float").alias("pct"))


def parse_link_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query_id, max_pct) of `q pct`."""
    parts = F.split(F.rtrim(F.col(column)), " ")
    return data_lines(lines, column).select(*(c for c in lines.columns if c != column), parts[0].cast("long").alias("query_id"), parts[1].cast("int").alias("max_pct"))


def parse_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query_id, mean, median, min, max, pct) of `q mean median min max pct`, nulls of `q none`."""
    parts = F.split(F.rtrim(F.col(column)), " ")
    number = lambda k, t: F.when(parts[1] != "none", F.get(parts, F.lit(k)).cast(t))
    return data_lines(lines, column).select(parts[0].cast("long").alias("query_id"), number(1, "float").alias("mean"), number(2, "int").alias("median"), number(3, "int").alias("min"), number(4, "int").alias("max"), number(5, "float").alias("pct"))


def read_set_of(header: Column) -> Column:
    """The file that the header line of counts names."""
    return F.regexp_extract(header, r"\(from bank ([^)]*)\)", 1)
