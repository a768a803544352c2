"""Reads from FASTA and FASTQ files, plain or gzipped, from albums of them, and from tables of texts."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..arrow import small_batches
from ..functions.sequences import as_nucleotides
from ..session import file_system, ship
from . import pieces

SCHEMA = "read_set string, read_id long, header string, seq string, qual string"


#: Bytes of a piece of a file that one task reads.
PIECE = 64 << 20


def open_text(path: str) -> io.TextIOBase:
    """A text stream of a file, gunzipped if it begins like gzip."""
    system, name = file_system(path)
    raw = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw, encoding="utf-8", errors="replace")


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, quality) of FASTA or FASTQ lines. Sequences of either may span lines; blank lines between records are skipped."""
    line = next(lines, None)
    while line is not None:
        head = line.rstrip("\r\n")
        if not head:
            line = next(lines, None)
            continue
        if head[0] not in ">@":
            raise ValueError(f"no record begins with {head[:20]!r}")
        parts: list[str] = []
        line = next(lines, None)
        while line is not None and not line.startswith(">" if head[0] == ">" else "+"):
            parts.append(line.strip())
            line = next(lines, None)
        seq, qual = "".join(parts), None
        if head[0] == "@":
            qual, line = "", next(lines, None)
            while line is not None and len(qual) < len(seq):
                qual += line.strip()
                line = next(lines, None)
        yield head[1:], seq, qual


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([r | {"n": pieces.count(r["path"], r["kind"], r["start"], r["stop"])}], batch.schema.append(pa.field("n", pa.int64())))


class _Reader(DataSourceReader):
    def __init__(self, parts: list[tuple]):
        self.parts = parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.parts]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        name, path, kind, start, stop, number = partition.value
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["read_set", "read_id", "header", "seq", "qual"])

        for i, (header, seq, qual) in enumerate(records(iter(pieces.stream(path, kind, start, stop))), number):
            rows.append((name, i, header, seq, qual))
            size += len(seq)
            if len(rows) >= 1000 or size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class ReadSource(DataSource):
    """spark.read.format("reads").option("pieces", JSON of [name, path, kind, start, stop, first read id]): one task a piece."""

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([tuple(x) for x in json.loads(self.options["pieces"])])


def parts_of(spark: SparkSession, sets: list[tuple[str, str]], piece: int = PIECE) -> list[tuple]:
    """(name, path, kind, start, stop, first read id) of the pieces of (name, path) files, counted by a job over them."""
    listed = [file_system(path) for _, path in sets]
    # a small file is one piece whatever its kind, so only large ones are opened here
    kinds = [("whole", size) if (size := system.get_file_info(name).size) <= piece // 8 else pieces.kind_of(path) for (system, name), (_, path) in zip(listed, sets, strict=True)]
    # a block-gzipped piece is in memory as text, so it has fewer bytes
    sizes = [piece if not kind.startswith("blocks-") else max(1, piece // 8) for kind, _ in kinds]
    whole = {k for k, (kind, size) in enumerate(kinds) if kind == "whole" or size <= sizes[k]}
    cut = [(k, sets[k][1], kind, a, min(a + sizes[k], size)) for k, (kind, size) in enumerate(kinds) if k not in whole for a in range(0, size, sizes[k])]
    counted = []
    if cut:
        table = spark.createDataFrame(cut, "k long, path string, kind string, start long, stop long").repartition(len(cut))
        counted = sorted(table.mapInArrow(_counted, "k long, path string, kind string, start long, stop long, n long").collect(), key=lambda r: (r["k"], r["start"]))
        whole |= {r["k"] for r in counted if r["n"] is None}  # records of other than four lines have no place to begin at
    out = [(*sets[k], "whole", 0, kinds[k][1], 0) for k in sorted(whole)]
    number: dict[int, int] = {}
    for r in counted:
        if r["k"] not in whole:
            out.append((*sets[r["k"]], r["kind"], r["start"], r["stop"], number.get(r["k"], 0)))
            number[r["k"]] = number.get(r["k"], 0) + r["n"]
    return out


def read_sets(spark: SparkSession, sets: list[tuple[str, str]], piece: int = PIECE) -> DataFrame:
    """The reads of (name, path) files; read ids count from 0 in each file.

    A FASTA file, a FASTQ file of four-line records, or either block-gzipped, of more than `piece` bytes is read in
    pieces by several tasks, which a job over the pieces counts before, so that reads have their numbers. Other gzipped
    files, and FASTQ files with records of more lines, are one task each.
    """
    ship(spark)
    spark.dataSource.register(ReadSource)
    return spark.read.format("reads").option("pieces", json.dumps(parts_of(spark, sets, piece))).load()


#: Records of a stretch that an offset index knows the place of.
STEP = 256


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            found = list(pieces.marks(r["path"], r["kind"], r["start"], r["stop"], r["number"], STEP))
            yield pa.RecordBatch.from_pydict({"read_set": pa.array([r["read_set"]] * len(found), pa.string()), "path": pa.array([r["path"]] * len(found), pa.string()), "mark": pa.array([m for m, _ in found], pa.int64()), "begin": pa.array([at for _, at in found], pa.int64())})


def offset_index(spark: SparkSession, sets: list[tuple[str, str]], piece: int = PIECE) -> DataFrame:
    """(read_set, path, mark, begin, end): the bytes of every STEP records of plain FASTA and four-line FASTQ files. Write it as a table to use it more than once."""
    ship(spark)
    parts = [(name, path, pieces.kind_of(path)[0] if kind == "whole" else kind, a, b, n) for name, path, kind, a, b, n in parts_of(spark, sets, piece)]
    if odd := next((path for _, path, kind, *_ in parts if kind not in ("fasta", "fastq")), None):
        raise ValueError(f"{odd}: only plain FASTA and FASTQ files have offsets")
    table = spark.createDataFrame(parts, "read_set string, path string, kind string, start long, stop long, number long").repartition(len(parts))
    found = table.mapInArrow(_marked, "read_set string, path string, mark long, begin long")
    after = Window.partitionBy("read_set", "path").orderBy("mark")
    sizes = spark.createDataFrame([(path, pieces.kind_of(path)[1]) for path in {x[1] for x in parts}], "path string, size long")
    return found.withColumn("next", F.lead("begin").over(after)).join(F.broadcast(sizes), "path").select("read_set", "path", "mark", "begin", F.coalesce("next", "size").alias("end"))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            wanted, first = set(r["ids"]), r["mark"] * STEP
            system, name = file_system(r["path"])
            with system.open_input_file(name) as file:
                file.seek(r["begin"])
                lines = io.TextIOWrapper(io.BytesIO(file.read(r["end"] - r["begin"])), encoding="utf-8", errors="replace")
            rows = [(r["read_set"], k, *x) for k, x in enumerate(records(iter(lines)), first) if k in wanted]
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in rows], pa.int64() if c == "read_id" else pa.string()) for i, c in enumerate(["read_set", "read_id", "header", "seq", "qual"])})


def fetch(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """The reads of chosen (read_set, read_id) by an offset index: of the files, only the stretches that hold them are read. Ids that the files lack have no rows."""
    ship(index.sparkSession)
    small_batches(index.sparkSession)
    wanted = chosen.select("read_set", "read_id").where("read_id >= 0").distinct().groupBy("read_set", F.expr(f"read_id div {STEP}").alias("mark")).agg(F.collect_list("read_id").alias("ids"))
    return wanted.join(index, ["read_set", "mark"]).select("read_set", "path", "mark", "begin", "end", "ids").mapInArrow(_fetched, SCHEMA)


def count_reads(reads: DataFrame) -> DataFrame:
    """(read_set, reads)."""
    return reads.groupBy("read_set").agg(F.count("*").alias("reads"))


def first_token(path: str) -> str:
    """The first word of a file, after blank lines and comments."""
    with open_text(path) as f:
        return next((x.split()[0] for x in f if x.strip() and not x.startswith("#")), "")


def _exists(path: str) -> bool:
    try:
        system, name = file_system(path)
        return bool(path) and system.get_file_info(name).type == pafs.FileType.File
    except (ValueError, OSError):
        return False


def album(path: str) -> list[tuple[str, str]]:
    """(read set, file) of an album: each line is a file, or an album whose files are one read set; `#` lines and blanks are skipped.

    Read ids restart in each file, so a read set of several files is named by its line and the file.
    """
    out = []
    with open_text(path) as f:
        lines = [x.strip() for x in f if x.strip() and not x.startswith("#")]
    for line in lines:
        if first_token(line)[:1] in (">", "@", ""):
            out.append((line, line))
        else:
            with open_text(line) as f:
                out += [(f"{line}:{x.strip()}", x.strip()) for x in f if x.strip()]
    return out


def read_album(spark: SparkSession, path: str, only: set[str] | None = None) -> DataFrame:
    """The reads of an album's read sets, or of those that are asked for; the files of the others are not read."""
    return read_sets(spark, [x for x in album(path) if only is None or x[0] in only])


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The reads of one bank, which can't be an album."""
    if _exists(first_token(path)):
        raise ValueError(f"{path} lists files; a bank is one file of reads")
    return read_sets(spark, [(path, path)])


def text_reads(table: DataFrame, read_id: Column, text: Column, read_set: Column | None = None) -> DataFrame:
    """Any texts as reads: the letters a to z stand for nucleotides, the rest is left out. A null text has no bases."""
    name = F.lit("") if read_set is None else read_set.cast("string")
    return table.select(name.alias("read_set"), read_id.cast("long").alias("read_id"), F.concat(F.lit("read_"), read_id.cast("string")).alias("header"), as_nucleotides(F.coalesce(text, F.lit(""))).alias("seq"), F.lit(None).cast("string").alias("qual"))
