"""WARC archives whose records are compressed one by one with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, joined_by_group, shared_dir, small_batches, tidy, written

#: Magic number of the skippable frame that holds the dictionary (fixed by the format).
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a dictionary; records that it is trained on, about, and bytes of each at most; compression level.
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES, LEVEL = 64 << 10, 2000, 4096, 3
#: Bytes of a payload from which on a repeated one is only referred to.
LEAST_PAYLOAD = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str = _DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    revisit = payload is None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    target = "".join(c for c in (url or "") if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstd.ZstdCompressionDict:
    """A dictionary trained on records; where they are too few for training, their own bytes serve as one."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstd.train_dictionary(min(size, max(1024, total // 10)), samples, level=LEVEL)
        except zstd.ZstdError:
            pass
    return zstd.ZstdCompressionDict((b"".join(samples)[-size:]).ljust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to a stream, the dictionary before them."""

    def __init__(self, out, made: bytes, level: int = LEVEL):
        self.out = out
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(made)) + made)
        self.compressor = zstd.ZstdCompressor(level=level, dict_data=_loaded(made), write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))

    def close(self) -> None:
        self.out.close()


def _loaded(data: bytes) -> zstd.ZstdCompressionDict:
    """A dictionary of the format, or raw content where it doesn't begin like one."""
    return zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT)


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    plain = io.BufferedReader(zstd.ZstdDecompressor(dict_data=_loaded(source.read(size))).stream_reader(source, read_across_frames=True), 1 << 18)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins here: {line[:40]!r}")
        head = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = plain.read(int(head["content-length"]))
        plain.read(4)
        yield head, block


def _id(urn: str | None) -> int | None:
    return int(x) if urn and (x := urn.strip("<>").rpartition(":")[2]) else None


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): of equal payloads of at least so many bytes, the one with the smallest id is no revisit."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    firsts = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = joined_by_group(base, written(firsts, "firsts"), "digest", "n", "left").drop("n")
    return found.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = [record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["size"], None)[:SAMPLE_BYTES] for batch in batches for r in batch.to_pylist()]
    yield pa.RecordBatch.from_pydict({"dictionary": [dictionary(samples).as_bytes()]})


def trained(rows: DataFrame, n: int) -> bytes:
    """A dictionary of response records among the n rows of decided(), drawn by a hash of id and url from all of them: about SAMPLE rows, the first SAMPLE_BYTES of each.

    Equal records count once. One task trains it, on SAMPLE * SAMPLE_BYTES bytes and a little more.
    """
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40))
    some = rows.where(draw <= min(1 << 40, SAMPLE * (1 << 40) // max(n, 1))).where("refers_to is null").withColumn("html", F.left("html", F.lit(SAMPLE_BYTES)))
    some = written(some.dropDuplicates(["page_id", "digest"]).coalesce(1).mapInArrow(_trained, "dictionary binary"), "dictionary")
    return bytes((some.first() or [b"\0" * 8])[0])


def _write(folder: str, made: bytes):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = pafs.FileSystem.from_uri(folder)
        system.create_dir(name, recursive=True)
        writer, file, n = None, f"{uuid.uuid4().hex}.warc.zst", 0  # an attempt that is run again has a file of its own
        for batch in batches:
            for block in blocks(batch, "html"):
                writer = writer or Writer(system.open_output_stream(f"{name}/{file}", compression=None), made)
                for r in block.to_pylist():
                    payload = r["html"].encode() if r["refers_to"] is None else None
                    writer.add(record(r["page_id"], r["url"], payload, r["digest"], r["size"], r["refers_to"]))
                    n += 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{file}"], "n_records": [n]})

    return kernel


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, name = pafs.FileSystem.from_uri(path)
            with system.open_input_stream(name, compression=None) as source:
                rows = []
                for head, block in records(source):
                    digest = head["warc-payload-digest"].partition(":")[2]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {head['warc-record-id']} is damaged")
                    rows.append({"page_id": _id(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to"))})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes one archive a partition and returns the manifest (path, n_records).

    A file: a skippable frame with the dictionary, then a frame a record. Null html is an empty payload, a null url an
    empty target; a null id has an empty record name. Of rows that repeat an id and a payload, all with the smallest id
    are responses. Control characters and blanks are taken out of urls. A file is named by its attempt and only the
    manifest says which count, so tasks may be run again. The dictionary, the same in every file, is trained on a
    bounded sample of all response records. Other columns are not read. No pages: no files.
    """
    small_batches(pages.sparkSession)
    rows = decided(pages, id_col, url_col, html_col, least)
    return written(rows.mapInArrow(_write(folder, trained(rows, pages.count())), "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a response whose payload doesn't fit its digest is an error."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to a new shared folder and reads them back."""
    return read_archives(write_archives(pages, shared_dir(spark, "warc")))
