from __future__ import annotations

import gzip
import io
import random
import struct
import zlib

import pytest

from seqweave.sources import pieces, reads
from seqweave.sources.reads import records


def block_gzip(data: bytes, size: int) -> bytes:
    """Block-gzipped bytes with so many bytes of text in a block, an empty block among them, and the empty block at the end."""
    out = []
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        for own in (part, b"") if len(out) == 2 else (part,):
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = deflate.compress(own) + deflate.flush()
            out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(own), len(own)))
    return b"".join(out)


def fasta(r: random.Random, n: int) -> bytes:
    return "".join(f">r{i} a>b\n" + "".join("".join(r.choice("ACGT") for _ in range(r.randint(0, 9))) + "\n" for _ in range(r.randint(0, 3))) for i in range(n)).encode()


def fastq(r: random.Random, n: int, end: str = "\n") -> bytes:
    """Qualities begin with @ and + as often as not."""
    out = []
    for i in range(n):
        size = r.randint(0, 12)
        out.append(f"@r{i}{end}{''.join(r.choice('ACGT') for _ in range(size))}{end}+{r.choice(['', f'r{i}'])}{end}{''.join(r.choice('@@++I#') for _ in range(size))}{end}")
    return "".join(out).encode()


def whole(data: bytes) -> list:
    return list(records(iter(io.TextIOWrapper(io.BytesIO(data), encoding="utf-8"))))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("name", ["fasta", "fastq"])
@pytest.mark.parametrize("blocks", [0, 37])
def test_every_split_point(tmp_path, name, blocks, end, monkeypatch):
    """Whatever byte parts a file in two, each record is in exactly one of the parts, and their numbers add up."""
    if name == "fasta" and end != "\n":
        pytest.skip("lines of FASTA are stripped")
    monkeypatch.setattr(pieces, "AHEAD", 16)
    r = random.Random(len(name) + blocks)
    for k in range(3):
        data = fasta(r, 12) if name == "fasta" else fastq(r, 12, end)
        if k == 2:
            data = data.rstrip(b"\r\n") if not data.endswith(b"\n\n") else data
        path = str(tmp_path / f"{k}.x")
        stored = block_gzip(data, blocks) if blocks else data
        open(path, "wb").write(stored)
        kind, size = pieces.kind_of(path)
        assert kind == ("blocks-" if blocks else "") + name and size == len(stored)
        want = whole(data)
        for p in range(size + 1):
            got = [list(records(iter(pieces.stream(path, kind, a, b)))) for a, b in ((0, p), (p, size))]
            assert got[0] + got[1] == want, p
            assert [pieces.count(path, kind, a, b) for a, b in ((0, p), (p, size))] == [len(x) for x in got], p


def test_records_of_more_lines_are_told_apart():
    assert pieces.four_lines(b"@a\nACGT\n+\nIIII\n@b\nA\n+\nI") == 2 and pieces.four_lines(b"") == 0 and pieces.four_lines(b"@a\n\n+\n\n") == 1
    assert pieces.four_lines(b"@a\nAC\nGT\n+\nII\nII\n@b\nA\n+\nI\n") is None and pieces.four_lines(b"@a\nACGT\n+\nII\n") is None


@pytest.mark.parametrize("form", ["fasta", "fastq", "blocks", "plain gzip", "more lines"])
def test_reads_of_pieces_have_their_numbers(spark, tmp_path, form):
    r = random.Random(9)
    data = {"fasta": fasta(r, 300), "more lines": b"@a\nAC\nGT\n+\nII\nII\n" + fastq(r, 200)}.get(form, fastq(r, 300))
    path = str(tmp_path / "file")
    open(path, "wb").write(block_gzip(data, 500) if form == "blocks" else gzip.compress(data) if form == "plain gzip" else data)
    found = reads.read_sets(spark, [("x", path)], 800)
    assert found.rdd.getNumPartitions() > 3 if form in ("fasta", "fastq", "blocks") else found.rdd.getNumPartitions() == 1
    assert sorted((x["read_id"], x["header"], x["seq"], x["qual"]) for x in found.collect()) == [(i, *x) for i, x in enumerate(whole(data))]


@pytest.mark.parametrize("form", ["fasta", "fastq"])
def test_chosen_reads_by_offsets(spark, tmp_path, form, monkeypatch):
    r = random.Random(10)
    data, path = fasta(r, 2000) if form == "fasta" else fastq(r, 2000), str(tmp_path / "file")
    open(path, "wb").write(data)
    index = reads.offset_index(spark, [("x", path)], 3000)
    ids = [0, 1, 255, 256, 999, 1999, 2000, 10**9, -1, 999]
    got = reads.fetch(index, spark.createDataFrame([("x", i) for i in ids] + [("y", 3)], "read_set string, read_id long")).collect()
    want = whole(data)
    assert sorted((x["read_set"], x["read_id"], x["header"], x["seq"], x["qual"]) for x in got) == [("x", i, *want[i]) for i in (0, 1, 255, 256, 999, 1999)]
    spans = [(x["begin"], x["end"]) for x in index.orderBy("mark").collect()]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == -(-2000 // reads.STEP)
    gz = str(tmp_path / "file.gz")
    open(gz, "wb").write(gzip.compress(data))
    with pytest.raises(ValueError):
        reads.offset_index(spark, [("x", gz)])


def test_few_reads_of_many_cost_few_bytes(spark, tmp_path):
    """Ten of 300,000 reads: of the file, under a hundredth is read."""
    path = str(tmp_path / "many")
    n = 300_000
    open(path, "w").write("".join(f">r{i}\nACGTACGTACGTACGTACGT\n" for i in range(n)))
    index = reads.offset_index(spark, [("x", path)], 1 << 20)
    chosen = spark.createDataFrame([("x", i * (n // 10)) for i in range(10)], "read_set string, read_id long")
    marks = {r["read_id"] // reads.STEP for r in chosen.collect()}
    size = sum(r["end"] - r["begin"] for r in index.collect() if r["mark"] in marks)
    assert size < 0.01 * len(open(path).read()) and reads.fetch(index, chosen).count() == 10


def test_an_album_reads_only_the_sets_that_are_asked_for(spark, tmp_path):
    paths = []
    for k in range(6):
        paths.append(tmp_path / f"{k}.fa")
        paths[-1].write_text(f">r{k}\nACGT\n" * (400 if k == 3 else 1))
    (tmp_path / "album").write_text("".join(f"{x}\n" for x in paths))
    found = reads.read_album(spark, str(tmp_path / "album"), {str(paths[3]), str(paths[5])})
    for k in (0, 1, 2, 4):
        paths[k].unlink()
    assert found.count() == 401 and {x["read_set"] for x in found.collect()} == {str(paths[3]), str(paths[5])}
    assert reads.read_sets(spark, []).count() == 0
