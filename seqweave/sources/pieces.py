"""Pieces of read files that tasks read side by side: where records begin at or behind any byte of FASTA, four-line FASTQ and block-gzipped files."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from ..session import file_system

#: A block of a block-gzipped file has at most so many bytes; its header holds the size behind these marks (fixed values).
BLOCK = 1 << 16
_MAGIC, _EXTRA = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
#: Bytes that are looked through at first for the next record.
AHEAD = 1 << 16


# --- where records begin ------------------------------------------------------------------------------------------------


def fasta_begins(file, start: int, stop: int) -> Iterator[int]:
    """Where FASTA records begin in a range of an open file: at a > behind a line end, or at the start of the file."""
    file.seek(max(0, start - 1))
    at, before = max(0, start - 1), b"\n" if start == 0 else b""
    while at < stop:
        data = file.read(min(1 << 22, stop - at))
        if not data:
            return
        whole, base = before + data, at - len(before)
        found = whole.find(b"\n>")
        while found >= 0:
            yield base + found + 1
            found = whole.find(b"\n>", found + 1)
        at, before = at + len(data), whole[-1:]


def fasta_begin(file, at: int, size: int) -> int:
    """The first FASTA record at or behind a byte, or the size."""
    return next(fasta_begins(file, at, size), size)


def fastq_begin(file, at: int, size: int) -> int:
    """The first record of a four-line FASTQ file at or behind a byte, or the size.

    A record begins at a line with @ whose second next has +. A line of qualities may begin with @, too, but the second
    line behind it has bases.
    """
    if at == 0:  # whatever stands there, lest it be passed over
        return 0
    first, window = at - 1, AHEAD
    while True:
        file.seek(first)
        data = file.read(min(window, size - first))
        whole = first + len(data) >= size
        starts = []
        found = data.find(b"\n")
        while found >= 0:
            starts.append(found + 1)
            found = data.find(b"\n", found + 1)
        for k in range(len(starts) - 2):
            if data[starts[k] : starts[k] + 1] == b"@":
                if starts[k + 2] >= len(data) and not whole:
                    break
                if data[starts[k + 2] : starts[k + 2] + 1] == b"+":
                    return first + starts[k]
        if whole:
            return size
        window *= 4


def four_lines(data: bytes) -> int | None:
    """How many records of four lines the bytes are, or None if they are anything else."""
    data = data.strip(b"\r\n") + b"\n" if data.strip() else b""
    whole = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(whole == 10)
    if len(ends) % 4 == 3:  # the last record's empty qualities went with the line ends
        ends = np.append(ends, len(whole))
        whole = np.append(whole, np.uint8(10))
    if len(ends) % 4:
        return None
    if not len(ends):
        return 0
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    sizes = sizes - ((sizes > 0) & (whole[np.maximum(ends - 1, 0)] == 13))
    plain = (whole[starts[0::4]] == 0x40) & (whole[starts[2::4]] == 0x2B) & (sizes[1::4] == sizes[3::4])
    return len(plain) if plain.all() else None


# --- block-gzipped files -------------------------------------------------------------------------------------------------


def _block_size(head: bytes) -> int:
    """The bytes of the block that begins so, 0 if none does."""
    return struct.unpack("<H", head[16:18])[0] + 1 if len(head) >= 18 and head[:4] == _MAGIC and head[10:16] == _EXTRA else 0


class Blocks:
    """A block-gzipped file: its blocks from any byte on."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _head(self, at: int) -> int:
        self.file.seek(at)
        return _block_size(self.file.read(18))

    def _good(self, at: int) -> bool:
        """Whether a block begins here and others, or the end, follow it."""
        for _ in range(3):
            step = self._head(at)
            if not step:
                return False
            at += step
            if at == self.size:
                return True
        return at < self.size

    def begin(self, at: int) -> tuple[int | None, int]:
        """The last block before a byte (None for none), and the first at or behind it (the size for none)."""
        low = max(0, at - BLOCK)
        self.file.seek(low)
        data = self.file.read(2 * BLOCK + 18)
        here = data.find(_MAGIC)
        while here >= 0 and not self._good(low + here):
            here = data.find(_MAGIC, here + 1)
        if here < 0:
            return None, self.size
        before, now = None, low + here
        while now < at and now < self.size:
            before, now = now, now + self._head(now)
        return before, min(now, self.size)

    def text(self, at: int) -> tuple[bytes, int]:
        """The bytes that a block holds, and where the next begins."""
        step = self._head(at)
        if not step:
            raise ValueError(f"no block begins at byte {at}")
        self.file.seek(at)
        return zlib.decompress(self.file.read(step), 31), at + step


# --- files --------------------------------------------------------------------------------------------------------------


def kind_of(path: str) -> tuple[str, int]:
    """(kind, size) of a file: fasta, fastq, either with blocks- before, or whole where it can't be read in pieces."""
    system, name = file_system(path)
    size = system.get_file_info(name).size
    with system.open_input_stream(name, compression=None) as file:
        head = file.read(18)
    first, blocks = head[:1], ""
    if _block_size(head):
        with system.open_input_file(name) as file:
            data, at, blocks = b"", 0, "blocks-"
            while not data.strip() and at < size:
                data, at = Blocks(file, size).text(at)
            first = data[:1]
    kind = {b">": "fasta", b"@": "fastq"}.get(first)
    return (blocks + kind, size) if kind else ("whole", size)


def _open(path: str):
    system, name = file_system(path)
    return system.open_input_file(name)


def _begin(kind: str) -> Callable:
    return fasta_begin if kind.endswith("fasta") else fastq_begin


class _Part(io.RawIOBase):
    """The next so many bytes of an open file."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _from_blocks(path: str, kind: str, start: int, stop: int) -> bytes:
    """The records that begin in the blocks of a range of bytes, whole. In memory: the range's text and one record."""
    with _open(path) as file:
        blocks = Blocks(file, file.size())
        (before, at), (_, end) = blocks.begin(start), blocks.begin(stop) if stop < file.size() else (None, file.size())
        last = b"\n"  # the byte before: does the first block begin a line?
        while before is not None and before < at:
            data, following = blocks.text(before)
            if data:
                last = data[-1:]
                break
            before = blocks.begin(before)[0]  # an empty block
        parts, own = [last], 1
        while at < end:
            data, at = blocks.text(at)
            parts.append(data)
            own += len(data)
        text, begin = b"".join(parts), _begin(kind)
        low = 1 if before is None and start == 0 else begin(io.BytesIO(text), 1, len(text))
        if low >= own:
            return b""
        while at < blocks.size:  # the last record may go on behind the range
            high = begin(io.BytesIO(text), own, len(text))
            if high < len(text):
                return text[low:high]
            data, at = blocks.text(at)
            text += data
        return text[low : begin(io.BytesIO(text), own, len(text))]


def stream(path: str, kind: str, start: int, stop: int) -> io.TextIOBase:
    """The text of the records that begin in a range of bytes of a file (of the whole file, if its kind is whole)."""
    if kind == "whole":
        system, name = file_system(path)
        raw = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
        raw = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    elif kind.startswith("blocks-"):
        raw = io.BytesIO(_from_blocks(path, kind, start, stop))
    else:
        file = _open(path)
        size, begin = file.size(), _begin(kind)
        low = begin(file, start, size)
        high = begin(file, stop, size) if stop < size else size
        file.seek(low)
        raw = io.BufferedReader(_Part(file, max(0, high - low)), 1 << 20) if low < stop else io.BytesIO(b"")
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace")


def count(path: str, kind: str, start: int, stop: int) -> int | None:
    """How many records begin in a range, or None where a FASTQ file has records of other than four lines."""
    if kind == "fasta":
        with _open(path) as file:
            return sum(1 for _ in fasta_begins(file, start, stop))
    with stream(path, kind, start, stop) as text:
        data = text.buffer.read()
    return sum(1 for _ in fasta_begins(io.BytesIO(data), 0, len(data))) if kind.endswith("fasta") else four_lines(data)


def marks(path: str, kind: str, start: int, stop: int, number: int, step: int) -> Iterator[tuple[int, int]]:
    """(n, byte) of every step-th record of a plain file, counted from the first of the file, that begins in a range; number is the first record's."""
    with _open(path) as file:
        if kind == "fasta":
            begins = fasta_begins(file, start, stop)
        else:
            low = fastq_begin(file, start, file.size())
            file.seek(low)
            high = fastq_begin(file, stop, file.size()) if stop < file.size() else file.size()
            file.seek(low)
            data = file.read(max(0, high - low)) if low < stop else b""
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            begins = iter((low + np.concatenate([[0], ends])[0::4][: four_lines(data) or 0]).tolist())
        for k, at in enumerate(begins, number):
            if k % step == 0:
                yield k // step, at

