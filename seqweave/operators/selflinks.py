"""Links of a read set with itself: reads of equal sequences are one class, and only pairs that can reach the threshold are compared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import raw, small_batches
from ..functions.sequences import percentage
from ..tables import dropped, joined_by_group, sent, squeezed, written
from . import superkmers
from .kmers import CODE, blocks_of, canonical_of
from .membership import membership

#: Queries of a group, which one task compares with their targets; reads among which a group's targets are at once.
SPLIT, BLOCK = 512, 1 << 18
#: Times as many reads as a group has targets, above which a colour's reads are looked up from the targets' side.
HOT = 8
#: Bases whose stretches are found at once.
NEAR = 1 << 17
#: Stretches of bases that are compared at once, at least, where their bucket ends; bases of them that are expanded at once,
#: k-mers of a bucket that are held; runs that a task deals out at once; pairs of a target and a run that are held.
STRETCHES, PIECE, KMERS, RUNS, CELLS = 1 << 16, 1 << 20, 1 << 21, 1 << 19, 1 << 23
#: Pairs of a target and a colour of a group that are held as a table; of more, lists are read for each query.
TABLE = 1 << 26
#: Parts that reads and colours are dealt into, at least.
PARTS = 512
#: Bits of a colour's name, at each try; another is made where two colours have one name.
BITS = (64, 64, 64)


def least_span(n: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest covered bases of a read of n whose percentage, in single precision, reaches the threshold."""
    span = np.maximum(np.floor(n * (threshold / 100)).astype(np.int64) - 2, 0)
    for _ in range(4):
        span += (100 * span / np.maximum(n, 1)).astype(np.float32) < np.float32(threshold)
    return span


def span_of(places: np.ndarray, k: int) -> int:
    """Bases that k-mers at ascending places cover."""
    return int(np.minimum(np.diff(places), k).sum()) + k if len(places) else 0


def stretch(cost: np.ndarray, free: int, k: int) -> tuple[int, int]:
    """The cheapest run of places of k-mers of which one at least is shared if at most `free` bases are uncovered: `free` + 1 at an end of the read, as many bases as places, and `free` + k elsewhere. All places, if there are fewer."""
    n = len(cost)
    upto = np.concatenate([[0], np.cumsum(cost)])
    best, size = (0, n), free + 1
    for low, high in ((0, min(size, n)), (max(n - size, 0), n)):
        if upto[high] - upto[low] < upto[best[1]] - upto[best[0]]:
            best = (low, high)
    size = free + k
    if size < n:
        at = int(np.argmin(upto[size:] - upto[:-size]))
        if upto[at + size] - upto[at] < upto[best[1]] - upto[best[0]]:
            best = (at, at + size)
    return best


def rarest(cost: np.ndarray, least: int, k: int) -> np.ndarray:
    """The places with a cost of which one is shared where shared k-mers cover `least` bases: all but the dearest, as many as cover fewer bases. None, if all of them do."""
    places = np.flatnonzero(cost)
    if span_of(places, k) < least:
        return places[:0]
    order = places[np.argsort(-cost[places], kind="stable")]  # the dearest first, of one cost from left to right
    low, high, chosen = 0, len(order), np.zeros(len(cost), bool)
    while high - low > 1:
        mid = (low + high) // 2
        chosen[:] = False
        chosen[order[:mid]] = True
        low, high = (mid, high) if span_of(np.flatnonzero(chosen), k) < least else (low, mid)
    return np.sort(order[low:])


# --- parts: many short rows travel as one -------------------------------------------------------------------------------


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _starts(key: np.ndarray) -> np.ndarray:
    """The places where a sorted array has a new value."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))


def _dealt(part: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """The parts that occur, the columns of each as binary values, and the order of the rows in them."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    own = _starts(part)
    cuts = np.append(own, len(part))
    return part[own], [_binary(x[order], cuts) for x in columns], order


def _planes(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of 32-bit numbers as binary values, their lowest bytes first, then the next ones: the shuffle's codec takes the highest away."""
    many = np.diff(cuts)
    step = np.repeat(many, many)
    at, each = np.repeat(3 * cuts[:-1], many) + np.arange(len(x)), np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4)
    out = np.empty(4 * len(x), np.uint8)
    for j in range(4):
        out[at + j * step] = each[:, j]
    return _binary(out, 4 * cuts)


def _whole(column: pa.Array) -> np.ndarray:
    """The numbers of _planes(), one value's behind another's."""
    data, offsets = raw(column)
    many = np.diff(offsets) // 4
    step = np.repeat(many, many)
    at, each = np.repeat(3 * (np.cumsum(many) - many), many) + np.arange(len(step)), np.empty((len(step), 4), np.uint8)
    for j in range(4):
        each[:, j] = data[at + j * step]
    return each.view(np.uint32).ravel()


def _joined(column: pa.Array, dtype: type) -> np.ndarray:
    return raw(column)[0].view(dtype)


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A number of 64 bits for each number."""
    x = x.astype(np.uint64) + np.uint64((seed * 0xA24BAED4963EE407 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- stretches of reads, by minimizer -----------------------------------------------------------------------------------

_STRETCHES = "bucket int, node binary, start binary, anchor binary, sizes binary, bases binary"


def _anchored(code: np.ndarray, offsets: np.ndarray, k: int, m: int, buckets: int) -> tuple[np.ndarray, tuple | None]:
    """The bases of each read of a block that its own k-mers cover, and (bucket, row, start, anchor, bases, packed codes) of its super-k-mers: anchor is where its minimizer begins in it, or 255 where it has the minimizer more than once; each stretch is filled up to a byte."""
    n = np.diff(offsets)
    if len(code) < k:
        return np.zeros(len(n), np.int64), None
    mers = canonical_of(code, m)
    value = np.where(mers < 0, np.iinfo(np.uint64).max, superkmers._mixed(mers))
    low, wide, size = value.copy(), k - m + 1, 1
    while size * 2 <= wide:  # least of 1, 2, 4, ... neighbours
        low[: len(low) - size] = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if wide > size:
        low[: len(low) - (wide - size)] = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    valid = np.zeros(len(code), bool)
    valid[: len(code) - k + 1] = bad[k:] == bad[:-k]
    valid[superkmers._ranges(np.maximum(offsets[1:] - (k - 1), offsets[:-1]), np.minimum(n, k - 1))] = False  # k-mers that would cross the end of a read
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(len(n), np.int64), None
    begins = np.zeros(len(code) + 1, bool)
    begins[offsets] = True
    new = np.concatenate([[True], (np.diff(at) > 1) | begins[at[1:]]])
    whole = np.flatnonzero(new)
    covered = np.bincount(np.searchsorted(offsets, at[whole], "right") - 1, np.diff(np.append(whole, len(at))) + k - 1, len(n)).astype(np.int64)
    new[1:] |= low[at[1:]] != low[at[:-1]]
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    most = superkmers.LONGEST - k + 1  # k-mers of a stretch; longer ones are cut
    pieces = -(-run // most)
    start = np.repeat(at[first], pieces) + most * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    bases = np.minimum(most, np.repeat(at[first] + run, pieces) - start) + k - 1
    inside = bases - m + 1
    own = np.repeat(np.arange(len(start)), inside)
    hit = np.flatnonzero(value[superkmers._ranges(start, inside)] == low[start][own])
    own, place = own[hit], hit - (np.cumsum(inside) - inside)[own[hit]]
    times = np.bincount(own, minlength=len(start))
    anchor = np.full(len(start), 255, np.uint8)
    anchor[own] = place
    anchor[times > 1] = 255
    filled = -(-bases // 4) * 4
    codes = np.zeros(int(filled.sum()), np.uint8)
    codes[superkmers._ranges(np.cumsum(filled) - filled, bases)] = code[superkmers._ranges(start, bases)]
    row = np.searchsorted(offsets, start, "right") - 1
    return covered, ((low[start] % np.uint64(buckets)).astype(np.int32), row, start - offsets[row], anchor, bases.astype(np.uint8), superkmers.packed(codes))


def _stretches(k: int, m: int, buckets: int):
    """The super-k-mers of reads (node, seq) by bucket, and under negative buckets (in node: number, length and bases that its own k-mers cover) of each read."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["bucket", "node", "start", "anchor", "sizes", "bases"]

        def dealt() -> Iterator[pa.RecordBatch]:
            bucket, node, start, anchor, bases, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = -(-bases.astype(np.int64) // 4)
            own, columns, order = _dealt(bucket, [anchor, bases])
            begin, size = (np.cumsum(size) - size)[order], size[order]
            cuts = np.append(np.searchsorted(bucket[order], own), len(order))
            columns = [_planes(node[order], cuts), _planes(start[order], cuts), *columns]
            body = _binary(data[superkmers._ranges(begin, size)], np.concatenate([[0], np.cumsum(size)])[cuts])
            yield pa.RecordBatch.from_arrays([pa.array(own), *columns, body], names)

        have = 0
        for batch in batches:
            for part in blocks_of(batch, NEAR):
                data, offsets = raw(part.column("seq"))
                node, code = part.column("node").to_numpy(), CODE[data]
                covered, made = _anchored(code, offsets, k, m, buckets)
                about = np.stack([node, np.diff(offsets), covered], 1).astype(np.int64)
                empty = pa.array([b""], pa.binary())
                number = int(_mixed(node[:1])[0] % np.uint64(buckets)) if len(node) else 0
                yield pa.RecordBatch.from_arrays([pa.array([-1 - number], pa.int32()), pa.array([about.tobytes()], pa.binary()), empty, empty, empty, empty], names)
                if made:
                    bucket, row, start, *rest = made
                    held.append((bucket, node[row].astype(np.uint32), start.astype(np.uint32), *rest))
                    have += len(made[-1])
                if have >= superkmers.HELD:
                    yield from dealt()
                    have = 0
        if held:
            yield from dealt()

    return kernel


# --- runs of k-mers with one colour -------------------------------------------------------------------------------------


def _canonical(codes: np.ndarray) -> np.ndarray:
    """The canonical codes of rows of bases."""
    forward, backward = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for j in range(codes.shape[1]):
        one = codes[:, j].astype(np.int64)
        forward = (forward << 2) | one
        backward |= (one ^ 2) << (2 * j)
    return np.minimum(forward, backward)


def may_share(anchor: np.ndarray, sizes: np.ndarray, codes: np.ndarray, begin: np.ndarray, k: int, m: int) -> np.ndarray:
    """Which of some stretches of bases (codes from begin on) may share a k-mer with another.

    A k-mer that has its minimizer once has half of its other bases on one side of it: stretches that share it share the
    minimizer with these bases, in one direction or the other. Those that have a minimizer more than once stay, and count
    for others with all of their parts of that length.
    """
    side = (k - m) // 2
    wide = m + side
    known = anchor < 255
    left = np.flatnonzero(known & (anchor >= side))
    right = np.flatnonzero(known & (anchor.astype(np.int64) + wide <= sizes))
    place = begin + anchor
    keys = [_canonical(codes[(place[left] - side)[:, None] + np.arange(wide)]), _canonical(codes[place[right][:, None] + np.arange(wide)])]
    odd = np.flatnonzero(~known)
    taken = superkmers._ranges(begin[odd], np.maximum(sizes[odd].astype(np.int64) - wide + 1, 0))
    keys.append(_canonical(codes[taken[:, None] + np.arange(wide)]))
    size = min(max(10, (8 * sum(map(len, keys))).bit_length()), 23)
    slot = [(_mixed(x) >> np.uint64(64 - size)).astype(np.int64) for x in keys]
    times = np.bincount(np.concatenate(slot))
    keep = ~known
    keep[left[times[slot[0]] > 1]] = True
    keep[right[times[slot[1]] > 1]] = True
    return keep


def _coloured(kmer: np.ndarray, node: np.ndarray, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(colour, reads, first) of each k-mer: the name of the set of the reads that have it, their number and the least; of k-mers of one read, 0 reads."""
    colour, reads, least = np.zeros(len(kmer), np.uint64), np.zeros(len(kmer), np.uint32), np.zeros(len(kmer), np.uint32)
    size = max(10, (8 * len(kmer)).bit_length())
    slot = (_mixed(kmer) >> np.uint64(64 - size)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << size)[slot] > 1)  # most k-mers that occur once fall out here
    if not len(at):
        return colour, reads, least
    order = at[np.argsort(kmer[at])]
    first = _starts(kmer[order])
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    both = (rank << 32) | node[order].astype(np.int64)
    again = np.argsort(both)
    order, both = order[again], both[again]
    rank, one = both >> 32, both & 0xFFFFFFFF
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    first = _starts(rank)
    many = np.add.reduceat(new.astype(np.int64), first)
    name = np.add.reduceat(np.where(new, _mixed(one, seed), np.uint64(0)), first) >> np.uint64(64 - bits)
    several = many[rank] > 1
    order, rank = order[several], rank[several]
    colour[order], reads[order], least[order] = name[rank], many[rank], one[first][rank]
    return colour, reads, least


_PARTS = "part int, kind int, node binary, start binary, length binary, colour binary, reads binary, first binary"
_KINDS = [np.uint32, np.uint32, np.uint8, np.uint64, np.uint32, np.uint32]


def _runs(k: int, m: int, parts: int, seed: int, bits: int):
    """Runs of k-mers with one colour, by part of their read, from super-k-mers in the order of buckets; what stands under negative buckets goes on as kind 0."""
    names = [x.split()[0] for x in _PARTS.split(", ")]

    def found(node, start, anchor, sizes, bases) -> Iterator[tuple]:
        filled = -(-sizes.astype(np.int64) // 4) * 4
        begin = np.cumsum(filled) - filled
        codes = superkmers.unpacked(bases)
        keep = np.flatnonzero(may_share(anchor, sizes, codes, begin, k, m))
        if not len(keep):
            return
        node, start, sizes, begin = node[keep], start[keep], sizes[keep].astype(np.int64), begin[keep]
        ends, many = np.cumsum(sizes), sizes - k + 1
        passes = -(-int(many.sum()) // KMERS)
        for turn in range(passes):
            kmers, owner, place = [], [], []
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
                upto = np.cumsum(sizes[a:b]) - sizes[a:b]
                own = canonical_of(codes[superkmers._ranges(begin[a:b], sizes[a:b])], k)[superkmers._ranges(upto, many[a:b])]
                row = np.repeat(np.arange(a, b), many[a:b])
                at = np.arange(len(own)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
                if passes > 1:
                    mine = np.flatnonzero(_mixed(own, 1) % np.uint64(passes) == turn)
                    own, row, at = own[mine], row[mine], at[mine]
                kmers.append(own)
                owner.append(row)
                place.append(at)
                a = b
            kmer, row, at = np.concatenate(kmers), np.concatenate(owner), np.concatenate(place)
            colour, reads, least = _coloured(kmer, node[row], seed, bits)
            some = np.flatnonzero(reads)
            row, at, colour, reads, least = row[some], at[some], colour[some], reads[some], least[some]
            new = np.ones(len(some), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (colour[1:] != colour[:-1])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(some)))
            yield node[row[first]], start[row[first]] + at[first].astype(np.uint32), length.astype(np.uint8), colour[first], reads[first], least[first]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, bucket, out, size = [], 0, None, [], 0
        nothing = pa.array([b""], pa.binary())

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            if out:
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                own, rows, order = _dealt((columns[0] % np.uint32(parts)).astype(np.int32), columns)
                cuts = np.concatenate([[0], np.cumsum(pc.binary_length(rows[2]).to_numpy())])
                rows = [_planes(x[order], cuts) if x.dtype == np.uint32 else row for x, row in zip(columns, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.ones(len(own), np.int32)), *rows], names)
            out, size = [], 0

        def compared() -> None:
            nonlocal held, have, size
            if held:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                held, have = [], 0
                for made in found(*columns):
                    out.append(made)
                    size += len(made[0])

        for batch in batches:
            number = batch.column("bucket").to_numpy()
            first = _starts(number)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
                rows = batch.slice(a, b - a)
                if number[a] < 0:
                    about = _joined(rows.column("node"), np.int64).reshape(-1, 3)
                    own, (packed,), _ = _dealt((about[:, 0] % parts).astype(np.int32), [np.ascontiguousarray(about).view("V24").ravel()])
                    none = pa.repeat(nothing[0], len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int32)), packed, *[none] * 5], names)
                    continue
                if have >= STRETCHES and number[a] != bucket:
                    compared()
                    if size >= RUNS:
                        yield from given()
                bucket = number[a]
                held.append((_whole(rows.column("node")), _whole(rows.column("start")), *(_joined(rows.column(c), np.uint8) for c in ("anchor", "sizes", "bases"))))
                have += len(held[-1][0])
        compared()
        yield from given()

    return kernel


# --- reads as lists of runs ---------------------------------------------------------------------------------------------

_READS = "node long, n long, own long, colours binary, first long, start binary, length binary, which binary, asked binary"


def asked_of(start: np.ndarray, length: np.ndarray, which: np.ndarray, reads: np.ndarray, n: int, least: int, k: int) -> np.ndarray:
    """Which of a read's colours are asked for: each linked read has one of them. Runs of places with a colour each; reads: of each colour."""
    places = superkmers._ranges(start, length)
    of = np.repeat(which, length)
    cost = np.zeros(n - k + 1, np.int64)
    cost[places] = reads[of]
    colour = np.full(n - k + 1, -1)
    colour[places] = of
    low, high = stretch(cost, n - least, k)
    some = [np.unique(x[x >= 0]) for x in (colour[rarest(cost, least, k)], colour[low:high])]
    best = min(some, key=lambda x: int(reads[x].sum()))
    out = np.zeros(len(reads), bool)
    out[best] = True
    return out


def _reads(k: int, threshold: float):
    """A row for each read: its distinct colours, and of reads that may have links its runs, the colours to ask for (of each colour) and the least read that has one of these."""
    names = [x.split()[0] for x in _READS.split(", ")]

    def made(about: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        about = about[np.unique(about[:, 0], return_index=True)[1]]
        number, n, own = about[:, 0], about[:, 1], about[:, 2]
        order = np.lexsort((columns[1], columns[0]))
        node, start, length, colour, reads, first = (x[order] for x in columns)
        node, start, length = node.astype(np.int64), start.astype(np.int64), length.astype(np.int64)
        if len(node):  # a read may be given twice; runs of neighbouring stretches are put together
            keep = np.concatenate([[True], (node[1:] != node[:-1]) | (start[1:] != start[:-1])])
            node, start, length, colour, reads, first = (x[keep] for x in (node, start, length, colour, reads, first))
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (start[1:] != start[:-1] + length[:-1]) | (colour[1:] != colour[:-1])]))
            length = np.add.reduceat(length, new)
            node, start, colour, reads, first = (x[new] for x in (node, start, colour, reads, first))
        cuts = np.searchsorted(node, np.append(number, number[-1] + 1))
        row = np.searchsorted(number, node)
        gap = np.full(len(node), k)
        same = np.flatnonzero(node[1:] == node[:-1])
        gap[same + 1] = np.minimum(start[same + 1] - (start[same] + length[same] - 1), k)
        span = np.bincount(row, length - 1 + gap, len(number)).astype(np.int64)
        least = least_span(n, threshold)
        colours, queries = [], []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            names_, at, which = np.unique(colour[a:b], return_index=True, return_inverse=True)
            colours.append(names_.tobytes() if b > a else None)
            if b == a or span[i] < least[i]:
                queries.append((None,) * 5)
                continue
            asked = asked_of(start[a:b], length[a:b], which, reads[a:b][at].astype(np.int64), int(n[i]), int(least[i]), k)
            queries.append((int(first[a:b][at][asked].min()), start[a:b].astype(np.uint32).tobytes(), length[a:b].astype(np.uint32).tobytes(), which.astype(np.uint32).tobytes(), asked.tobytes()))
        least_read, *rest = zip(*queries, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n), pa.array(own), pa.array(colours, pa.binary()), pa.array(least_read, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, about, held = None, [], []

        def given() -> Iterator[pa.RecordBatch]:
            if about:
                yield from made(np.concatenate(about), [np.concatenate([np.zeros(0, t), *(x[i] for x in held)]) for i, t in enumerate(_KINDS)])

        for batch in batches:
            number, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            first = _starts(number.astype(np.int64) * 2 + kind)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
                if number[a] != part:
                    yield from given()
                    part, about, held = number[a], [], []
                rows = batch.slice(a, b - a)
                if kind[a]:
                    held.append([_whole(rows.column(c)) if t == np.uint32 else _joined(rows.column(c), t) for c, t in zip(names_of_runs, _KINDS, strict=True)])
                else:
                    about.append(_joined(rows.column("node"), np.int64).reshape(-1, 3))
        yield from given()

    names_of_runs = [x.split()[0] for x in _PARTS.split(", ")][2:]
    return kernel


# --- the reads of a colour ----------------------------------------------------------------------------------------------


def packed_numbers(x: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** 32, as differences."""
    step = np.diff(x.astype(np.int64), prepend=0)
    width = 1 if step.max() < 1 << 8 else 2 if step.max() < 1 << 16 else 4
    data = step.astype(f"u{width}").tobytes()
    if len(data) < 256:
        return bytes([width]) + data
    return bytes([16 * width]) + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked_numbers(data: bytes) -> np.ndarray:
    if data[0] >= 16:
        width, body = data[0] // 16, pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    else:
        width, body = data[0], data[1:]
    return np.cumsum(np.frombuffer(body, f"u{width}").astype(np.int64))


def _having(parts: int, wanted):
    """(part, colour, node): which reads have the colours that the filter may hold."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = raw(batch.column("colours"))
            colour, node = data.view(np.uint64), np.repeat(batch.column("node").to_numpy(), np.diff(cuts) // 8).astype(np.uint32)
            if wanted:
                keep = wanted.test()(colour.view(np.int64))
                colour, node = colour[keep], node[keep]
            own, rows, _ = _dealt((_mixed(colour) % np.uint64(parts)).astype(np.int32), [colour, node])
            yield pa.RecordBatch.from_arrays([pa.array(own), *rows], ["part", "colour", "node"])

    return kernel


def _lists(slices: int, seed: int, bits: int):
    """(colour, slice, nodes, clash): the reads of each colour, in slices; clash tells that two sets have one name."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def given() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            colour, node = (np.concatenate(x) for x in zip(*held, strict=True))
            piece = node % np.uint32(slices)
            order = np.lexsort((node, piece, colour))
            colour, piece, node = colour[order], piece[order], node[order]
            first = _starts(colour)
            clash = np.add.reduceat(_mixed(node, seed), first) >> np.uint64(64 - bits) != colour[first]
            own = np.flatnonzero(np.concatenate([[True], (colour[1:] != colour[:-1]) | (piece[1:] != piece[:-1])]))
            data = [packed_numbers(node[a:b]) for a, b in zip(own.tolist(), [*own[1:].tolist(), len(node)], strict=True)]
            clashes = clash[np.searchsorted(first, own, "right") - 1]
            for a in range(0, len(own), 1000):
                b = a + 1000
                yield pa.RecordBatch.from_arrays([pa.array(colour[own[a:b]].view(np.int64)), pa.array(piece[own[a:b]].astype(np.int32)), pa.array(data[a:b], pa.binary()), pa.array(clashes[a:b])], ["colour", "slice", "nodes", "clash"])

        for batch in batches:
            number = batch.column("part").to_numpy()
            first = _starts(number)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
                if number[a] != part:
                    yield from given()
                    part, held = number[a], []
                rows = batch.slice(a, b - a)
                held.append((_joined(rows.column("colour"), np.uint64), _joined(rows.column("node"), np.uint32)))
        yield from given()

    return kernel


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, colour, asked) of each group of queries, from rows in their order: its colours, and whether one of its queries asks for them."""
    group, colours, asked = None, [], []

    def given() -> Iterator[pa.RecordBatch]:
        if colours:
            colour, of = np.unique(np.concatenate(colours), return_inverse=True)
            some = np.bincount(of, np.concatenate(asked), len(colour)) > 0
            for a in range(0, len(colour), 1000):
                b = min(a + 1000, len(colour))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, group)), pa.array(colour[a:b].view(np.int64)), pa.array(some[a:b])], ["g", "colour", "asked"])

    for batch in batches:
        g = batch.column("g").to_numpy()
        first = _starts(g)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(g)], strict=True):
            if g[a] != group:
                yield from given()
                group, colours, asked = g[a], [], []
            rows = batch.slice(a, b - a)
            colours.append(_joined(rows.column("colours"), np.uint64))
            asked.append(_joined(rows.column("asked"), np.uint8))
    yield from given()


# --- comparison ---------------------------------------------------------------------------------------------------------


class _Targets:
    """The reads that a group's queries ask for, and which of them have each colour of the group."""

    def __init__(self, asked: list[tuple[int, bytes]]):
        lists = [unpacked_numbers(x) for _, x in asked]
        self.nodes, of = np.unique(np.concatenate(lists), return_inverse=True)
        self.place = np.zeros(len(self.nodes), np.int64)
        self.mark = np.zeros(len(self.nodes), bool)
        self.table: np.ndarray | None = None
        self.row: dict[int, int] = {}
        cuts = np.cumsum([0, *map(len, lists)])
        self.own = {c: of[a:b].astype(np.int32) for (c, _), a, b in zip(asked, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}

    def add(self, colour: int, data: bytes) -> None:
        """The targets among a colour's reads."""
        nodes = unpacked_numbers(data)
        one, two = (self.nodes, nodes) if len(nodes) > HOT * len(self.nodes) else (nodes, self.nodes)
        at = np.minimum(np.searchsorted(two, one), len(two) - 1)
        same = np.flatnonzero(two[at] == one)
        found = same if one is self.nodes else at[same]
        if len(found):
            self.own[colour] = found.astype(np.int32)

    def ready(self) -> None:
        """Makes the table of colours and targets once all lists are there; its last row is that of colours that no target has."""
        if not self.row:
            self.row = {c: i for i, c in enumerate(self.own)}
            if len(self.nodes) * (len(self.own) + 1) <= TABLE:
                self.table = np.zeros((len(self.own) + 1, len(self.nodes)), bool)
                for c, i in self.row.items():
                    self.table[i, self.own[c]] = True

    def spans(self, query: int, start: np.ndarray, length: np.ndarray, which: np.ndarray, colours: list[int], asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The reads that have a colour that the query asks for, and how many of its bases are covered by the k-mers that each has."""
        self.ready()
        none = np.zeros(0, np.int32)
        lists = [self.own.get(c, none) for c in colours]
        for i in np.flatnonzero(asked).tolist():
            self.mark[lists[i]] = True
        target = np.flatnonzero(self.mark)
        self.mark[target] = False
        target = target[self.nodes[target] != query]
        last, spans = start + length - 1, []
        follows = np.concatenate([[False], start[1:] == last[:-1] + 1])
        if self.table is None:
            flat = np.concatenate([none, *lists])
            of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        else:
            rows = np.array([self.row.get(c, len(self.own)) for c in colours])[which]
        step = max(1, CELLS // max(len(start), len(colours)))
        for a in range(0, len(target), step):
            some = target[a : a + step]
            if self.table is None:
                self.place[some] = np.arange(1, len(some) + 1)
                row = self.place[flat]
                self.place[some] = 0
                hit = np.flatnonzero(row)
                has = np.zeros((len(some), len(colours)), bool)
                has[row[hit] - 1, of[hit]] = True
                has = has[:, which]
            else:
                few = 4 * len(some) < len(self.nodes)
                has = np.ascontiguousarray((self.table[rows[:, None], some] if few else self.table[rows].take(some, 1)).T)
            both = np.zeros((len(some), len(start) + 1), bool)  # of neighbouring runs without a place between
            both[:, 1:-1] = has[:, 1:] & has[:, :-1] & follows[1:]
            rise, fall = np.flatnonzero(has & ~both[:, :-1]), np.flatnonzero(has & ~both[:, 1:])
            at, one, two = rise // len(start), start[rise % len(start)], last[fall % len(start)]
            gap = np.full(len(at), k)
            same = np.flatnonzero(at[1:] == at[:-1]) + 1
            gap[same] = np.minimum(one[same] - two[same - 1], k)
            spans.append(np.bincount(at, two - one + gap, len(some)).astype(np.int64))
        return self.nodes[target], np.concatenate([np.zeros(0, np.int64), *spans])


def _compared(k: int):
    """(query, target, n, span) from rows in the order of groups and slices: lists of asked colours, other lists, queries."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, targets = None, [], None
        for batch in batches:
            key = list(zip(batch.column("g").to_pylist(), batch.column("slice").to_pylist(), strict=True))
            kind, colour, nodes = batch.column("kind").to_numpy(), batch.column("colour").to_pylist(), batch.column("nodes")
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            size = 0
            for i in range(batch.num_rows):
                if key[i] != group:
                    group, held, targets = key[i], [], None
                if kind[i] == 0:
                    held.append((colour[i], nodes[i].as_py()))
                    continue
                if held:
                    targets, held = _Targets(held), []
                if targets is None:  # no read of the slice has a colour that is asked for
                    continue
                if kind[i] == 1:
                    targets.add(colour[i], nodes[i].as_py())
                    continue
                start, length, which, asked, own = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("start", np.uint32), ("length", np.uint32), ("which", np.uint32), ("asked", bool), ("nodes", np.int64)))
                found, span = targets.spans(colour[i], start.astype(np.int64), length.astype(np.int64), which, own.tolist(), asked, k)
                out.append((colour[i], batch.column("n")[i].as_py(), found, span))
                size += len(found)
                if size >= 1 << 17:
                    yield _pairs(out)
                    out, size = [], 0
            if size:
                yield _pairs(out)

    return kernel


def _pairs(out: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    many = [len(x[2]) for x in out]
    query, n = (np.repeat(np.array([x[i] for x in out], np.int64), many) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([x[2] for x in out])), pa.array(n), pa.array(np.concatenate([x[3] for x in out]))], ["query", "target", "n", "span"])


@dataclass
class SelfLinks:
    """members: (read_set, read_id, node), one row a read; classes: (node, class_set, class_id, size, n, own); pairs: (query, target, span, pct) of nodes."""

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame

    def class_pairs(self) -> DataFrame:
        """(read_set, query_id, target_set, target_id, span, pct): the links between classes, each named by its least read. Reads of one class link to one another, too."""
        one = self.classes.select(F.col("node").alias("query"), F.col("class_set").alias("read_set"), F.col("class_id").alias("query_id"))
        two = self.classes.select(F.col("node").alias("target"), F.col("class_set").alias("target_set"), F.col("class_id").alias("target_id"))
        return self.pairs.join(sent(one), "query").join(sent(two), "target").select("read_set", "query_id", "target_set", "target_id", "span", "pct")

    def counts(self, threshold: float) -> DataFrame:
        """(read_set, read_id, class_id, class_size, n_links), one row a read: how many other reads it links to, those of its own class among them if its own k-mers cover enough."""
        sizes = self.classes.select(F.col("node").alias("target"), F.col("size").alias("times"))
        more = self.pairs.join(sent(sizes), "target").groupBy(F.col("query").alias("node")).agg(F.sum("times").alias("others"))
        own = F.when((F.col("n") > 0) & (percentage(F.col("own"), F.col("n")) >= F.lit(float(threshold)).cast("float")) & (F.col("own") > 0), F.col("size") - 1).otherwise(0)
        classes = self.classes.join(more, "node", "left").select("node", "class_id", F.col("size").alias("class_size"), (own + F.coalesce("others", F.lit(0))).alias("n_links"))
        return joined_by_group(self.members, written(classes, "classes"), "node", "class_size").select("read_set", "read_id", "class_id", "class_size", "n_links")


def _numbered(classes: DataFrame) -> DataFrame:
    """A written table of classes with numbers from 0 on, without a gap, in place of monotonically_increasing_id()."""
    part = F.shiftrightunsigned("node", 33)
    upto, rows = 0, []
    for p, n in sorted(classes.groupBy(part.alias("part")).count().collect()):
        rows.append((p, upto))
        upto += n
    if upto >= 1 << 32:
        raise ValueError("more than 4 billion different reads")
    first = classes.sparkSession.createDataFrame(rows, "part long, first long")
    return classes.withColumn("part", part).join(F.broadcast(first), "part").withColumn("node", F.col("node").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")).drop("part", "first")


def _lists_of(spark, nodes: DataFrame, k: int, threshold: float, slices: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """reads (_READS), their queries in groups, the colours of each group and the reads of each of these; None if two sets of reads have one name."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m, buckets, parts = min(superkmers.MINIMIZER, k), max(partitions, superkmers.BUCKETS), max(8 * partitions, PARTS)
    dealt = nodes.mapInArrow(_stretches(k, m, buckets), _STRETCHES).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    runs = squeezed(dealt.mapInArrow(_runs(k, m, parts, seed, BITS[seed]), _PARTS), "runs")
    spark._jvm.System.gc()  # the shuffle of super-k-mers can go
    reads = written(runs.repartition(partitions, "part").sortWithinPartitions("part", "kind").mapInArrow(_reads(k, threshold), _READS), "reads")
    dropped(runs)
    # the queries that ask for colours with a read in common are compared together
    queries = reads.where("first is not null")
    groups = written(queries.groupBy("first").agg(F.ceil(F.count("*") / SPLIT).alias("parts")), "groups")
    queries = queries.join(sent(groups), "first").withColumn("g", F.xxhash64("first", F.pmod(F.xxhash64("node"), "parts")))
    queries = written(queries.select("g", "node", "n", "colours", "start", "length", "which", "asked"), "queries")
    wanted = written(queries.select("g", "colours", "asked").repartition(partitions, "g").sortWithinPartitions("g").mapInArrow(_wanted, "g long, colour long, asked boolean"), "wanted")
    having = reads.where("colours is not null").select("node", "colours").mapInArrow(_having(parts, membership(wanted.select(F.col("colour").alias("kmer")))), "part int, colour binary, node binary")
    lists = having.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_lists(slices, seed, BITS[seed]), "colour long, slice int, nodes binary, clash boolean")
    lists = written(lists, "lists")
    if not lists.where("clash").isEmpty():
        dropped(reads, queries, wanted, lists)
        return None
    return reads, queries, wanted, lists


def self_links(reads: DataFrame, k: int = 31, threshold: float = 75) -> SelfLinks:
    """All links between the reads of a set (read_set, read_id, seq): of which others do shared k-mers cover at least threshold percent of a read?

    The links are those of linker.links with the set as bank and queries, an abundance of 1, whole reads as windows and
    low complexity kept, but without an expansion of copies: reads with the same sequence (in any case) are one class.
    The reads that have a k-mer are its colour. Super-k-mers move once, and of k-mers with a colour of two reads or more
    each read keeps runs of places of one colour: a read has a k-mer just if it has its colour, so spans follow from
    runs and sets of colours, whatever the number of bases. Reads that others cover too little cost nothing further.
    Others ask for colours of which every linked read has one: all without the most frequent, as many of these as cover
    less than a link needs; or those of one stretch, so long that the bases between others are more than may be
    uncovered, if they are rarer. Who has one of these is compared, so the result is exact. A colour is named by a hash
    of 64 bits, which is held against its reads; if two had one name, all are named anew.
    Null and short reads have no links. threshold: above 0.
    """
    if threshold <= 0:
        raise ValueError("threshold: above 0; use linker.any_links")
    spark = reads.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seq = F.upper(F.coalesce("seq", F.lit("")))
    keyed = squeezed(reads.select("read_set", "read_id", seq.alias("seq")).withColumn("key", F.sha2("seq", 256)), "keys")
    classes = keyed.groupBy("key").agg(F.min(F.struct("read_set", "read_id")).alias("least"), F.count("*").alias("size"))
    classes = _numbered(written(classes.withColumn("node", F.monotonically_increasing_id()), "classes"))
    members = written(joined_by_group(keyed.drop("seq"), classes.select("key", "node", F.col("size").alias("many")), "key", "many").select("read_set", "read_id", "node"), "members")
    first = sent(classes.select("key", "least", "node"))
    nodes = keyed.join(first, "key").where(F.struct("read_set", "read_id").eqNullSafe(F.col("least"))).select("node", "seq")
    slices = max(1, -(-classes.count() // BLOCK))
    found = None
    for seed in range(len(BITS)):
        found = found or _lists_of(spark, nodes, k, threshold, slices, seed)
    if not found:
        raise RuntimeError("names of sets of reads clash")
    about, queries, wanted, lists = found
    dropped(keyed)
    none = F.lit(None).cast("binary")
    shape = ["g", "slice", "kind", "colour", "n", "nodes", "start", "length", "which", "asked"]
    one = wanted.join(lists, "colour").select("g", "slice", F.when(F.col("asked"), 0).otherwise(1).alias("kind"), "colour", F.lit(0).cast("long").alias("n"), "nodes", *(none.alias(c) for c in shape[6:]))
    two = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(2))
    two = two.withColumn("colour", F.col("node")).withColumn("nodes", F.col("colours")).select(*shape)
    rows = one.select(*shape).union(two).repartition(2 * partitions, "g", "slice").sortWithinPartitions("g", "slice", "kind")
    pairs = written(rows.mapInArrow(_compared(k), "query long, target long, n long, span long"), "pairs")
    links = pairs.withColumn("pct", percentage(F.col("span"), F.col("n"))).where(F.col("pct") >= F.lit(float(threshold)).cast("float")).select("query", "target", "span", "pct")
    dropped(queries, wanted, lists)
    classes = classes.join(about.select("node", "n", "own"), "node")
    classes = written(classes.select("node", F.col("least.read_set").alias("class_set"), F.col("least.read_id").alias("class_id"), "size", "n", "own"), "classes")
    dropped(about)
    return SelfLinks(members, classes, links)
