"""Token-ID output: tokenised documents in shard files, each compressed with a Re-Pair grammar for random access."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import blocks, held, raw, shared_dir, small_batches, tidy, written
from ._words import Hashes

#: Token ids of a grammar at most; a shard of more has several grammars, so that a writer's memory is bounded.
BLOCK_TOKENS = 1 << 19
#: Least count of a pair that is replaced. A rule takes about the bits of four symbols (two symbols and its length), so it
#: pays from here on.
LEAST = 5
#: Pairs are counted exactly, but first sieved by the counts of about as many cells (a power of 2, CELL_BITS at most). A
#: round replaces only pairs that occur at least 1 / STEP times as often as the fullest cell has pairs (or LEAST times, if that is more).
CELL_BITS, STEP = 18, 64
MAGIC = b"SWRePai2"
NO_ID = -(1 << 63)

# --- tokens -----------------------------------------------------------------------------------------------------------

#: Classes of bytes: 1 letters, 2 digits, 3 others, 4 the blank, 5 other white space. From 0x80 on: letters; see _plain.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x20] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5


class WordEncoder:
    """Encodes blocks of texts with a byte-level BPE tokenizer, each distinct piece once as long as it is remembered.

    A text of plain letters, digits, blanks and signs is split into the tokenizer's pieces by byte classes; all other
    texts (apostrophes, characters beyond Latin-1 letters, the content of an added token such as <|endoftext|>) go to
    the tokenizer whole. The distinct pieces of a block are looked up by a hash in tables of fixed size, and a remembered
    piece counts only if its bytes are the same.
    """

    SLOTS, TEXT, POOL = 1 << 21, 1 << 24, 1 << 23

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        split = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("\n", "\nab\n ab\n1")]
        self.line = split[0][0] if len(split[0]) == 1 and split[1].count(split[0][0]) == 3 else None
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. A slot: where its piece's bytes begin and how many there are (0: none), and the same for its ids."""
        self.start, self.length = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.uint8)
        self.at, self.size = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.uint8)
        self.text, self.written = np.zeros(self.TEXT, np.uint8), 0
        self.pool, self.used = np.zeros(self.POOL, self.dtype), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_lines(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has. No piece holds a line end: they are encoded many at once, a line end after each."""
        size = end - start
        to = np.cumsum(size + 1)
        text = np.full(int(to[-1]), 10, np.uint8)
        inside = np.ones(len(text), bool)
        inside[to - 1] = False
        text[inside] = data[_ranges(start, size)]
        cuts = np.append(to[999:-1:1000], to[-1]).tolist()
        texts = [text[a:b].tobytes().decode() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        ids = np.concatenate([np.array(x, self.dtype) for x in self.whole(texts)])
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(start):
            raise ValueError("the tokenizer doesn't keep line ends apart")
        return ids[ids != self.line], np.diff(ends, prepend=-1) - 1

    def _coded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has."""
        blank = _CLASS[data[end - 1]] >= 4  # a piece that ends with white space is white space
        lines = ~blank if self.line is not None else np.zeros(len(start), bool)
        flat, sizes = self._in_lines(data, start[lines], end[lines]) if lines.any() else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if lines.all():
            return flat, sizes
        alone = self.whole([data[a:b].tobytes().decode() for a, b in zip(start[~lines].tolist(), end[~lines].tolist(), strict=True)])
        size = np.zeros(len(start), np.int64)
        size[lines], size[~lines] = sizes, [len(x) for x in alone]
        out = np.zeros(int(size.sum()), self.dtype)
        place = np.cumsum(size) - size
        out[_ranges(place[lines], sizes)] = flat
        out[_ranges(place[~lines], size[~lines])] = np.concatenate([np.array(x, self.dtype) for x in alone])
        return out, size

    def _known(self, data: np.ndarray, start: np.ndarray, long: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which pieces are remembered in their slots: of the same length and the same bytes."""
        hit = self.length[slot] == long
        at = np.flatnonzero(hit)
        if len(at):
            sizes = long[at]
            other = self.text[_ranges(self.start[slot[at]], sizes)] != data[_ranges(start[at], sizes)]
            hit[at] = np.add.reduceat(other, np.cumsum(sizes) - sizes, dtype=np.int64) == 0
        return hit

    def _distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, places, sizes): of distinct pieces that lie one after another, where the ids of each are."""
        start, long = offsets[:-1], np.diff(offsets)
        slot = (Hashes(data).of(start, offsets[1:]) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        hit = self._known(data, start, long, slot)
        place, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return self.pool, place, size
        flat, sizes = self._coded(data, start[miss], offsets[1:][miss])
        place[miss], size[miss] = self.used + np.cumsum(sizes) - sizes, sizes
        keep = miss[long[miss] < 256]
        fresh = data[_ranges(start[keep], long[keep])]
        if self.used + len(flat) > self.POOL or self.written + len(fresh) > self.TEXT:
            ids = np.concatenate([self.pool[: self.used], flat])
            self.clear()
            return ids, place, size
        self.pool[self.used : self.used + len(flat)] = flat
        self.text[self.written : self.written + len(fresh)] = fresh
        to = slot[keep]
        self.start[to], self.length[to] = self.written + np.cumsum(long[keep]) - long[keep], long[keep]
        self.at[to], self.size[to] = place[keep], size[keep]
        self.used += len(flat)
        self.written += len(fresh)
        return self.pool, place, size

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold only ASCII without apostrophes and Latin-1 letters (two bytes, 0xC3 first, but no multiplication and division sign), and no added token."""
        odd = data == 0x27
        high = data >= 0x80
        if high.any():
            lead = data == 0xC3
            after = np.zeros(len(data), bool)
            after[1:] = lead[:-1]
            odd |= high & ~lead & ~(after & (data != 0x97) & (data != 0xB7))
        if self.added:
            joined = data.tobytes()
            for content in self.added:
                at = joined.find(content)
                while at >= 0:  # one that lies across two texts only sends the first of them to the tokenizer
                    odd[at] = True
                    at = joined.find(content, at + 1)
        seen = np.concatenate([[0], np.cumsum(odd)])
        return seen[offsets[1:]] == seen[offsets[:-1]]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of plain texts begin; each ends where the next begins."""
        kind = _CLASS[data]
        blank = kind >= 4
        begin = np.zeros(len(data), bool)
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        prev, nxt = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [4]])
        ends_doc = np.concatenate([begin[1:], [True]])
        return np.flatnonzero((~blank & (kind != prev) & (prev != 4)) | (blank & (prev < 4)) | (blank & (nxt < 4) & ~ends_doc) | begin)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offsets of the texts in them."""
        plain, n = self._plain(data, offsets), len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        start = self._pieces(data, offsets)
        cuts = np.append(start, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        if not plain.all():
            ok = plain[np.searchsorted(offsets, start, "right") - 1]
            pieces, start = pieces.filter(pa.array(ok)), start[ok]
        if len(start):
            coded = pieces.dictionary_encode()
            which = coded.indices.to_numpy()
            pool, place, size = self._distinct(*raw(coded.dictionary))
            sizes = size[which]
            ids = pool[_ranges(place[which], sizes)]
        else:
            ids, sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        words = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]
        if plain.all():
            return ids, words
        out = [ids[a:b] for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True)]
        odd = np.flatnonzero(~plain)
        for k, x in zip(odd.tolist(), self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd]), strict=True):
            out[k] = np.array(x, self.dtype)
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of size places each, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    own = held("tokens")
    if path not in own:
        own[path] = WordEncoder(path)
    return own[path]


# --- grammar ----------------------------------------------------------------------------------------------------------


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def _ranked(key: np.ndarray, floor: int) -> np.ndarray:
    """The keys that occur at least floor times, the most frequent first."""
    often = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], often[1:] != often[:-1]])) if len(often) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(often)))
    some = np.flatnonzero(times >= floor)
    return often[first[some[np.argsort(-times[some], kind="stable")]]]


def compress(ids: np.ndarray, offsets: np.ndarray, vocab: int, least: int = LEAST, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, offsets of the documents in them, rules, lengths); a rule is the two symbols that its nonterminal (from vocab on) stands for, its length the ids in all.

    A round counts the pairs inside documents (of a run of one symbol, every second place) and replaces the most frequent,
    of two that overlap the more frequent. A pair that so loses all but a few of its places waits. Rounds go on until no
    pair occurs least times: after all such pairs have been replaced once, only those with a new symbol are counted, and
    when these run out, all pairs once more.
    """
    if least < 2:
        raise ValueError("least: 2 at least")
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)  # of a document: the pair from here would cross its end
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    rules, lengths = [np.zeros((0, 2), np.uint32)], [np.ones(vocab, np.int64)]
    made, fresh = 0, 0  # nonterminals; the pairs that are counted hold a symbol from fresh on
    while len(seq) > 1:
        use = ~last[:-1]
        if fresh:
            new = seq >= fresh
            use &= new[:-1] | new[1:]
        same = np.flatnonzero(use & (seq[:-1] == seq[1:]))
        if len(same):
            odd = np.arange(len(same))
            begins = np.concatenate([[True], np.diff(same) > 1])
            odd -= np.maximum.accumulate(np.where(begins, odd, 0))
            use[same[odd & 1 == 1]] = False
        at = np.flatnonzero(use)
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        bits = min(CELL_BITS, max(8, len(key).bit_length()))
        cell = _cells(key, bits)
        count = np.bincount(cell, minlength=1 << bits)
        floor, pairs = max(least, int(count.max(initial=0)) // step), key[:0]
        while True:
            full = count[cell] >= floor  # a pair of a lesser cell can't occur so often
            pairs = _ranked(key[full], floor)
            if len(pairs) or floor == least:
                break
            floor = max(least, floor // 2)  # the fullest cell holds several pairs
        if not len(pairs):
            if not fresh:
                break
            fresh = 0
            continue
        at, key, cell = at[full], key[full], cell[full]
        number = np.full(1 << bits, -1, np.int32)
        number[_cells(pairs, bits)[::-1]] = np.arange(len(pairs) - 1, -1, -1)  # of the pairs of a cell the most frequent; others wait
        rank = number[cell]
        ok = rank >= 0
        ok[ok] = pairs[rank[ok]] == key[ok]
        at, rank = at[ok], rank[ok]
        beside = at[1:] == at[:-1] + 1
        beaten = np.zeros(len(at), bool)
        beaten[1:] |= beside & (rank[:-1] < rank[1:])
        beaten[:-1] |= beside & (rank[1:] <= rank[:-1])
        at, rank = at[~beaten], rank[~beaten]
        good = np.bincount(rank, minlength=len(pairs)) >= least
        at, rank = at[good[rank]], rank[good[rank]]
        pairs, rank = pairs[good], (np.cumsum(good) - 1)[rank]
        seq[at] = vocab + made + rank
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rule = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        size = np.concatenate(lengths)
        rules.append(rule)
        lengths = [size, size[rule].sum(1)]
        fresh = vocab + made if floor == least else 0
        made += len(pairs)
    docs = np.concatenate([[0], np.flatnonzero(last) + 1])
    if len(docs) != len(offsets):  # some document is empty
        sizes = np.zeros(len(offsets) - 1, np.int64)
        sizes[np.diff(offsets) > 0] = np.diff(docs)
        docs = np.concatenate([[0], np.cumsum(sizes)])
    return seq, docs, np.concatenate(rules), np.concatenate(lengths)[vocab:]


class Grammar:
    """Expands symbols by rules and expansion lengths."""

    def __init__(self, vocab: int, rules: np.ndarray, lengths: np.ndarray):
        self.vocab, self.rules, self.lengths, self._flat = vocab, rules, lengths.astype(np.int64), None

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.vocab
        out[big] = self.lengths[symbols[big] - self.vocab]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a few symbols, rule by rule."""
        while (big := symbols >= self.vocab).any():
            times = big + np.int64(1)
            to = (np.cumsum(times) - times)[big]
            pair = self.rules[symbols[big] - self.vocab]
            symbols = np.repeat(symbols, times)
            symbols[to], symbols[to + 1] = pair[:, 0], pair[:, 1]
        return symbols

    def part(self, symbols: np.ndarray, first: int, last: int) -> np.ndarray:
        """The ids from first to before last of what symbols stand for; what lies outside is passed by its length."""
        while True:
            ends = np.cumsum(self.sizes(symbols))
            a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left")) + 1
            before = int(ends[a - 1]) if a else 0
            symbols, first, last = symbols[a:b], first - before, last - before
            if len(symbols) > 2 or not len(symbols) or (symbols < self.vocab).all():
                return self.expand(symbols)[first:last]
            big = symbols >= self.vocab  # one or two symbols whose rules lead on
            symbols = np.concatenate([self.rules[x - self.vocab] if y else np.array([x], np.uint32) for x, y in zip(symbols.tolist(), big.tolist(), strict=True)])

    def expand_many(self, symbols: np.ndarray) -> np.ndarray:
        """The same as expand(), by a table of all rules' ids, for whole blocks. A rule has at most 1 / least of the block's ids, so the table has a few times the block's."""
        if self._flat is None:
            self._at = np.arange(self.vocab + len(self.rules), dtype=np.int64)
            self._at[self.vocab :] = self.vocab + np.cumsum(self.lengths) - self.lengths
            flat = np.zeros(self.vocab + int(self.lengths.sum()), np.uint32)
            flat[: self.vocab] = np.arange(self.vocab)
            highest, a = self.rules.max(axis=1, initial=0).astype(np.int64), 0
            while a < len(self.rules):  # as many rules as don't build on one another
                later = np.flatnonzero(highest[a:] >= self.vocab + a)
                b = a + int(later[0]) if len(later) else len(self.rules)
                pair = self.rules[a:b].ravel()
                to, size = int(self._at[self.vocab + a]), self.sizes(pair)
                flat[to : to + int(size.sum())] = flat[_ranges(self._at[pair], size)]
                a = b
            self._flat = flat
        return self._flat[_ranges(self._at[symbols], self.sizes(symbols))]


# --- files: MAGIC, blocks, then for each block its place, least and greatest id, then the end of blocks, their number and MAGIC

_HEAD = struct.Struct("<QQQQQ")  # documents, symbols, rules, vocabulary, bits of a symbol


def pack_bits(x: np.ndarray, bits: int) -> bytes:
    """Numbers below 2 ** bits, one after another, the lowest bit first."""
    cut = [np.unpackbits(np.ascontiguousarray(x[k : k + 65536], "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits] for k in range(0, len(x), 65536)]
    return b"".join(np.packbits(c, bitorder="little").tobytes() for c in cut)  # 65,536 numbers fill whole bytes


def unpack_bits(data: bytes | np.ndarray, bits: int, first: int, n: int) -> np.ndarray:
    """n numbers from the first on."""
    data = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(0, n, 65536):
        m = min(65536, n - k)
        low = (first + k) * bits
        one = np.unpackbits(data[low // 8 : (low + m * bits + 7) // 8], bitorder="little")[low % 8 : low % 8 + m * bits].reshape(m, bits)
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :bits] = one
        out[k : k + m] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def pack(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, vocab: int, **options) -> bytes:
    """One block: header, document ids, their offsets in the tokens and in the symbols, expansion lengths of the rules, then rules and symbols in as many bits as the largest takes."""
    symbols, docs, rules, lengths = compress(ids, offsets, vocab, **options)
    bits = max(1, (vocab + len(rules) - 1).bit_length())
    parts = [doc_ids.astype("<i8").tobytes(), offsets.astype("<u8").tobytes(), docs.astype("<u8").tobytes(), lengths.astype("<u4").tobytes(), pack_bits(rules.ravel(), bits), pack_bits(symbols, bits)]
    return _HEAD.pack(len(doc_ids), len(symbols), len(rules), vocab, bits) + b"".join(parts)


class Block:
    """A packed block behind read(place, size); what is needed is read when it is needed."""

    def __init__(self, read):
        self._read = read
        self.docs, self.symbols, rules, self.vocab, self.bits = _HEAD.unpack(read(0, _HEAD.size))
        self._rules = rules
        self._places = np.cumsum([_HEAD.size, 8 * self.docs, 8 * (self.docs + 1), 8 * (self.docs + 1), 4 * rules, (2 * rules * self.bits + 7) // 8]).tolist()
        self._grammar = None

    def _numbers(self, part: int, kind: str, first: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._read(self._places[part] + first * size, n * size), kind)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._numbers(0, "<i8", 0, self.docs)

    @property
    def offsets(self) -> np.ndarray:
        """Of the documents in the tokens."""
        return self._numbers(1, "<u8", 0, self.docs + 1).astype(np.int64)

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            lengths = self._numbers(3, "<u4", 0, self._rules)
            rules = unpack_bits(self._read(self._places[4], (2 * self._rules * self.bits + 7) // 8), self.bits, 0, 2 * self._rules)
            self._grammar = Grammar(self.vocab, rules.reshape(-1, 2), lengths)
        return self._grammar

    def symbols_of(self, k: int, to: int) -> np.ndarray:
        """The symbols of the documents from the k-th on."""
        a, b = (int(self._numbers(2, "<u8", x, 1)[0]) for x in (k, to))
        skip = a % 8  # eight symbols fill whole bytes
        low, high = (a - skip) * self.bits // 8, (b * self.bits + 7) // 8
        return unpack_bits(self._read(self._places[5] + low, high - low), self.bits, skip, b - a)

    def document(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the k-th document, or those from first to before last; of the symbols only that document's are read."""
        symbols = self.symbols_of(k, k + 1)
        return self.grammar.expand(symbols) if not first and last is None else self.grammar.part(symbols, first, int(self.grammar.sizes(symbols).sum()) if last is None else last)

    def runs(self, tokens: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, next document, their ids) for runs of about so many tokens."""
        ends, k = self.offsets[1:], 0
        while k < self.docs:
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + tokens, "right")))
            yield k, to, self.grammar.expand_many(self.symbols_of(k, to))
            k = to


class ShardFile:
    """Reads one shard file, block by block; document() finds a single one by the blocks' ids."""

    def __init__(self, path: str):
        system, name = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, magic = struct.unpack("<Q8s", self._read(size - 16, 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        tail = np.frombuffer(self._read(size - 16 - 8 * (3 * n + 1), 8 * (3 * n + 1)), "<i8")
        self.places, self.low, self.high = tail[: n + 1].tolist(), tail[n + 1 : 2 * n + 1], tail[2 * n + 1 :]

    def _read(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def block(self, k: int) -> Block:
        return Block(lambda place, size: self._read(self.places[k] + place, size))

    def blocks(self) -> Iterator[Block]:
        """All blocks, each read at once."""
        for a, b in zip(self.places[:-1], self.places[1:], strict=True):
            data = self._read(a, b - a)
            yield Block(lambda place, size, data=data: data[place : place + size])

    def document(self, doc_id: int | None, first: int = 0, last: int | None = None) -> np.ndarray | None:
        """The ids of the first document with that id, or a range of them; ids ascend, so two searches find it. None without one."""
        wanted = NO_ID if doc_id is None else doc_id
        k = int(np.searchsorted(self.high, wanted))
        if k == len(self.high) or self.low[k] > wanted:
            return None
        block = self.block(k)
        ids = block.doc_ids
        at = int(np.searchsorted(ids, wanted))
        return block.document(at, first, last) if at < len(ids) and ids[at] == wanted else None

    def close(self) -> None:
        self.file.close()


# --- jobs -------------------------------------------------------------------------------------------------------------


def _tokenised(path: str, end_id: int, bounds: np.ndarray):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                data, offsets = raw(block.column("text"))
                ids, at = enc.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                doc = block.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                wide = enc.dtype.itemsize
                # a bound that repeats is an id of many rows: its rows are spread over the shards between by their contents
                shard, bytes_ = low.astype(np.int64), memoryview(np.ascontiguousarray(ids, enc.dtype)).cast("B")
                for k in np.flatnonzero(high > low + 1).tolist():
                    shard[k] += zlib.crc32(bytes_[at[k] * wide : at[k + 1] * wide]) % (high[k] - low[k] + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(shard.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((at * wide).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(ids, enc.dtype))])],
                    ["doc_id", "shard", "ids"],
                )

    return kernel


def _write(folder: str, vocab: int, options: dict):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("shards")  # the encoder's tables go
        kind = "<u2" if vocab <= 1 << 16 else "<u4"
        system, name = pafs.FileSystem.from_uri(folder)
        system.create_dir(name, recursive=True)
        out, file, place, low, high, kept, size, totals = None, "", [], [], [], [], 0, [0, 0]

        def flush() -> None:
            nonlocal kept, size
            if kept:
                doc = np.concatenate([d for d, _, _ in kept])
                sizes = np.concatenate([n for _, n, _ in kept])
                ids = np.concatenate([x for _, _, x in kept])
                kept, size = [], 0
                out.write(pack(doc, ids, np.concatenate([[0], np.cumsum(sizes)]), vocab, **options))
                place.append(out.tell())
                low.append(int(doc[0]))
                high.append(int(doc[-1]))
                totals[0] += len(doc)
                totals[1] += len(ids)

        shard = -1
        for batch in batches:
            for block in blocks(batch, "ids", BLOCK_TOKENS // 8 * np.dtype(kind).itemsize):
                data, offsets = raw(block.column("ids"))
                ids, offsets = np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize
                if out is None:
                    shard = block.column("shard")[0].as_py()
                    file = f"{name}/{shard:06d}-{uuid.uuid4().hex}.swrp"  # an attempt that is run again has a file of its own
                    out = system.open_output_stream(file)
                    out.write(MAGIC)
                    place.append(out.tell())
                if size + len(ids) > BLOCK_TOKENS:
                    flush()
                kept.append((block.column("doc_id").to_numpy(), np.diff(offsets), ids))
                size += len(ids)
        if out is not None:
            flush()
            out.write(np.array([*place, *low, *high], "<i8").tobytes() + struct.pack("<Q8s", len(low), MAGIC))
            n = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [folder + "/" + file.rsplit("/", 1)[1]], "n_docs": [totals[0]], "n_tokens": [totals[1]], "n_bytes": [n]})

    return kernel


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("shards")
    for batch in batches:
        for row in batch.to_pylist():
            start, shard = row["start"], ShardFile(row["path"])
            for block in shard.blocks():
                for a, b, ids in block.runs():
                    sizes, data = np.diff(block.offsets[a : b + 1]), memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(sizes)
                    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                    doc = block.doc_ids[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])
            shard.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes shard files in ascending order of ids and returns their manifest (shard, path, n_docs, n_tokens, n_bytes, start).

    Each document's ids end with end_id; null and empty texts have only that. Null ids come first. Rows that share an id
    stand side by side in an order that their tokens decide; of an id with very many rows, several shards share the rows
    (rows that repeat whole stay together).
    shards: spark.sql.shuffle.partitions if not given; set either so that a shard has some hundred MB at most. A file is
    named by its attempt, and only the manifest says which count, so tasks may be run again. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = base.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], max(10_000, 20 * shards)).alias("x")).first()["x"] if shards > 1 else []
    bounds = np.array(cuts or [], np.int64)
    coded = base.mapInArrow(_tokenised(tokenizer, end_id, bounds), "doc_id long, shard int, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer).get_vocab_size()
    manifest = written(dealt.mapInArrow(_write(folder, vocab, options), "shard int, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of the manifest."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "path", "start").repartitionById(parts, F.col("shard") % parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs to a new shared folder and reads them back."""
    return read_tokens(write_tokens(docs, shared_dir(spark, "tokens"), tokenizer, end_id))
