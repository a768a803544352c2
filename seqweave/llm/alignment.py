"""Cross-tokenizer alignment: tokens of two tokenizers grouped where both end, their links counted over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, held, raw, small_batches, tidy, written
from .token_output import WordEncoder, _ranges

#: Bytes of text that are aligned at once, links that are made at once, and those of a group from which on its tokens are counted first.
BLOCK, LINKS, LARGE = 1 << 19, 1 << 21, 1 << 12
#: Pairs whose counts are broadcast, the most frequent ones (about 64 MB); the rest are joined.
FREQUENT = 1_000_000
_SPACE = "▁"


class PlainEncoder(WordEncoder):
    """A byte-level BPE tokenizer for which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def token_bytes(self) -> list[bytes]:
        """What each id stands for. Byte-level entries have a character for each byte: printable ones of Latin-1 themselves, the others the characters from 256 on, in order."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        entries = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]


class PieceEncoder(WordEncoder):
    """A sentencepiece BPE model that puts a blank before each text.

    Where the model leaves texts as they are and no piece has a blank behind another character, what lies between two
    such places is encoded by itself, each distinct stretch once as long as it is remembered; otherwise texts are
    encoded whole. Texts are given with the blank before them.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.dtype = np.dtype("<u2") if len(self.pieces) <= 1 << 16 else np.dtype("<u4")
        self.blank = self.model.piece_to_id(_SPACE)
        self.line, self.added = None, []
        inside = any(_SPACE in p.lstrip(_SPACE) for p in self.pieces)
        probe = "ﬁ  Å \t x 　y "  # characters and blanks that normalisation would change
        same = b"".join(self.token_bytes()[k] for k in self.model.encode(probe)) == (" " + probe).encode()
        self.cut = same and not inside and self.pieces[self.blank] == _SPACE
        self.clear()

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(self.pieces)]

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, each with a blank before it, which the model adds itself; of a blank alone it would give none."""
        out = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [x or ([self.blank] if t == " " and self.cut else []) for x, t in zip(out, texts, strict=True)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.cut)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = data == 0x20
        begin = np.zeros(len(data), bool)
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin[1:] |= blank[1:] & ~blank[:-1]
        return np.flatnonzero(begin)


class Side:
    """One of the two tokenizers: encodes texts that have a blank before them, and says where tokens end and whether their bytes are the text's."""

    def __init__(self, path: str):
        self.encoder = (PlainEncoder if path.endswith(".json") else PieceEncoder)(path)
        text = self.encoder.token_bytes()
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.vocab = len(text)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them, which texts their tokens' bytes are)."""
        ids, at = self.encoder.encode(data, offsets)
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        good = upto[at[1:]] - upto[at[:-1]] == np.diff(offsets)
        if good.all():
            use, place = slice(None), np.arange(len(data))
        else:
            use = np.repeat(good, np.diff(at))
            place = _ranges(offsets[:-1][good], np.diff(offsets)[good])
        other = self.bytes[_ranges(self.starts[ids[use]], sizes[use])] != data[place]
        if other.any():
            good[np.searchsorted(offsets, place[other], "right") - 1] = False
        return ids, at, good


def side(path: str) -> Side:
    """This worker's tokenizer of a file."""
    own = held("alignment")
    if path not in own:
        own[path] = Side(path)
    return own[path]


def _kept(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of good texts, and the offsets of all texts in them."""
    count = np.where(good, np.diff(at), 0)
    return (ids if good.all() else ids[np.repeat(good, np.diff(at))]), np.concatenate([[0], np.cumsum(count)])


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Two ascending lists of ends merged: the group of each token of either list, and the number of groups. A group closes where both lists have an end."""
    at = np.searchsorted(end_b, end_a)  # the place of each end of one list in the other: the steps of two pointers
    common = end_a[end_b[np.minimum(at, len(end_b) - 1)] == end_a] if len(end_b) else end_a[:0]
    return np.searchsorted(common, end_a), np.searchsorted(common, end_b), len(common)


def _text(ids: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a,a|b;a|b,b;` of all groups, and where each group ends in it."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    both, sign = np.zeros(len(ids) + len(b), np.int64), np.zeros(len(ids) + len(b), np.int8)
    both[np.arange(len(ids)) + before_b[group_a]] = ids
    both[np.arange(len(b)) + (before_a + n_a)[group_b]] = b
    ends = np.cumsum(n_a + n_b)
    sign[ends - n_b - 1], sign[ends - 1] = 1, 2
    joined = pc.binary_join_element_wise(pc.cast(pa.array(both), pa.string()), pa.DictionaryArray.from_arrays(pa.array(sign), pa.array([",", "|", ";"])).dictionary_decode(), "")
    data, offsets = raw(joined)
    return data.tobytes(), offsets[ends]


def _links(doc: np.ndarray, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int, wide: int, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, times): the distinct pairs of ids that are linked, by text (key: text * wide + a * vocab + b), and how many links each has. doc: the text of each group."""
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    large = n_a * n_b > LARGE
    weight_a, weight_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if large.any():  # equal tokens of such a group are one, with their number
        def counted(x, group, vocab):
            big = large[group]
            key, n = np.unique(group[big] * vocab + x[big], return_counts=True)
            x, group, weight = np.concatenate([x[~big], key % vocab]), np.concatenate([group[~big], key // vocab]), np.concatenate([np.ones(int((~big).sum()), np.int64), n])
            order = np.argsort(group, kind="stable")
            return x[order], group[order], weight[order]

        a, group_a, weight_a = counted(a, group_a, wide // vocab)
        b, group_b, weight_b = counted(b, group_b, vocab)
        n_b = np.bincount(group_b, minlength=n_groups)
    first = np.cumsum(n_b) - n_b
    many = n_b[group_a]
    upto = np.cumsum(many)
    keys, times, k = [], [], 0
    while k < len(a):  # as many tokens of one side as have about LINKS links
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + LINKS, "right")))
        mine = np.repeat(np.arange(k, to), many[k:to])
        other = _ranges(first[group_a[k:to]], many[k:to])
        key, back, n = np.unique(doc[group_a[mine]] * wide + a[mine] * vocab + b[other], return_inverse=True, return_counts=True)
        if large.any():
            n = np.bincount(back, weights=(weight_a[mine] * weight_b[other]).astype(np.float64)).astype(np.int64)
        keys.append(key)
        times.append(n)
        k = to
    if len(keys) < 2:
        return (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, np.concatenate(times))
    return key, total


def _aligned(path_a: str, path_b: str):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(path_a), side(path_b)
        wide = one.vocab * two.vocab
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                data, offsets = raw(block.column("text"))
                n = len(offsets) - 1
                some = np.diff(offsets) > 0
                sizes = np.diff(offsets) + some  # a blank goes before each text
                at = np.concatenate([[0], np.cumsum(sizes)])
                text = np.full(int(at[-1]), 0x20, np.uint8)
                text[_ranges(at[:-1] + some, np.diff(offsets))] = data
                a, at_a, good = one.encode(text, at)
                b, at_b, also = two.encode(text, at)
                good = good & also & some
                (a, at_a), (b, at_b) = _kept(a, at_a, good), _kept(b, at_b, good)
                group_a, group_b, n_groups = groups_of(np.cumsum(one.sizes[a]), np.cumsum(two.sizes[b]))
                # the groups of each text: its last token's ends the last of them
                upto = np.concatenate([[0], np.maximum.accumulate(np.where(np.diff(at_a) > 0, group_a[np.maximum(at_a[1:] - 1, 0)] + 1 if len(a) else 0, 0))])
                doc = np.repeat(np.arange(n), np.diff(upto))
                n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
                links = np.concatenate([[0], np.cumsum(n_a * n_b)])[upto]
                joined, ends = _text(a, group_a, b, group_b) if n_groups else (b"", np.zeros(0, np.int64))
                ends = np.concatenate([[0], ends])[upto].tolist()
                digest = [hashlib.sha256(joined[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]
                columns = {"row": block.column("row"), "doc_id": block.column("doc_id"), "n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(upto), "n_links": np.diff(links), "groups_sha256": digest}
                key, times = _links(doc, a, group_a, b, group_b, n_groups, wide, two.vocab)
                cuts = pa.array(np.searchsorted(key, np.arange(n + 1) * wide).astype(np.int32))
                columns["pairs"] = pa.ListArray.from_arrays(cuts, pa.array(key % wide))
                columns["times"] = pa.ListArray.from_arrays(cuts, pa.array(times))
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return kernel


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, one row for each row of docs: (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times).

    path_a: a file of the tokenizers library (byte-level BPE, .json), path_b one of sentencepiece (which adds a blank);
    A encodes the text with a blank before it, so that both have the same bytes. pairs are the distinct linked pairs of
    ids (a * vocabulary of B + b), times how many links each has in the text. row tells rows apart that share an id.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return written(base.mapInArrow(_aligned(path_a, path_b), schema), "links")


def pair_counts(found: DataFrame, vocab_b: int) -> DataFrame:
    """(pair, a, b, count, best): in how many rows of links() each pair is linked, and whether no pair of its a is linked in more. Counted map-side first; a written table."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {vocab_b}")).withColumn("b", F.col("pair") % vocab_b)
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return written(counts.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    n_best: links whose pair is linked in as many rows of the corpus as any pair of its A id; count_sum: over all links,
    in how many rows their pair is linked. Null and empty texts, and those whose joined tokens are not the blank and the
    text in either tokenizer, have no tokens: zeros and an empty digest. Rows that repeat are rows (and count) each.
    Other columns are not read; an empty table gives an empty result. The counts of the FREQUENT most frequent pairs are
    broadcast, so no pair that most texts have is shuffled; those of rarer pairs are joined.
    """
    found = links(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(found, _vocabulary(path_b)).select("pair", "count", "best")
    every = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= FREQUENT:
        scored = every.join(F.broadcast(counts), "pair")
    else:
        least = counts.agg(F.approx_percentile("count", 1 - FREQUENT / 2 / counts.count(), 10_000)).first()[0]
        frequent = written(counts.where(F.col("count") > least).orderBy(F.desc("count"), "pair").limit(FREQUENT), "frequent")
        marked = every.join(F.broadcast(frequent), "pair", "left")
        rare = counts.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        scored = marked.where("count is not null").unionByName(marked.where("count is null").select("row", "pair", "times").join(rare, "pair"))
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _vocabulary(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).vocab_size()
