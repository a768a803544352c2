"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, free_names, held, joined_by_group, raw, row_key, sent, small_batches, tidy, written
from ._words import Words, mix, shingles

#: Words of a shingle, least similarity, slots of a signature, slots of a band. A pair at 0.8 is found with 1 - (1 - 0.8**5)**25 = 0.99995.
SHINGLE, LEAST, SLOTS, BAND = 5, 0.8, 128, 5
#: Texts that are compared with one and the same leader at a stretch.
STAR = 256
#: Texts that share a rare shingle from which on they are compared in blocks of about BLOCK texts and BLOCK_TEXT bytes.
LARGE, BLOCK, BLOCK_TEXT = 64, 512, 1 << 20
#: Cells in which the frequencies of shingles are counted (as a power of 2).
CELL_BITS = 20
#: What rounding may take from a similarity.
_ROUNDING = 1e-9


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures (one row a set, uint64 element ids; 0 in the rows of empty sets).

    Each element of weight w is a Poisson process of rate w; its points fall on random slots, and a slot keeps the
    element of its earliest point. An element stops once its next point comes after the latest slot of its set, so that
    two sets agree in a slot with their probability Jaccard. Points are drawn for all sets at once, in growing runs.
    """
    if slots & (slots - 1) or slots > 2048:
        raise ValueError("slots: a power of 2, 2048 at most")
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    ids = np.zeros(len(sets) * slots, np.uint64)
    if not sizes.sum():
        return ids.reshape(len(sets), slots)
    first = np.full(len(sets) * slots, np.inf)
    elem = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    for k in np.flatnonzero(sizes == 1):  # one element takes every slot
        ids[k * slots : (k + 1) * slots] = sets[k][0][0]
    keep = sizes[owner] > 1
    elem, weight, owner = elem[keep], weight[keep], owner[keep]
    arrival, step, run = np.zeros(len(elem)), 0, 1
    shift = np.uint64(11 - (slots.bit_length() - 1))
    while len(elem):
        turns = mix(np.arange(step + 1, step + 1 + run, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        x = mix(elem[:, None] ^ turns)
        gap = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        at = arrival[:, None] + np.cumsum(gap, axis=1)
        slot = owner[:, None] * slots + ((x & np.uint64(2047)) >> shift).astype(np.int64)
        row, col = np.nonzero(at < first[slot])
        when, where, who = at[row, col], slot[row, col], elem[row]
        order = np.argsort(-when, kind="stable")  # the earliest is assigned last
        where = where[order]
        first[where], ids[where] = when[order], who[order]
        arrival = at[:, -1]
        latest = first.reshape(-1, slots).max(axis=1)
        keep = arrival < latest[owner]
        elem, weight, owner, arrival = elem[keep], weight[keep], owner[keep], arrival[keep]
        step += run
        run = min(run * 2, max(1, (1 << 17) // max(len(elem), 1)))
    return ids.reshape(len(sets), slots)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two weighted sets (sorted elements, weights); 1 of two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    upto = np.searchsorted(ratio, ratio, "right")
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float((1 / ((only_a + sum_x[upto]) / x + (only_b + sum_y[-1] - sum_y[upto]) / y)).sum())


def _signed(shingle: int, slots: int, band: int):
    bands = slots // band

    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        for batch in batches:
            for block in blocks(batch, "text"):
                data, offsets = raw(block.column("text"))
                words = Words(data, offsets)
                sets = shingles(words, shingle)
                sig = signatures(sets, slots)
                key = np.zeros((len(sets), bands), np.uint64)
                for k in range(band):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k : bands * band : band])
                key = mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                some = np.array([len(h) > 0 for h, _ in sets])
                content, norm = [], words.norm
                for k, ok in enumerate(some.tolist()):
                    # the words with single separators, or the text itself where it has no words
                    own = norm[offsets[k] : offsets[k + 1]].tobytes().split(b"\0") if ok else [b"\0", data[offsets[k] : offsets[k + 1]].tobytes()]
                    content.append(hashlib.blake2b(b" ".join(w for w in own if w) if ok else b"".join(own), digest_size=16).digest())
                counts = np.where(some, bands, 0)
                made = [pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key[some].ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("own"), *made], ["doc_id", "own", "content", "bands"])

    return kernel


def _sets(block: pa.RecordBatch, shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return shingles(Words(*raw(block.column("text"))), shingle)


def _alike(shingle: int, least: float):
    """Of rows (b, part, a, text) in order, the pairs that are alike; the text of b itself, the row without a, comes first in its part."""

    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        whose, leader = None, None
        for batch in batches:
            for block in blocks(batch, "text"):
                found = []
                for a, b, part, own in zip(block.column("a").to_pylist(), block.column("b").to_pylist(), block.column("part").to_pylist(), _sets(block, shingle), strict=True):
                    if a is None:
                        whose, leader = (b, part), own
                    elif whose != (b, part):
                        raise ValueError(f"the text of {b} is missing")
                    elif probability_jaccard(leader, own) >= least - _ROUNDING:
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return kernel


def _frequencies(shingle: int):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        count = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for block in blocks(batch, "text"):
                for h, _ in _sets(block, shingle):
                    count[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["cell", "n"])

    return kernel


def prefix(h: np.ndarray, w: np.ndarray, count: np.ndarray, least: float) -> np.ndarray:
    """The elements of a set that come first by (count of the cell, hash), so many that the rest weighs less than least.

    The probability Jaccard of two sets is at most the weight that their common elements have in either (of 1). The first
    common element in this order is in the prefix of both sets if that weight is least or more; so sets whose prefixes
    have no element in common can't be alike.
    """
    order = np.lexsort((h, count[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
    rest = np.cumsum(w[order][::-1])[::-1]
    return h[order[: int(np.searchsorted(-rest, -(least - _ROUNDING) * w.sum(), "right"))]]


def _prefixes(shingle: int, least: float, shared):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("words")
        count = shared.value
        for batch in batches:
            for block in blocks(batch, "text"):
                own = [prefix(h, w, count, least) if len(h) else h for h, w in _sets(block, shingle)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column("node"), block.column("comp"), block.column("size"), lists], ["node", "comp", "size", "prefix"])

    return kernel


def _overlaps(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of a block of sets: the number of common elements, and the weight that they have in the first, of 1."""
    n = len(sets)
    h, owner = np.concatenate([h for h, _ in sets]), np.repeat(np.arange(n), [len(h) for h, _ in sets])
    share = np.concatenate([w / w.sum() if len(w) else w for _, w in sets])
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    common, weight = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 2048):
        at = np.flatnonzero((column >= low) & (column < low + 2048))
        one, part = np.zeros((n, 2048), np.float32), np.zeros((n, 2048), np.float32)
        one[owner[at], column[at] - low] = 1
        part[owner[at], column[at] - low] = share[at]
        common += one @ one.T
        weight += part @ one.T
    return common, weight


def _linked_blocks(shingle: int, least: float):
    def kernel(table: pa.Table) -> pa.Table:
        held("words")
        table = table.combine_chunks()
        node, comp = (table.column(c).to_numpy() for c in ("node", "comp"))
        sets = _sets(table, shingle)
        common, weight = _overlaps(sets)
        size = np.array([len(h) for h, _ in sets], np.float64)
        plain = np.array([not len(w) or w.max() == 1 for _, w in sets])
        sure = common / np.maximum(size[:, None] + size - common, 1)
        both = plain[:, None] & plain
        # the probability Jaccard is at most the weight of the common elements in either set
        able = np.where(both, sure >= least - _ROUNDING, np.minimum(weight, weight.T) >= least - 1e-4)
        i, j = np.nonzero(np.triu(able, 1) & (comp[:, None] != comp))
        parent = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b and (both[x, y] or probability_jaccard(sets[x], sets[y]) >= least - _ROUNDING):
                parent[a] = b
                found.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return kernel


def components(links: DataFrame) -> DataFrame:
    """links (a, b): (node, comp), comp the least node that the node is connected to. Nodes without links are left out.

    Each round takes the least label among the neighbours and then the label's own label, so that long chains halve.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("next"))
        step = label.join(near, label.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "next").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = written(step.join(up, "comp").select("node", "was", F.least("comp", "up").alias("comp")), "labels")
        if step.where("comp <> was").isEmpty():
            return step.select("node", "comp")
        label = step.select("node", "comp")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) that are alike. The text of a b goes once to each part of its pairs, of about STAR, and each a's text once for each pair; a task holds one b."""
    crowded = written(pairs.groupBy("b").count().where(F.col("count") > STAR).select("b", F.ceil(F.col("count") / STAR).cast("int").alias("parts")), "crowded")
    dealt = pairs.join(sent(crowded), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    dealt = written(dealt, "dealt")
    rows = dealt.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "part", "a", "text")
    leaders = dealt.select("b", "part").distinct().join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    rows = rows.union(leaders).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return written(rows.mapInArrow(_alike(shingle, least), "a long, b long"), "near")


def _links_of_open(open_: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The links between texts of different classes (node, comp) that join classes: only texts whose prefixes share a shingle are compared."""
    texts = written(texts.join(open_, "node").select("node", "comp", F.octet_length("text").cast("long").alias("size"), "text"), "open")
    cells = texts.select("text").mapInArrow(_frequencies(shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2**CELL_BITS rows
    count = np.zeros(1 << CELL_BITS, np.int32)
    count[cells.column("cell").to_numpy()] = np.minimum(cells.column("n").to_numpy(), np.iinfo(np.int32).max)
    shared = texts.sparkSession.sparkContext.broadcast(count)
    rare = written(texts.mapInArrow(_prefixes(shingle, least, shared), "node long, comp long, size long, prefix array<long>"), "prefixes")
    rare = rare.select("node", "comp", "size", F.explode("prefix").alias("key"))
    wide = rare.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "n", "bytes")
    near = written(rare.join(wide, "key"), "rare")
    few = near.where(F.col("n") < LARGE)
    other = few.select("key", F.col("node").alias("b"), F.col("comp").alias("other"))
    across = few.select("key", F.col("node").alias("a"), "comp").join(other, "key").where("other < comp").select("a", "b").distinct()
    found = _compared(written(across, "pairs"), texts, shingle, least)
    many = near.where(F.col("n") >= LARGE)
    if many.isEmpty():
        return found
    number = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_TEXT))).cast("int")
    dealt = many.withColumn("block", F.pmod(F.xxhash64("node", "key"), number).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), number - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "node")
    return found.union(written(dealt.join(texts, "node").groupBy("key", "low", "high").applyInArrow(_linked_blocks(shingle, least), "a long, b long"), "near"))


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, slots: int, band: int) -> DataFrame:
    """(doc_id, own, class_id, kept) of each row of docs; own is its row_key()."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = base.mapInArrow(_signed(shingle, slots, band), "doc_id long, own string, content binary, bands array<long>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # the distinct contents, numbered once for all as they are written
    contents = signed.groupBy("content", "bands").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("n"))
    contents = written(contents.withColumn("node", F.monotonically_increasing_id()), "contents")
    banded = contents.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = written(banded.join(buckets, "key"), "members")
    repeated = not signed.groupBy("own").count().where("count > 1").isEmpty()

    def texts_of(nodes: DataFrame) -> DataFrame:
        rows = contents.join(nodes.distinct(), "node", "left_semi").select("node", "row")
        ids = written(signed.select("row", "own").join(rows, "row").select("own", "node"), "ids")
        found = base.join(sent(ids), "own").select("node", "text")
        return written(found.dropDuplicates(["node"]) if repeated else found, "texts")

    stars = written(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    links = _compared(stars, texts_of(stars.select(F.col("a").alias("node")).union(stars.select("b"))), shingle, least)
    comps = components(links)
    # in a bucket that is still in several classes, texts of different classes are compared
    placed = members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_ = written(placed.join(split, "key", "left_semi").select("node", "comp").distinct(), "open")
    if not open_.isEmpty():
        more = _links_of_open(open_, texts_of(open_.select("node")), shingle, least)
        if not more.isEmpty():
            comps = components(links.union(more))
    # a class is named by its least id; of its rows, the one of that id, by key and place, stays
    classed = contents.join(comps, "node", "left").select("content", "least", "n", F.coalesce("comp", "node").alias("comp"))
    classed = written(classed, "classes")
    names = classed.groupBy("comp").agg(F.min("least").alias("class_id"), F.count("*").alias("m"))
    named = written(joined_by_group(classed, written(names, "names"), "comp", "m"), "named")
    rows = joined_by_group(signed.select("content", "doc_id", "own", "row"), named.select("content", "n", "class_id", "comp"), "content")
    rows = written(rows.select("doc_id", "own", "row", "class_id", "comp"), "rows")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp").agg(F.min(F.struct("own", "row"))["row"].alias("row")).select("row")
    return rows.join(first.withColumn("kept", F.lit(True)), "row", "left").select("doc_id", "own", "class_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """(doc_id, class_id, kept): one row for each row of docs; class_id is the least id of its class (null if no row of it has one), kept marks the one row of a class that stays.

    Words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased; shingles of so many words weigh as
    often as they occur. Documents of equal words are one class without further ado, whatever their ids, and are one text
    from there on; every pair of distinct texts that shares a band is compared with its exact probability Jaccard unless
    both are already in one class: first all members of a bucket with its least, then texts of different classes, if they
    share one of the rare shingles that two alike texts must share.
    Null and empty texts, and texts without words, are alike only if the texts are identical (null counts as empty).
    Of rows that repeat whole, or share the class's least id, one is kept. Other columns are not read. An empty table
    gives an empty result.
    """
    return _classified(docs, id_col, text_col, shingle, least, slots, band).select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """docs with one row of each class of near-duplicates (that of the least id), with all its columns.

    A row is known by its id and its text; of a row that repeats and stays, any one is left.
    """
    keys = _classified(docs, id_col, text_col, shingle, least, slots, band).groupBy("own").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys, "keys")
    (key,) = free_names(docs, "key")
    gone = written(keys.where("not kept").select(F.col("own").alias(key)), "rejected")
    out = docs.withColumn(key, row_key(id_col, text_col)).join(sent(gone), key, "left_anti")
    again = written(keys.where("kept and n > 1").select(F.col("own").alias(key)), "repeated")
    if again.isEmpty():
        return out.select(docs.columns)
    again = sent(again)
    return out.join(again, key, "left_anti").union(out.join(again, key, "left_semi").dropDuplicates([key])).select(docs.columns)
